"""Media columns: archives of media members, read by a custom Spark data source.

The writer stores a member for each row in ZIP archives (stored, so a member's bytes lie whole at an offset), an archive a
task, and lists in a manifest of the job those of the tasks that succeeded, so retried tasks leave nothing twice; the next job
adds its own, or, overwriting, takes the place of those before. The reader plans
ranges of bytes over the archives of a directory; a task reads its archive's directory, takes the members that start in
its range, and streams them in Arrow batches of bounded size. A member whose read or checksum fails is read again on its
own, by its offset; one that keeps failing ends the task, or, on request, gives null media.

A text becomes a lossless 8-bit grey PNG: its bytes, filled up with 255 (which UTF-8 never has) to rows of 576 samples.

Given results: null text is empty, and empty text one row of 255; null doc_id stays null; repeated rows each get a member; an empty
table makes no archive and gives no rows; other columns are ignored. doc_id is of a whole number's type. A member is one image, however
long its text: a text is held whole by its task, others are not held beside it (slices of 2 MB of text). The directory may be at any place that
pyarrow's file systems open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import in_batches, shared_dir, slices, table

FORMAT = "tessera_media"
#: A manifest of each job lists its archives: _manifest-<id>.json.
MANIFEST = "_manifest-"
ROW = 576
#: Bytes of an archive that a task reads, and of media in an Arrow batch, about; reads of a member before it counts as failed.
RANGE_BYTES, BATCH_BYTES, TRIES = 16 << 20, 4 << 20, 3
SCHEMA = "doc_id bigint, archive string, offset bigint, media binary"

PNG = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    n = max(1, -(-len(text) // ROW)) * ROW
    return text + b"\xff" * (n - len(text))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image, ROW samples wide, without filters."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples, by rows. Raises ValueError for what isn't such an image."""
    if media[:8] != PNG:
        raise ValueError("no PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            wide, rows, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not an 8-bit grey image")
            shape = rows, wide + 1
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't known here")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Rows, mean, deviation and a 64-bit difference hash (of the means of 65 strips) of an image."""
    flat = samples.reshape(-1)
    sums = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    edges = np.arange(66) * len(flat) // 65
    means = np.diff(sums[edges]) / np.diff(edges)
    bits = np.packbits(means[1:] > means[:-1]).tobytes().hex()
    squares = int(np.dot(flat.astype(np.float64), flat.astype(np.float64)))
    mean = sums[-1] / len(flat)
    return f"{len(samples)}:{mean:.3f}:{max(0.0, squares / len(flat) - mean * mean) ** 0.5:.3f}:{bits}"


@dataclass
class Written(WriterCommitMessage):
    archive: str | None
    members: int
    size: int


def manifests(store: fs.FileSystem, root: str) -> list[str]:
    """The manifests in a directory."""
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith(MANIFEST))


def archives(store: fs.FileSystem, manifest: str) -> list[tuple[str, int]]:
    """(name, bytes) of each archive of a manifest."""
    with store.open_input_file(manifest) as f:
        return [(name, size) for name, size in json.loads(f.read())]


class ArchiveWriter(DataSourceArrowWriter):
    """Appends a job's archives and its manifest to a directory; an overwriting job then deletes those that were there before."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        name, n, out, archive = f"part-{uuid.uuid4().hex}.zip", 0, None, None
        for batch in iterator:
            for doc, media in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(Streamed(out), "w", zipfile.ZIP_STORED)
                doc = doc.as_py()
                archive.writestr(zipfile.ZipInfo(f"{n}_{'null' if doc is None else doc}.png"), media.as_py())
                n += 1
        if archive is None:
            return Written(None, 0, 0)
        archive.close()
        out.close()
        return Written(name, n, store.get_file_info(f"{root}/{name}").size)

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        before = manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.archive, m.size] for m in messages if m and m.archive]).encode())
        for manifest in before:
            names = [name for name, _ in archives(store, manifest)]
            store.delete_file(manifest)
            for name in names:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.archive:
                store.delete_file(f"{root}/{m.archive}")


class Streamed(io.RawIOBase):
    """A stream that zipfile can write to."""

    def __init__(self, out: pa.NativeFile):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MemberError(OSError):
    pass


def read_member(store: fs.FileSystem, path: str, offset: int, size: int, crc: int, tries: int = TRIES, wait: float = 0.2) -> bytes:
    """A member's bytes, by its offset; the file is opened anew for each try."""
    why = None
    for k in range(tries):
        try:
            with store.open_input_file(path) as f:
                f.seek(offset)
                head = f.read(30)
                if head[:4] != b"PK\3\4":
                    raise MemberError("no member starts here")
                f.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
                data = f.read(size)
            if len(data) != size or zlib.crc32(data) != crc:
                raise MemberError("its bytes are not those that were written")
            return data
        except OSError as e:
            why = e
            time.sleep(wait * k)
    raise MemberError(f"{path} at {offset}: {why}")


def directory(store: fs.FileSystem, path: str, tries: int = TRIES, wait: float = 0.2) -> list[tuple[str, int, int, int]]:
    """(name, offset, bytes, checksum) of an archive's members, by offset; the file is opened anew for each try."""
    why: Exception | None = None
    for k in range(tries):
        try:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                return sorted(((m.filename, m.header_offset, m.file_size, m.CRC) for m in archive.infolist()), key=lambda m: m[1])
        except (OSError, zipfile.BadZipFile) as e:
            why = e
            time.sleep(wait * k)
    raise MemberError(f"{path}: its directory can't be read: {why}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.missing = options.get("onerror", "fail") == "null"

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = manifests(store, root)
        if not found:
            raise FileNotFoundError(f"no manifest under {self.path}")
        # An archive's size is enough for its ranges: directories are read by the tasks.
        return [Range(name, a, a + self.range) for m in found for name, size in archives(store, m) for a in range(0, size, self.range)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        path = f"{root}/{partition.archive}"
        own = [m for m in directory(store, path) if partition.start <= m[1] < partition.end]
        with store.open_input_file(path) as f:
            rows: list[tuple] = []
            held = 0
            for name, offset, size, crc in own:
                data: bytes | None
                try:
                    f.seek(offset)
                    head = f.read(30)
                    f.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
                    data = f.read(size)
                    if head[:4] != b"PK\3\4" or len(data) != size or zlib.crc32(data) != crc:
                        raise MemberError("damaged")
                except (OSError, struct.error):
                    try:
                        data = read_member(store, path, offset, size, crc)
                    except MemberError:
                        if not self.missing:
                            raise
                        data = None
                doc = name.partition("_")[2].removesuffix(".png")
                rows.append((None if doc == "null" else int(doc), partition.archive, offset, data))
                held += size
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "archive", "offset", "media"])


class MediaSource(DataSource):
    """spark.read.format("tessera_media").load(directory); df (doc_id, media).write.format("tessera_media").mode("append").save(directory).
    Options: rangeBytes (of an archive in a partition), onError (fail, or null)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_media(docs: DataFrame, path: str) -> None:
    """A member for each row of docs (doc_id, text) in archives under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                media = [to_png(padded(t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    docs.sparkSession.dataSource.register(MediaSource)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_batches, run, "doc_id bigint, media binary")
    rows.write.format(FORMAT).mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(doc_id, archive, offset, media) of all members under path."""
    spark.dataSource.register(MediaSource)
    return spark.read.format(FORMAT).options(**options).load(path)


def described(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each member; nulls for null media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column(1).to_pylist():
                if m is None:
                    rows.append((None,) * 7)
                    continue
                samples = from_png(m)
                payload = samples.tobytes()
                rows.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], out.names)

    longs, strings = T.LongType(), T.StringType()
    out = T.StructType([T.StructField(k, t) for k, t in (("doc_id", longs), ("n_bytes", longs), ("payload_bytes", longs), ("payload_sha256", strings), ("tail_crc32", longs), ("media_bytes", longs), ("media_sha256", strings), ("feature", strings))])
    return media.select("doc_id", "media").transform(in_batches, run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tessera-media-{uuid.uuid4().hex}"
    write_media(table(spark, sf_dir, "documents"), path)
    return described(read_media(spark, path))
