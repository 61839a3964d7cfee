"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id. Texts are judged as they came.

Windows of 50 bytes that are equal have the same smallest hash of a 22-byte part, so they meet where that hash is dealt
to. Neighbouring windows of one smallest hash form a cell, whose content is the bytes under them. A task first drops cells whose
content it has in an earlier document: their windows are all repeats, so a group of copies costs a row a task. What is left meets by
its hash. Of each distinct content only the earliest document's cells are still open; where a hash has several contents,
those are indexed by a suffix array, in which equal windows are neighbours, and the earliest document of each run decides.
Of these contents the bytes are indexed that another content of the hash has next to the 22-byte part too, which no shared window exceeds;
a content of which that leaves less than a window isn't. Where a hash has very many contents, they are dealt by more bytes than the 22.

Given results: null text is empty; a text under 50 bytes stays whole; rows that share a doc_id do not repeat each other, and each
gets its row; a row with null doc_id stays whole and makes no other row's bytes go; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices, table, written
from .suffixarray import suffix_array

LENGTH, PART, STEP = 50, 22, 4
#: Bytes of text whose cells a task takes at once, about; windows of a cell at most; starts taken at once in a text.
BUCKET_BYTES, CELL, SEGMENT = 8 << 20, 512, 1 << 20
#: Bytes of contents in one suffix array, about: further hashes go to the next one.
INDEX_BYTES = 1 << 14
#: Contents of a hash from which they are dealt by more than that hash.
HOT_CONTENTS = 4096
#: Rows of contents that a task looks at together, about.
BLOCK = 20_000

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, 1 << 16)
        _powers["up"] = np.cumprod(np.full(m, _BASE, np.uint64))
        _powers["down"] = np.cumprod(np.full(m, pow(_BASE, -1, 1 << 64), np.uint64))
    return _powers["up"][:n], _powers["down"][:n]


def cells(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(smallest hash, content's hash, first and last window) of the cells of a text, for each segment of it."""
    width = LENGTH - PART + 1
    for base in range(0, max(0, len(text) - LENGTH + 1), SEGMENT):
        b = np.frombuffer(text[base : base + SEGMENT + LENGTH - 1], np.uint8)
        n = len(b)
        up, down = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        x = mixed((sums[PART:] - sums[:-PART]) * down[: n - PART + 1])
        span = 1
        while span * 2 <= width:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        windows = n - LENGTH + 1
        least = np.minimum(x[:windows], x[width - span : width - span + windows])
        new = np.ones(windows, bool)
        new[1:] = least[1:] != least[:-1]
        start = np.flatnonzero(new)
        if (np.diff(start, append=windows) > CELL).any():
            run = np.repeat(start, np.diff(start, append=windows))
            start = np.flatnonzero((np.arange(windows) - run) % CELL == 0)
        end = np.append(start[1:], windows) - 1
        size = end - start + LENGTH
        content = mixed((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))
        yield least[start], content, start + base, end + base


def squeezed(n: int, *arrays: np.ndarray) -> bytes:
    """Arrays of n rows each, by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T.tobytes() for a in arrays))


def opened(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for k in kinds:
        w = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def dealt(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


#: Kinds of rows; HOT ones are asked, of a hash with over HOT_CONTENTS contents.
CELLS, COVERS, ASKED, HOT = range(4)
#: Columns of packed cells (hash, content's hash, place in the blob's table of documents, first window, size), of that table (doc_id, text's
#: check), and of packed covered windows.
CELL_KINDS, DOC_KINDS, COVER_KINDS = ("u8", "u8", "u4", "u4", "u2"), ("i8", "u4"), ("i8", "u4", "u4", "u4")
_PACKED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("blob", T.BinaryType())])


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], _PACKED.names)


def packed_covers(doc: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> Iterator[tuple]:
    part = dealt(doc, parts)
    order = np.lexsort((start, check, doc, part))
    part, doc, check, start, end = (x[order] for x in (part, doc, check, start, end))
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        n = int(z - a)
        yield COVERS, int(part[a]), n, squeezed(n, doc[a:z].astype("i8"), check[a:z].astype("u4"), start[a:z].astype("u4"), end[a:z].astype("u4"))


def first_cells(docs: DataFrame, parts: int) -> DataFrame:
    """Packed rows: the cells of each task's earliest document of each content, and the windows of the other cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=6 << 20):
                got = [(d, c, *x) for d, c, t in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), piece.column(1), strict=True) for x in cells(t.as_buffer().to_pybytes())]
                if not got:
                    continue
                sizes = [len(x[2]) for x in got]
                doc, check = np.repeat(np.array([x[0] for x in got], np.int64), sizes), np.repeat(np.array([x[1] for x in got], np.int64).astype(np.uint32), sizes)
                key, content, start, end = (np.concatenate([x[k] for x in got]) for k in (2, 3, 4, 5))
                part = (key % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((doc, content, key, part))
                part, key, content, doc, check, start, end = (x[order] for x in (part, key, content, doc, check, start, end))
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
                first = doc[new][np.cumsum(new) - 1] == doc
                rows = list(packed_covers(doc[~first], check[~first], start[~first], end[~first], parts))
                part, key, content, doc, check, start, end = (x[first] for x in (part, key, content, doc, check, start, end))
                edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    n = int(z - a)
                    # Of the hashes 44 bits and of contents' hashes 48 are sent; bytes decide in the end where contents differ.
                    high = key[a:z] >> np.uint64(20)
                    pairs, place = np.unique(np.stack([doc[a:z], check[a:z].astype(np.int64)], 1), axis=0, return_inverse=True)
                    own = squeezed(len(pairs), np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype("u4"))
                    blob = squeezed(n, np.diff(high, prepend=np.uint64(0)), content[a:z] >> np.uint64(16), place.reshape(-1).astype("u4"), start[a:z].astype("u4"), (end[a:z] - start[a:z]).astype("u2"))
                    rows.append((CELLS, int(part[a]), n, struct.pack("<II", len(pairs), len(own)) + own + blob))
                yield packed_batch(rows)

    return docs.transform(in_batches, run, _PACKED)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple[int, bytes]]]]:
    """((kind, part), its blobs) of packed rows that come sorted by kind and part."""

    def rows() -> Iterator[tuple[int, int, int, bytes]]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for k, own in groupby(rows(), key=lambda r: r[:2]):
        yield k, [r[2:] for r in own]


_MET = T.StructType(_PACKED.fields + [T.StructField("doc_id", T.LongType()), T.StructField("check", T.LongType()), T.StructField("key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def met(packed: DataFrame, parts: int, hot: int = HOT_CONTENTS) -> DataFrame:
    """Packed rows of covered windows, and rows (kind ASKED or HOT) of the cells whose content must be compared with others'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, part), blobs in gathered(batches):
            if kind == COVERS:
                yield whole([(COVERS, part, n, b) for n, b in blobs])
                continue
            opening = []
            for n, b in blobs:
                m, size = struct.unpack_from("<II", b)
                ids, checks = opened(b[8 : 8 + size], m, *DOC_KINDS)
                high, content, place, start, size = opened(b[8 + size :], n, *CELL_KINDS)
                opening.append((np.cumsum(high), content, ids[place], checks[place], start, size))
            key, content, doc, check, start, size = (np.concatenate(c) for c in zip(*opening, strict=True))
            order = np.lexsort((doc, content, key))
            key, content, doc, check, start, size = (x[order] for x in (key, content, doc, check, start, size))
            end = start + size
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= content[1:] != content[:-1]
            first = doc[new][np.cumsum(new) - 1] == doc
            rows = list(packed_covers(doc[~first], check[~first], start[~first], end[~first], parts))
            if rows:
                yield whole(rows)
            at, of = np.flatnonzero(new_key), np.cumsum(new_key) - 1
            several = (np.add.reduceat(new.astype(np.int64), at) > 1) & (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))
            ask = first & several[of]
            n = int(ask.sum())
            if n:
                name = (key[ask] << np.uint64(20) | np.uint64(part)).astype(np.int64)
                none = pa.nulls(n, pa.int32())
                many = np.add.reduceat(ask.astype(np.int64), at) > hot
                yield pa.RecordBatch.from_arrays([pa.array(np.where(many[of][ask], HOT, ASKED).astype(np.int32)), none, none, pa.nulls(n, pa.binary()), pa.array(doc[ask]), pa.array(check[ask].astype(np.int64)), pa.array(name), pa.array(start[ask].astype(np.int32)), pa.array(end[ask].astype(np.int32))], _MET.names)

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        b = packed_batch(rows)
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], _MET.names)

    return packed.repartition(parts, "kind", "part").sortWithinPartitions("kind", "part").transform(in_batches, run, _MET)


def repeats(groups: list[tuple[list[tuple[bytes, int]], list[int] | None]]) -> list[np.ndarray]:
    """For each content of each group in turn, which of its windows start in a content with a smaller doc_id, by one suffix
    array of all. A group is its contents (bytes, doc_id) and where their 22-byte part is: if each has it once, it is one symbol
    of the indexed text, of the group's own; if not (no places), contents are indexed as they are. Equal windows have equal hashes, so runs never span groups."""
    text: list[int] = []
    owner: list[int] = []
    left: list[int] = []
    docs, starts, span, out = [], [], [], []
    for g, (contents, places) in enumerate(groups):
        for k, (b, doc) in enumerate(contents):
            at = len(text)
            windows = len(b) - LENGTH + 1
            if places is None:
                text += b
                span.append(LENGTH)
            else:
                i = places[k]
                text += b[:i]
                text.append(257 + g)
                text += b[i + PART :]
                span.append(LENGTH - PART + 1)
            text.append(256)  # ends contents: no window crosses it
            n = len(text) - at
            owner += [len(docs)] * n
            left += [1] * windows + [0] * (n - windows)
            docs.append(doc)
            starts.append(at)
            out.append(np.zeros(windows, bool))
    run: list[int] = []
    window: list[int] = []

    def settle() -> None:
        least = min(docs[owner[i]] for i in run)
        for i in run:
            k = owner[i]
            if docs[k] > least:
                out[k][i - starts[k]] = True

    for i in suffix_array(text):
        if not left[i]:
            continue
        w = text[i : i + span[owner[i]]]
        if w == window:
            run.append(i)
        else:
            if len(run) > 1:
                settle()
            run, window = [i], w
    if len(run) > 1:
        settle()
    return out


def shared_sides(key: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many first bytes of its row of `side` (of which `size` count) each content shares with the likeliest other one of its key."""
    n, width = side.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = side
    order = np.lexsort((*wide.view(">u8").T[::-1], key))
    side, size, key = side[order], size[order], key[order]
    same = np.minimum(np.where((differs := side[1:] != side[:-1]).any(1), differs.argmax(1), width), np.minimum(size[1:], size[:-1]))
    same[key[1:] != key[:-1]] = 0
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(np.append(same, 0), np.insert(same, 0, 0))
    return out


def reaches(key: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each content of a key (equal keys are neighbours): where its 22-byte part starts, whether each content of the key has it once,
    and how many bytes before and after it another content of the key has too, if so."""
    n = np.fromiter(map(len, contents), np.int64, len(contents))
    first = np.cumsum(n) - n
    b = np.frombuffer(b"".join(contents), np.uint8)
    up, down = powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    x = np.append(mixed((sums[PART:] - sums[:-PART]) * down[: len(b) - PART + 1]), np.zeros(PART - 1, np.uint64))
    least = np.minimum.reduceat(x, np.stack([first, first + n - PART + 1], 1).ravel()[: 2 * len(n)])[::2]
    owner = np.repeat(np.arange(len(n)), n)
    hit = np.flatnonzero((x == least[owner]) & (np.arange(len(b)) <= (first + n - PART)[owner]))
    of, at, times = np.unique(owner[hit], return_index=True, return_counts=True)
    place = hit[at] - first
    new = np.append(True, key[1:] != key[:-1])
    once = np.minimum.reduceat(times == 1, np.flatnonzero(new))[np.cumsum(new) - 1]
    width = LENGTH - PART
    before, after = np.minimum(place, width), np.minimum(n - place - PART, width)
    steps, padded = np.arange(width), np.append(b, np.zeros(width, np.uint8))
    left = padded[np.maximum((first + place)[:, None] - 1 - steps, 0)] * (steps < before[:, None])
    right = padded[np.minimum((first + place)[:, None] + PART + steps, len(b))] * (steps < after[:, None])
    return place, once, shared_sides(key, left, before), shared_sides(key, right, after)


def classes(key: int, content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(key, start, bytes) of parts of a content, one for each STEP of its windows by how many bytes they have before the 22-byte part: all windows of
    a part have the same LENGTH - STEP + 1 bytes, and these make the part's key. Equal windows of two contents are in parts of one key, so a
    hash with very many contents is dealt to many tasks, and what contents have in common is there once."""
    b = np.frombuffer(content, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * up, out=sums[1:])
    x = mixed((sums[PART:] - sums[:-PART]) * down[: len(b) - PART + 1])
    for p in np.flatnonzero(x == x.min()).tolist():
        for before in range(0, LENGTH - PART + 1, STEP):
            least, most = max(0, p - min(before + STEP - 1, LENGTH - PART)), min(len(content), p - before + LENGTH)
            start, end = p - before, p - before - STEP + 1 + LENGTH
            if start >= 0 and end <= len(content) and most - least >= LENGTH:
                yield xxhash.xxh3_64_intdigest(content[start:end], key & _M ^ before) - (1 << 63), least, content[least:most]


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that come sorted by key, as tables of at least BLOCK rows (but the last) that don't cut a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column("key")
        if sum(b.num_rows for b in held) >= BLOCK:
            # What has the last key so far is held back.
            last = held[-1].column("key")[-1]
            at = int(np.searchsorted(key.to_numpy(), last.as_py(), "right"))
            if at < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
                held, batch = [], batch.slice(at)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def indexed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of the windows of contents, which come sorted by key, that contents of a smaller doc_id have too."""
    found: list[tuple[int, int, int, int]] = []
    held: list[tuple[list[tuple[bytes, int]], list[int] | None, list[tuple]]] = []
    size = 0

    def index() -> None:
        # Contents of several hashes share an index; equal windows have equal hashes, so runs never mix them.
        masks = iter(repeats([(contents, places) for contents, places, _ in held]))
        for contents, _, cells in held:
            for own in cells:
                m = next(masks)
                if m.any():
                    edge = np.flatnonzero(np.diff(m.astype(np.int8), prepend=0, append=0)).tolist()
                    found.extend((doc, check, start + a, start + z - 1) for doc, check, start in own for a, z in zip(edge[::2], edge[1::2], strict=True))

    for block in whole_keys(batches):
        key = block.column("key").to_numpy()
        place, once, before, after = reaches(key, block.column("content").to_pylist())
        keep = np.flatnonzero(~once | (before + after >= LENGTH - PART))
        rows = zip(*(c.to_pylist() for c in block.take(pa.array(keep)).columns), *(x[keep].tolist() for x in (place, once, before, after)), strict=True)
        for _, group in groupby(rows, key=lambda r: r[0]):
            # Each distinct content once: its bytes that others may share, its smallest document, and where it is.
            contents: dict[bytes, tuple[bytes, int, int, list[tuple]]] = {}
            for _, doc, check, start, b, p, one, l, r in group:
                skip = p - l if one else 0
                part = b[skip : p + PART + r] if one else b
                had = contents.setdefault(b, (part, l if one else -1, [], []))
                had[2].append(doc)
                had[3].append((doc, check, start + skip))
            for b, (part, _, docs, own) in contents.items():
                # A content that several documents have, as parts of contents may be: all of it goes from the later ones.
                least = min(docs)
                found += [(doc, check, start, start + len(part) - LENGTH) for doc, check, start in own if doc > least]
                own[:] = [x for x in own if x[0] == least]
            if len(contents) < 2 or len({min(x[2]) for x in contents.values()}) < 2:
                continue
            places = [x[1] for x in contents.values()]
            # Two parts may have one hash: bytes tell them apart.
            alone = places[0] >= 0 and len({x[0][x[1] : x[1] + PART] for x in contents.values()}) == 1
            held.append(([(x[0], min(x[2])) for x in contents.values()], places if alone else None, [x[3] for x in contents.values()]))
            size += sum(len(x[0]) for x in contents.values())
            if size >= INDEX_BYTES:
                index()
                held, size = [], 0
        if len(found) > 50_000:
            yield packed_batch(list(packed_covers(*(np.array(x, np.int64) for x in zip(*found, strict=True)), parts)))
            found.clear()
    if held:
        index()
    if found:
        yield packed_batch(list(packed_covers(*(np.array(x, np.int64) for x in zip(*found, strict=True)), parts)))


def compared(asked: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """Packed rows of the windows of `asked` cells that other contents of their hash repeat."""
    by_doc = asked.groupBy("doc_id", "check").agg(F.collect_list(F.struct("key", "start", "end", (F.col("kind") == HOT).alias("hot"))).alias("x"))
    both = docs.join(by_doc, ["doc_id", "check"]).select("doc_id", "check", "text", "x")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for d, c, t, xs in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2), piece.column(3).to_pylist(), strict=True):
                    t = t.as_buffer().to_pybytes()
                    for x in xs:
                        content = t[x["start"] : x["end"] + LENGTH]
                        if x["hot"]:
                            rows += [(key, d, c, x["start"] + at, part) for key, at, part in classes(x["key"], content)]
                        else:
                            rows.append((x["key"], d, c, x["start"], content))
                if not rows:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "doc_id", "check", "start", "content"])

    got = both.transform(in_batches, fetch, "key bigint, doc_id bigint, check bigint, start int, content binary")

    return got.repartition(parts, "key").sortWithinPartitions("key").transform(in_batches, lambda batches: indexed(batches, parts), _PACKED)


def removed(covers: DataFrame, parts: int) -> DataFrame:
    """(doc_id, check, spans): the bytes that go, as pairs of int64 (start, end), of each document that loses some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in gathered(batches):
            doc, check, start, end = (np.concatenate(c) for c in zip(*(opened(b, n, *COVER_KINDS) for n, b in blobs), strict=True))
            order = np.lexsort((start, check, doc))
            doc, check, start, end = doc[order], check[order], start[order].astype(np.int64), end[order].astype(np.int64) + LENGTH
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (check[1:] != check[:-1])
            at = np.cumsum(new) - 1
            lift = at << 40
            reach = np.maximum.accumulate(lift + end)
            opens = np.ones(len(doc), bool)
            opens[1:] = (lift + start)[1:] > reach[:-1]
            opens |= new
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(doc)) - 1
            spans = np.stack([start[first], reach[last] - lift[last]], 1).astype("<i8")
            edges = np.append(np.flatnonzero(np.diff(at[first], prepend=-1)), len(first))
            rows = [(int(doc[first[a]]), int(check[first[a]]), spans[a:z].tobytes()) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "check", "spans"])

    return covers.repartition(parts, "part").sortWithinPartitions("kind", "part").transform(in_batches, run, "doc_id bigint, check bigint, spans binary")


def kept(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(the bytes that stay, how many go, in how many runs)."""
    if not spans:
        return text, 0, 0
    s = np.frombuffer(spans, "<i8").reshape(-1, 2)
    out, at = [], 0
    for a, z in s.tolist():
        out.append(text[at:a])
        at = z
    out.append(text[at:])
    return b"".join(out), int((s[:, 1] - s[:, 0]).sum()), len(s)


def without_repeats(docs: DataFrame, hot: int = HOT_CONTENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is binary, as a cut may fall inside a character."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("check", F.crc32("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-total // BUCKET_BYTES))
    parts = min(parts, 1 << 20)
    long = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    told = written(met(first_cells(long, parts), parts, hot), "met")
    covers = told.where(F.col("kind") == COVERS).select(*_PACKED.names)
    more = compared(told.where(F.col("kind") >= ASKED), long, parts)
    spans = removed(covers.union(more), parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts = [t.as_buffer().to_pybytes() for t in piece.column(1)]
                left = [kept(t, s) for t, s in zip(texts, piece.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(map(len, texts), pa.int64()), pa.array([x[1] for x in left], pa.int64()), pa.array([x[2] for x in left], pa.int64()), pa.array([x[0] for x in left], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = docs.join(written(spans, "spans"), ["doc_id", "check"], "left").select("doc_id", "text", "spans")
    return out.transform(in_batches, cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumn("doc_id", F.col("doc_id").cast(kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
