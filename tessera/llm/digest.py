"""Canonical exact digests of documents.

A text's canonical form is its NFKC form, case-folded and normalised again, with each run of white space as one space and
none at the ends. Its digest is the 128-bit XXH3 of the canonical form's UTF-8 bytes. Texts of one digest are compared byte for byte:
each task compares those it holds and passes on one for each distinct form; what tasks passed on for a digest that several
hold meets again, so a group of copies costs a row a task, however large it is. Where forms differ, all but the smallest get
a suffix (-1, -2, ...; in the order of the forms) in their fingerprint.

Likeness of digests is 1 or 0: equal or not. An edited text is compared with its own text and the next one where they meet.

Given results: null text is empty text; a null doc_id comes before all others; rows that repeat a doc_id follow each other in the order of their texts
(so for equal rows it doesn't matter which comes first); a single row is its own next document; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices, table, written

#: Bytes of text that one task takes in order, about; with over MOST_RANGES of them, more.
RANGE_BYTES, MOST_RANGES = 12 << 20, 20_000
#: Bits of the filter that finds the rows whose digest others share; its size is the same for any input.
FILTER_BITS = 1 << 23
#: Hex digits of a digest.
WIDTH = 32


def canonical(text: str) -> str:
    out = text.casefold()
    if not out.isascii():
        out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(out.split())


def form_of(text: str) -> bytes:
    return canonical(text).encode("utf-8", "surrogatepass")


def digest(form: bytes, width: int = WIDTH) -> str:
    return xxhash.xxh3_128_hexdigest(form)[:width]


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def bucket(bounds: list[int]) -> Column:
    """The number of bounds at or under doc_id, by binary search; 0 for a null doc_id."""
    if not bounds:
        return F.lit(0)
    mid = "cast((a.lo + a.hi) div 2 as int)"
    array = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    found = F.expr(
        f"aggregate(sequence(1, {len(bounds).bit_length() + 1}), struct(0 as lo, {len(bounds)} as hi), (a, i) -> case when a.lo >= a.hi then a "
        f"when {array}[{mid}] <= doc_id then struct({mid} + 1 as lo, a.hi as hi) else struct(a.lo as lo, {mid} as hi) end, a -> a.lo)"
    )
    return F.when(F.col("doc_id").isNull(), 0).otherwise(found)


def in_ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(bucket, extra, doc_id, text), dealt to tasks by ranges of doc_id and sorted; after each range comes, as an extra row,
    the first document of the next one (after the last: the first of all). Only the bounds and first ids of at most MOST_RANGES ranges come to the driver."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-total // range_bytes)))
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []
    dealt = docs.withColumn("bucket", bucket(bounds))
    firsts = dealt.groupBy("bucket").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("none")).orderBy("bucket").collect()
    ids = [(None if r["none"] else r["id"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(ids, T.StructType([T.StructField("head", docs.schema["doc_id"].dataType), T.StructField("to", T.IntegerType())]))
    # A row a range: small enough to broadcast at any size of the input.
    extra = dealt.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    rows = dealt.select("bucket", F.lit(False).alias("extra"), "doc_id", "text").union(extra.select("to", F.lit(True), "doc_id", "text"))
    return rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")


def digests(docs: DataFrame, range_bytes: int = RANGE_BYTES, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, d, sha, ed, same_edited, same_next): d and ed are the digests of each text and of
    its edited text, sha the canonical form's SHA-256; same_...: the canonical forms have the same bytes."""
    kinds = [docs.schema["doc_id"].dataType, T.LongType(), *[T.StringType()] * 4, *[T.BooleanType()] * 2]
    out = T.StructType([T.StructField(k, t) for k, t in zip(("doc_id", "n_chars", "edited_sha256", "d", "sha", "ed", "same_edited", "same_next"), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before
        for batch in batches:
            got: list[tuple] = []
            for at, extra, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                form = form_of(text)
                if held and held[0] == at:
                    _, own, before, its = held
                    e = edited(before, text)
                    changed = form_of(e)
                    got.append((own, len(before), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), digest(its, width), hashlib.sha256(its).hexdigest(), digest(changed, width), changed == its, form == its))
                held = None if extra else (at, doc, text, form)
            if got:
                types = [batch.column(2).type, pa.int64(), *[pa.string()] * 4, *[pa.bool_()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], out.names)

    return in_ranges(docs, range_bytes).transform(in_batches, run, out)


def colliding(docs: DataFrame, shared: DataFrame, width: int = WIDTH) -> DataFrame:
    """(d, sha, rank): the canonical forms, in order, of those digests in `shared` (column d) that have several. Each task drops forms
    of digests that aren't shared (by a filter of fixed size, then exactly), and compares its forms of a digest itself."""
    words = shared.select(F.pmod(F.xxhash64("d"), F.lit(FILTER_BITS)).alias("b")).select((F.col("b") / 32).cast("int").alias("w"), F.expr("shiftleft(1L, cast(b % 32 as int))").alias("v"))
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, v in words.groupBy("w").agg(F.bit_or("v").alias("v")).toLocalIterator():
        filled[w] = v
    mask = docs.sparkSession.sparkContext.broadcast(filled)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = dict.fromkeys(form_of(t or "") for t in part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([digest(f, width) for f in own], pa.string()), pa.array(list(own), pa.binary())], ["d", "form"])

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(0).to_numpy()
            yield batch.filter(pa.array((mask.value[b // 32] >> (b % 32).astype(np.uint32)) & 1 == 1)).select(["d", "form"])

    met = docs.select(F.col("text").cast("string").alias("text")).transform(in_batches, forms, "d string, form binary")
    met = met.select(F.pmod(F.xxhash64("d"), F.lit(FILTER_BITS)).alias("b"), "d", "form").transform(in_batches, sieve, "d string, form binary")
    # Binary values are ordered by their bytes: if a digest's smallest and largest form are equal, all are.
    several = written(met.groupBy("d").agg(F.min("form").alias("a"), F.max("form").alias("z")).where("a <> z").select("d"), "several")
    if several.isEmpty():
        return several.select("d", F.lit("").alias("sha"), F.lit(0).alias("rank"))
    each = met.join(several, "d", "left_semi").groupBy("d", "form").agg(F.lit(1).alias("one"))
    return each.select("d", F.sha2("form", 256).alias("sha"), (F.row_number().over(Window.partitionBy("d").orderBy("form")) - 1).alias("rank"))


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    base = written(digests(docs, range_bytes, width), "digests")
    other = written(colliding(docs, base.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d"), width), "collisions")
    fingerprint = F.col("d")
    if not other.isEmpty():
        base = base.join(other, ["d", "sha"], "left")
        fingerprint = F.when(F.col("rank") > 0, F.concat("d", F.lit("-"), "rank")).otherwise(F.col("d"))
    edited_fingerprint = F.when(F.col("same_edited"), fingerprint).when(F.col("ed") == F.col("d"), F.concat("ed", F.lit("-edited"))).otherwise(F.col("ed"))
    return base.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.alias("fingerprint"), edited_fingerprint.alias("edited_fingerprint"),
        F.col("same_edited").cast("double").alias("near_edited"), F.col("same_next").cast("double").alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
