"""Near-duplicate grouping by SimHash and multi-index hashing.

A fingerprint has 64 bits. Two fingerprints that differ in at most 3 bits differ in at most one bit of one of the two
32-bit segments, so each fingerprint looks up, in each segment's table, its own segment value and those one bit away, and
verifies the whole distance of what it meets. Of the two fingerprints of a link, only the one that lacks the differing
bit sets it, so a link is met from one side. Only distinct fingerprints enter, so copies cost nothing here.

Given results: null or empty text has no words and the fingerprint zero, linked like any other; rows that repeat a doc_id
or a text each get their row; a null doc_id keeps its row, and its component is the smallest non-null doc_id of its
component (null if there is none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, in_batches, table, written

DISTANCE = 3
#: Members of a segment value from which its bucket is split by the bytes of the other segment.
SPLIT_ABOVE = 2000


def fingerprint(text: bytes, words: int = 3) -> int:
    """A bit is 1 if set in over half of the XXH64 hashes (seed 42) of the shingles of `words` words."""
    ws = text.lower().split()  # of bytes: A-Z only, and white space is \x20 \x09-\x0D
    if not ws:
        return 0
    shingles = list(map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False))) if len(ws) >= words else [b" ".join(ws)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", F.col("text").cast("string")).transform(in_batches, run, T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())]))


def links(fps: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at distance 3 or less, from the distinct values in `fps` (column fp)."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    seg = F.explode(F.array(F.struct(F.lit(0).alias("s"), low.alias("k"), high.alias("o")), F.struct(F.lit(1).alias("s"), high.alias("k"), low.alias("o"))))
    rows = fps.select("fp", seg.alias("x")).select("fp", "x.s", "x.k", "x.o")
    # Segment values with many members: these buckets are split by each of the four bytes of the other segment; with at
    # most 3 differing bits there, one byte is equal.
    hot = written(rows.groupBy("s", "k").agg(F.count("*").alias("n")).where(F.col("n") > split_above).select("s", "k"), "hot")
    spread = F.expr("explode(transform(sequence(0, 3), j -> named_struct('j', j, 'byte', shiftrightunsigned(o, 8 * j) & 255)))")

    def keyed(df: DataFrame) -> DataFrame:
        if hot.isEmpty():
            return df.withColumns({"j": F.lit(-1), "byte": F.lit(0).cast("long")})
        marked = df.join(hot.withColumn("hot", F.lit(True)), ["s", "k"], "left")
        plain = marked.where("hot is null").withColumns({"j": F.lit(-1), "byte": F.lit(0).cast("long")})
        deep = marked.where("hot").select("*", spread.alias("y")).select(*marked.columns, "y.j", "y.byte")
        return plain.unionByName(deep).drop("hot")

    ball = F.expr("explode(concat(array(k), transform(filter(sequence(0, 31), i -> shiftrightunsigned(k, i) & 1 = 0), i -> k | shiftleft(1L, i))))")
    probes = keyed(rows.select("fp", "s", "o", ball.alias("k"))).select(F.col("fp").alias("a"), "s", "k", "j", "byte")
    members = keyed(rows).select(F.col("fp").alias("b"), "s", "k", "j", "byte")
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return probes.join(members, ["s", "k", "j", "byte"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(doc_id, fp, component_id, group_size): component_id is the smallest doc_id reachable through links."""
    fps = written(fingerprints(docs, words), "fps")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    # The roots of components of fingerprints are fingerprints; a group's smallest doc_id is found after.
    nodes = components(links(distinct.select("fp"), split_above))
    linked = nodes.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("group_size"))
    by_fp = written(distinct.join(nodes.join(linked, "root").select(F.col("node").alias("fp"), "component_id", "group_size"), "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("group_size", "n").alias("group_size")), "groups")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id", "group_size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: For groups by similarity: bands of a text's minima, and minima in each. Texts with a Jaccard similarity of 0.8 share a
#: band with a chance of 1 - (1 - 0.8 ** 7) ** 50, over 0.99999.
BANDS, MINIMA = 50, 7
_ODD = np.random.default_rng(42).integers(0, 1 << 32, BANDS * MINIMA, np.uint32) | np.uint32(1)
_BAND = np.random.default_rng(43).integers(0, 1 << 63, (BANDS, MINIMA), np.uint64) | np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The text's shingles of `words` words, as 32-bit hashes in rising order."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint32)
    shingles = list(map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False))) if len(ws) >= words else [b" ".join(ws)]
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, shingles, repeat(42)), np.uint32, len(shingles)))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the set's minima under permutations."""
    least = np.full(BANDS * MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1 << 11):
        np.minimum(least, (_ODD[:, None] * shingles[at : at + (1 << 11)]).min(1), out=least)
    x = ((least.reshape(BANDS, MINIMA).astype(np.uint64) + np.uint64(1)) * _BAND).sum(1, dtype=np.uint64)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, na, nb): how many shingles each pair's sets (id, hs) share, and how many each has."""
    sized = sets.select("id", "hs", (F.length("hs") / 4).cast("long").alias("n"))
    # a may be one set for very many pairs: it is looked up last, so that its copies aren't moved again.
    both = pairs.join(sized.toDF("b", "hb", "nb"), "b").join(sized.toDF("a", "ha", "na"), "a").select("a", "b", "na", "nb", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), assume_unique=True))
                for x, y in zip(batch.column(4), batch.column(5), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), *batch.columns[2:4]], ["a", "b", "shared", "na", "nb"])

    return both.transform(in_batches, run, "a bigint, b bigint, shared bigint, na bigint, nb bigint")


def added(sets: DataFrame, family: DataFrame) -> DataFrame:
    """(pivot, id, q): the shingles q that each member has beside its pivot's."""
    both = family.select("pivot", "id").join(sets.select("id", "hs"), "id").join(sets.toDF("pivot", "hp"), "pivot").select("pivot", "id", "hs", "hp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [np.setdiff1d(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(p.as_buffer(), np.uint32), assume_unique=True) for x, p in zip(part.column(2), part.column(3), strict=True)]
                of = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(np.concatenate(own).astype(np.int64))], ["pivot", "id", "q"])

    return both.transform(in_batches, run, "pivot bigint, id bigint, q bigint")


def firsts(sets: DataFrame, family: DataFrame, similarity: float) -> DataFrame:
    """`family` with a row for each shingle q that a member has beside its pivot's and that may be the first which it shares with a
    member of a similarity of `similarity`, the rarest of the pivot's members coming first; `left` is how many more such there are, itself counted.

    A member lacks ceil(similarity * n) - shared shingles at least to be that similar to any other. So many must be shared beside
    the pivot's, so the last so many but one can't be the first."""
    own = written(added(sets, family), "own")
    common = own.groupBy("pivot", "q").agg(F.count("*").alias("f")).where("f > 1")
    each = Window.partitionBy("pivot", "id")
    ranked = own.join(common, ["pivot", "q"]).withColumns({"k": F.row_number().over(each.orderBy("f", "q")), "m": F.count("*").over(each)})
    lacks = F.greatest(F.ceil(F.lit(similarity) * F.col("n") - 1e-9) - F.col("shared"), F.lit(1))
    ranked = ranked.select("pivot", "id", "q", "k", (F.col("m") - F.col("k") + 1).alias("left"))
    return written(ranked.join(family, ["pivot", "id"]).where(F.col("left") >= lacks).select(*family.columns, "q", "left"), "firsts")


def unmet(sets: DataFrame, family: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of a pivot's members in different groups (root) that may have a similarity of `similarity`; none other can.

    Two sets of sizes m and n need s / (1 + s) * (m + n) shingles in common. What they share lies in the pivot's set, of
    which neither shares more than it has, or beside it. So either what the lesser has of the pivot is enough, or they share a
    shingle beside the pivot's. Of two groups, one is not the pivot's own, which keeps that from being compared with itself."""
    ratio = similarity / (1 + similarity)

    def pairs(rows: DataFrame, key: list[str], reach) -> DataFrame:
        a, b = (rows.select(*key, *(F.col(c).alias(f"{c}_{x}") for c in rows.columns if c not in key)) for x in "ab")
        met = a.where(~F.col("main_a")).join(b, key).where((F.col("root_a") != F.col("root_b")) & (F.col("main_b") | (F.col("id_a") < F.col("id_b"))))
        return met.where(reach >= ratio * (F.col("n_a") + F.col("n_b")) - 1e-6).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))

    of_pivot = F.least("shared_a", "shared_b")
    within = pairs(family.where(F.col("shared") >= similarity * F.col("n") - 1e-6), ["pivot"], of_pivot)
    beside = pairs(firsts(sets, family, similarity), ["pivot", "q"], of_pivot + F.least("left_a", "left_b"))
    return within.union(beside).distinct()


def linked_sets(fps: DataFrame) -> DataFrame:
    """(a, b): sets of shingles (id) whose texts' fingerprints (fp) are equal or link, each fingerprint by the first of its sets."""
    of = written(fps.select("fp", "id").distinct(), "of")
    node = written(of.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    same = of.join(node, "fp").select(F.col("node").alias("a"), F.col("id").alias("b"))
    near = links(node.select("fp")).join(node.toDF("a", "x"), "a").join(node.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    out = written(same.union(near).where("a <> b").distinct(), "linked")
    discard(of, node)
    return out


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, linked: bool = False) -> DataFrame:
    """(doc_id, text_hash, component_id, stays) of each row: groups of texts whose sets of shingles of `words` words have a
    Jaccard similarity of `similarity` or more, directly or through others. component_id is the group's smallest doc_id;
    `stays` holds for the rows of one text of it, that of the smallest (doc_id, text_hash); text_hash is Spark's xxhash64.

    Texts that share a band of minima are candidates, and the similarity of sets decides. Members of a band's bucket are
    compared with one of them, its pivot: the member that meets most others. So a bucket costs a row a member however many
    copies it has. Members that this leaves in different groups are compared with each other where what they have
    of the pivot and beside it doesn't rule the similarity out (`unmet`), so that every pair of a bucket is covered.
    `linked`: texts whose fingerprints link (`links`: at 3 bits, by multi-index hashing) are of one group too.

    Null text is empty; all texts without words are one group. A row whose doc_id is null is in no group: its component_id is
    null and it stays. Rows that share a doc_id are told apart by their texts."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(2)]
            ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            keys = np.concatenate([np.zeros(0, np.int64), *map(bands, sets)])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
            fp = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") if linked else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.int64()), keys, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(fp, pa.int64())], out.names)

    out = T.StructType([T.StructField("doc_id", kind), T.StructField("th", T.LongType()), T.StructField("id", T.LongType()), T.StructField("ks", T.ArrayType(T.LongType())), T.StructField("hs", T.BinaryType()), T.StructField("fp", T.LongType())])
    text = F.col("text").cast("string")
    hashed = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    fps = written(hashed.where(F.col("doc_id").isNotNull()).transform(in_batches, run, out), "fps")
    one = written(fps.groupBy("id").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("ks").alias("ks")), "one")
    members = one.select("id", F.explode("ks").alias("k"))
    buckets = written(members.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = written(members.join(buckets, "k").select("k", "id", "n"), "met")
    degrees = met.groupBy("id").agg(F.sum("n").alias("d"))
    pivots = written(met.join(degrees, "id").groupBy("k").agg(F.max(F.struct("d", "id")).alias("p")).select("k", F.col("p.id").alias("pivot")), "pivots")
    pairs = written(met.join(pivots, "k").where("id <> pivot").select("pivot", "id").distinct(), "pairs")
    discard(buckets, met, pivots)
    needed = pairs.select(F.explode(F.array("pivot", "id")).alias("id")).distinct().join(one, "id").select("id", "rep.doc_id", "rep.th")
    sets = written(fps.join(needed, ["id", "doc_id", "th"], "left_semi").select("id", "hs").dropDuplicates(["id"]), "sets")
    alike = F.col("shared") >= similarity * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9
    like = written(overlaps(sets, pairs.toDF("a", "b")), "like")
    edges = like.where(alike).select("a", "b")
    if linked:
        edges = edges.union(by_fp := linked_sets(fps))
    roots = components(edges)
    of = like.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "shared", F.col("nb").alias("n"))
    of = of.join(roots.toDF("id", "root"), "id", "left").join(roots.toDF("pivot", "own"), "pivot", "left")
    of = of.withColumn("root", F.coalesce("root", "id")).withColumn("main", F.col("root") == F.coalesce("own", "pivot")).drop("own")
    mixed = of.groupBy("pivot").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("pivot")
    family = written(of.join(mixed, "pivot", "left_semi"), "family")
    if not family.isEmpty():
        left = written(unmet(sets, family, similarity), "left")
        more = written(overlaps(sets, left).where(alike).select("a", "b"), "more")
        if not more.isEmpty():
            roots = components(edges.union(more))
        discard(left, more)
    reps = one.select("id", "rep")
    grouped = roots.join(reps.withColumnRenamed("id", "node"), "node").select("node", "root", "rep")
    stays = grouped.groupBy("root").agg(F.min("rep").alias("first"))
    first = written(reps.join(grouped.join(stays, "root").select(F.col("node").alias("id"), "first"), "id", "left").select("id", F.coalesce("first", "rep").alias("first")), "groups")
    discard(one, pairs, sets, like, family, *([by_fp] if linked else []))
    found = fps.select("doc_id", "th", "id").join(first, "id").select("doc_id", F.col("th").alias("text_hash"), F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "th") == F.col("first")).alias("stays"))
    return found.unionByName(hashed.where(F.col("doc_id").isNull()).select("doc_id", F.col("th").alias("text_hash"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))
