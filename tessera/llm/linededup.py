"""Line deduplication by pairwise alignment of overlapping documents.

Each long line (MIN_CHARS characters or more, without white space at its ends) is known by a 128-bit hash and by which
occurrence in its document it is; so are the runs of lines, as short as reach MIN_CHARS, that begin or end at a short
line (single short lines are too common to say that documents overlap). Of each such line the first document that holds it, by doc_id, is the partner of every
later one that does: a star, so there is a row for each occurrence however many documents share a line. Lines that this
leaves have the next document that holds them as partner, and so on; after PASSES such passes, all earlier holders of
what is still left are partners at once, so that no pair of documents with such lines is left out. Each pair of documents is
aligned by patience diff: lines that are unique in both anchor the longest run that keeps both orders (rare lines first),
and repeated lines join it where they fit between anchors. The aligned lines go from the later document, with the short
lines that follow one if the same follow it in the earlier document.

Given results: null or empty text stays as it is; a row with null doc_id is neither searched nor changed; rows that share a
doc_id are one document and are not compared with each other (a repeated row is changed as its copy is); a document whose lines
all go has empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, table, written

MIN_CHARS = 25
#: Passes with one partner a line; the next has all that are left.
PASSES = 4


#: Kinds of units, in the order in which they are at one line: a run that begins there, the line itself, a run that ends there.
BEGINS, LINE, ENDS = range(3)


def line_units(text: str, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, int, int, bool, int, int, int]]:
    """(hash, hash, occurrence, unique in the text, three times its line and its kind, lines that go with it, their hash) of each unit.

    A long line is a unit, with the short lines after it. A short line begins and ends a run of non-empty lines that together have
    min_chars characters, no longer than needed; these runs are units. A text without so many characters is one unit."""
    lines = [x.strip() for x in text.split("\n")]
    full = [i for i, x in enumerate(lines) if x]
    long = [i for i in full if len(lines[i]) >= min_chars]
    units: list[tuple[int, str, int, int]] = []
    for i, end in zip(long, [*long, len(lines)][1:], strict=True):
        n = end - i - 1
        fill = xxhash.xxh3_64_intdigest("\n".join(lines[i + 1 : end]).encode("utf-8", "surrogatepass")) if n else 0
        units.append((3 * i + LINE, lines[i], n, fill))
    if full and sum(len(lines[i]) for i in full) < min_chars:
        units.append((3 * full[0] + BEGINS, "\n".join(["whole", *(lines[i] for i in full)]), full[-1] - full[0], 0))
    elif len(long) < len(full):
        for kind, name, step in ((BEGINS, "begins", 1), (ENDS, "ends", -1)):
            for k, i in enumerate(full):
                if len(lines[i]) >= min_chars:
                    continue
                size, j = 0, k
                while 0 <= j < len(full) and size < min_chars:
                    size += len(lines[full[j]])
                    j += step
                if size >= min_chars:
                    run = full[k:j] if step > 0 else full[j + 1 : k + 1]
                    units.append((3 * i + kind, "\n".join([name, *(lines[x] for x in run)]), run[-1] - run[0], 0))
    units.sort()
    counts, seen = Counter(u[1] for u in units), Counter()
    for at, what, n, fill in units:
        h = xxhash.xxh3_128_intdigest(what.encode("utf-8", "surrogatepass"))
        yield (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), seen[what], counts[what] == 1, at, n, fill - (1 << 63)
        seen[what] += 1


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, in order of their first, whose second rises (patience sorting)."""
    tails, at, before = [], [], []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def aligned(pairs: list[tuple[int, int, bool]]) -> list[int]:
    """Lines of the later document that patience diff aligns. pairs: its line, the earlier document's, whether unique in both."""
    if len(pairs) == 1:
        return [pairs[0][0]]
    pairs = sorted(pairs)
    anchors = rising([(x, y) for x, y, unique in pairs if unique])
    out, rest, k = [], [(x, y) for x, y, unique in pairs if not unique], 0
    low = (-1, -1)
    for high in [*anchors, (1 << 62, 1 << 62)]:
        gap = []
        while k < len(rest) and rest[k][0] < high[0]:
            if low[1] < rest[k][1] < high[1]:
                gap.append(rest[k])
            k += 1
        out += [x for x, _ in rising(gap)]
        out.append(high[0])
        low = high
    return out[:-1]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (ends included) in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and out[-1][1] >= s - 1:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def extent(at: int, n: int) -> tuple[int, int]:
    """The lines that go with an aligned unit."""
    line, kind = divmod(at, 3)
    return (line - n, line) if kind == ENDS else (line, line + n)


def covered(at: int, ranges: list[tuple[int, int]]) -> bool:
    """Whether the unit's line is in one of the ranges."""
    k = bisect_right(ranges, (at // 3, 1 << 62)) - 1
    return k >= 0 and at // 3 <= ranges[k][1]


def filled() -> Column:
    """How many lines go with a unit that both documents hold."""
    return F.when((F.col("at") % 3 != LINE) | (F.col("n") == F.col("p.n")) & (F.col("fill") == F.col("p.fill")), F.col("n")).otherwise(0)


def blocks(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, blocks): the ranges of lines (from 0, ends included) that go from each document that loses some."""
    kind = docs.schema["doc_id"].dataType
    unit = T.StructType([T.StructField("doc_id", kind), T.StructField("th", T.LongType()), *(T.StructField(k, T.LongType()) for k in ("h1", "h2")), T.StructField("k", T.IntegerType()), T.StructField("u", T.BooleanType()), *(T.StructField(k, T.IntegerType()) for k in ("at", "n")), T.StructField("fill", T.LongType())])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, columns = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                rows = list(line_units(t, min_chars))
                of += [i] * len(rows)
                columns += rows
            cols = list(zip(*columns, strict=True)) or [()] * 7
            of = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()), strict=True))], unit.names)

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).transform(in_batches, units, unit)
    rows = written(rows, "lines")
    key = ["h1", "h2", "k"]
    first = rows.groupBy(key).agg(F.min(F.struct("doc_id", "at", "u", "n", "fill")).alias("p"), F.max("doc_id").alias("last"))
    # Written, so that a line that very many documents hold can be split where it is joined: Spark splits what comes from a plain shuffle.
    first = written(first.where(F.col("p.doc_id") != F.col("last")).drop("last"), "first")
    met = rows.join(first, key).where(F.col("doc_id") > F.col("p.doc_id"))
    cut = T.StructType([T.StructField("doc_id", kind), T.StructField("text_hash", T.LongType()), T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))), T.StructField("left", T.ArrayType(T.IntegerType()))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, left = [], []
            for xs in batch.column(2).to_pylist():
                by: dict[object, dict[int, tuple[int, bool, int]]] = {}
                for x in xs:
                    of = by.setdefault(x["p"], {})
                    of[x["at"]] = min(of.get(x["at"], (1 << 62,)), (x["pat"], x["u"], x["n"]))
                ranges = merged([extent(i, of[i][2]) for of in by.values() for i in aligned([(at, pat, u) for at, (pat, u, _) in of.items()])])
                out.append([{"s": s, "e": e} for s, e in ranges])
                left.append([i for i in sorted({x["at"] for x in xs}) if not covered(i, ranges)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(left, pa.list_(pa.int32()))], cut.names)

    def cuts(met: DataFrame) -> DataFrame:
        """The aligned blocks of each document with its partners, and the lines that stay: met has the document's lines with `p`, the partner's."""
        found = F.struct(F.col("p.doc_id").alias("p"), "at", F.col("p.at").alias("pat"), (F.col("u") & F.col("p.u")).alias("u"), filled().alias("n"))
        return written(met.groupBy("doc_id", "th").agg(F.collect_list(found).alias("x")).transform(in_batches, align, cut), "cuts")

    passes = [cuts(met)]
    # Lines that were not aligned with their partner: the next document that holds them is the partner, in which all lines
    # that both hold take part. After some passes all earlier holders of what is still left are partners at once.
    left = passes[0].select("doc_id", F.col("text_hash").alias("th"), F.explode("left").alias("at"))
    tried = first.select(*key, F.col("p.doc_id").alias("tried"))
    left = written(left.join(rows, ["doc_id", "th", "at"]).select("doc_id", "th", "at", *key).join(tried, key), "left")
    while not left.isEmpty():
        holders = rows.select(*key, F.col("doc_id").alias("p")).join(left.groupBy(key).agg(F.max("tried").alias("tried"), F.max("doc_id").alias("last")), key).where((F.col("p") > F.col("tried")) & (F.col("p") < F.col("last")))
        holders = holders.groupBy(key).agg(F.min("p").alias("p")) if len(passes) < PASSES else holders.select(*key, "p").distinct()
        now = written(left.drop("tried").join(holders, key).where(F.col("doc_id") > F.col("p")), "now")
        pairs = now.select("doc_id", "th", "p").distinct()
        theirs = rows.select(*key, F.struct("doc_id", "at", "u", "n", "fill").alias("p"), F.col("doc_id").alias("of"))
        both = pairs.withColumnRenamed("p", "of").join(rows, ["doc_id", "th"]).join(theirs, ["of", *key])
        passes.append(cuts(both))
        if len(passes) > PASSES:
            break
        still = passes[-1].select("doc_id", F.col("text_hash").alias("th"), F.explode("left").alias("at"))
        left = written(now.withColumnRenamed("p", "tried").join(still, ["doc_id", "th", "at"], "left_semi"), "left")
    if len(passes) == 1:
        return passes[0].drop("left")
    every = passes[0]
    for more in passes[1:]:
        every = every.union(more)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"s": s, "e": e} for s, e in merged([(x["s"], x["e"]) for x in xs])] for xs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["doc_id", "text_hash", "blocks"])

    return every.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("blocks")).alias("blocks")).transform(in_batches, merge, T.StructType(cut.fields[:3]))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the aligned lines taken out of text, and the columns n_lines and n_removed (lines), which take the place of columns of these names."""
    cut = written(blocks(docs, min_chars).toDF("id", "th", "blocks"), "blocks")
    # The row is one column until the end, so that no other column's name can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    both = rows.join(cut, ["id", "th"], "left")
    text = F.col("row.text")
    kept = F.expr("array_join(filter(split(row.text, '\\n', -1), (x, i) -> not exists(blocks, b -> i between b.s and b.e)), '\\n')")
    return both.select(
        *(F.when(F.col("blocks").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("blocks", F.lit(0), lambda a, b: a + b["e"] - b["s"] + 1), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")
