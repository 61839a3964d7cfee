"""The corpus pipeline: language ID, line deduplication, near-duplicate removal, surrogates for personal data, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of `documents`; the last returns the pieces of the packed sequences. run() applies them in turn, each over the
written result of the one before. n_chars follows the text where a stage changes it.

Given results of every stage: an empty table gives no rows; other columns pass through, whatever their names; null texts are as
empty ones; texts are whole, however long. Near-duplicate removal keeps rows whose doc_id is null, which can't be told
apart from each other; rows that share a doc_id are told apart by their texts, and of rows that repeat both, one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import langid, linededup, packing, pii, simhash
from tessera.llm.common import table, written


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of `like`, n_chars (if it is there) counted anew."""
    return docs.select(*(F.coalesce(F.length("text"), F.lit(0)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in like.dtypes))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those like no language of the corpus; a null lang becomes the language found. Profiles are of
    all documents with a known language."""
    return langid.of_a_language(docs, langid.prototypes(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned lines go from the later documents; a document of which nothing is left goes."""
    out = linededup.dedup_lines(docs)
    return _counted(out.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != "")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id. Groups are those of
    op6_simhash, by its fingerprints and multi-index hashing, joined where sets of shingles of five words are similar from 0.8."""
    groups = simhash.similar_groups(docs, linked=True).where(F.col("stays") & F.col("doc_id").isNotNull())
    stays = written(groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "stays")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    kept = rows.join(stays.where("n = 1").drop("n"), ["doc_id", "text_hash"], "left_semi")
    none = rows.where(F.col("doc_id").isNull())
    several = rows.join(stays.where("n > 1").drop("n"), ["doc_id", "text_hash"], "left_semi")
    first = several.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("doc_id"))).where("nth = 1").drop("nth")
    return kept.union(none.select(*kept.columns)).union(first.select(*kept.columns)).select("row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates."""
    return _counted(pii.replaced(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack(packing.pieces(docs, packing.tokenizer_file()))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("private", private),
    ("packed", packed),
]

#: SQL expresses none of language ID by trained profiles, alignment, fingerprints of hashes or tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
