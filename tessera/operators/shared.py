"""Shared data layer: snapshots, hashing, retention, restriction, checks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read

#: For fixtures only: a salt in an expression is readable in the plan's text. Real ones go through hashed_ids().
FIXTURE_SALT = "fixture-salt"
CHANNELS = ["Brand#1", "Brand#12", "Brand#17", "Brand#23", "Brand#5"]
AS_OF, KEEP_DAYS = "2024-02-10", 30


def newest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The newest row of each key: the largest `order`, then the largest values. A max of structs, so tasks combine before the shuffle."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("x"))
    return best.select(*keys, *(F.col(f"x.{c}").alias(c) for c in [*order, *values]))


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("video"), F.date_trunc("week", "l_shipdate").cast("date").alias("snapshot_week"), F.col("l_shipdate").cast("date").alias("observed_on"),
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("long").alias("linenumber"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return newest(line, ["video", "snapshot_week"], ["observed_on"], ["orderkey", "linenumber", "suppkey", "quantity", "price"])


def hashed(c: Column, salt: str = FIXTURE_SALT) -> Column:
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def hashed_ids(df: DataFrame, column: str, salt: str) -> DataFrame:
    """df with the column's salted SHA-256 in its place; the salt is in no plan or event log."""
    secret = df.sparkSession.sparkContext.broadcast(salt)

    @F.pandas_udf("string")
    def one(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else hashlib.sha256(f"{secret.value}{x}".encode()).hexdigest())

    return df.withColumn(column, one(F.col(column).cast("string")))


def commenter_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By market segment: commenters, and a sum over their hashes. No hash leaves."""
    h = hashed(F.col("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_mktsegment", h.alias("h")).groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.countDistinct("h").alias("n_commenters"), F.sum(F.conv(F.substring("h", 1, 8), 16, 10).cast("long")).alias("check_sum"))


def retained(df: DataFrame, ts: str, as_of: str = AS_OF, days: int = KEEP_DAYS) -> DataFrame:
    return df.where(F.col(ts) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def retention_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(read(spark, sf_dir, "events"), "ts").select("event_id", "event_type", rounded_value())


def rounded_value() -> Column:
    return F.round("value", 8).alias("value")


def channel_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of the configured channels. The configuration is a list in the program."""
    wanted = spark.createDataFrame([(c,) for c in CHANNELS], "channel string")
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("channel"), F.col("p_partkey").alias("video"), F.col("p_type").alias("topic"))
    return part.join(F.broadcast(wanted), "channel", "left_semi")


def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    def orphans(what: str, child: str, key: str, parent: str, to: str) -> DataFrame:
        c = read(spark, sf_dir, child).select(F.col(key).alias("k"))
        p = read(spark, sf_dir, parent).select(F.col(to).alias("k"))
        return c.join(p, "k", "left_anti").agg(F.lit(what).alias("reference"), F.count("*").alias("n_orphans"), F.count_if(F.col("k").isNull()).alias("n_null"))

    return (
        orphans("lineitem-orders", "lineitem", "l_orderkey", "orders", "o_orderkey")
        .union(orphans("lineitem-part", "lineitem", "l_partkey", "part", "p_partkey"))
        .union(orphans("orders-customer", "orders", "o_custkey", "customer", "c_custkey"))
        .union(orphans("labels-documents", "labels", "doc_id", "documents", "doc_id"))
    )
