"""Stand-ins of the media entities in the test tables. Only this module knows them.

channel: brand; video: part, published with its first shipment; topic: part type; commenter: customer; weekly snapshots:
shipments by week; views: quantity; likes: lines with return flag R; comments: lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, topic, video, orderkey, qty, flag, day, week, month), a row a comment."""
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", "l_returnflag", F.col("l_shipdate").cast("date").alias("day"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("channel"), F.col("p_type").alias("topic"), F.col("l_partkey").alias("video"), F.col("l_orderkey").alias("orderkey"),
        F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), "day",
        F.date_trunc("week", "day").cast("date").alias("week"), F.date_trunc("month", "day").cast("date").alias("month"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines with the commenter's key."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("commenter"))
    return lines(spark, sf_dir).join(orders, F.col("orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, video, published, views, likes, comments)."""
    return lines(spark, sf_dir).groupBy("channel", "video").agg(
        F.min("day").alias("published"), F.sum("qty").alias("views"), F.count_if(F.col("flag") == "R").alias("likes"), F.count("*").alias("comments"))
