"""The growth engine: fusion of the components' results, explanations, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import rounded
from ..sources.tables import settled
from . import bridge, demand, growth

WEIGHTS = {"opportunity": 0.4, "gap": 0.3, "bridge": 0.3}


def ranked(df: DataFrame, component: str) -> DataFrame:
    """(channel, component, norm, confidence): scores as their share of channels that are not better. The component, a row a channel, is
    settled, so that the driver plans one at a time and not all as one query."""
    df = settled(df, component)
    w = Window.orderBy(F.round("score", 8))
    return df.select("channel", F.lit(component).alias("component"), F.percent_rank().over(w).alias("norm"), "confidence")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a channel and component that has a result for it; a missing one drops its weight."""
    o = ranked(growth.opportunity(spark, sf_dir).select("channel", "score", "confidence"), "opportunity")
    g = ranked(demand.gaps(spark, sf_dir).groupBy("channel").agg(F.sum("part").alias("score"), F.count("*").alias("k")).select("channel", "score", (F.col("k") / (F.col("k") + 2.0)).alias("confidence")), "gap")
    b = ranked(bridge.bridges(spark, sf_dir).select("channel", "score", "confidence"), "bridge")
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("component")]
    return o.unionByName(g).unionByName(b).withColumn("w", weight)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    wc = F.col("w") * F.col("confidence")
    return parts(spark, sf_dir).groupBy("channel").agg(
        F.try_divide(F.sum(wc * F.col("norm")), F.sum(wc)).alias("score"), (F.sum(wc) / F.sum("w") * (F.count("*") / len(WEIGHTS))).alias("confidence"))


def fusion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("channel", rounded("score").alias("score"), rounded("confidence").alias("confidence"))


def fusion_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component's part of the fused score; the parts sum to it."""
    wc = F.col("w") * F.col("confidence")
    x = parts(spark, sf_dir).withColumn("wc", wc).withColumn("total", F.sum("wc").over(Window.partitionBy("channel")))
    return x.select("channel", "component", rounded(F.try_divide(F.col("wc") * F.col("norm"), "total")).alias("part"))


def recommend_topk(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """The k strongest components of each channel as actions."""
    w = Window.partitionBy("channel").orderBy(F.col("part").desc(), "component")
    x = fusion_contributions(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    action = F.when(F.col("component") == "opportunity", "follow what similar channels do better").when(F.col("component") == "gap", "make content for unmet demand").otherwise("address the audience of bridge channels")
    return x.select("channel", "rank", F.concat(F.col("channel"), F.lit(": "), action).alias("recommendation"))
