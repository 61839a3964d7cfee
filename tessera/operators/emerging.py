"""Emerging topics: dense prevalence, pooling, state-space filtering, changepoints, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import bocpd_fold, empirical_logit, kalman_fold, logit_variance, rounded
from ..sources import adapt

Q, HAZARD, V0, LONGEST, SHORT, THETA = 0.01, 0.05, 1.0, 24, 3, 0.5


TOPIC, CHANNEL_TOPIC = ("topic",), ("channel", "topic")


def dense(spark: SparkSession, sf_dir: str, step: str, keys: tuple[str, ...] = TOPIC) -> DataFrame:
    """(keys, t, n, total): comments of each key, and of all topics together (of the channel, if that is a key), for each step of the calendar; none: 0."""
    x = adapt.lines(spark, sf_dir).groupBy(*keys, F.col(step).alias("t")).agg(F.count("*").alias("n"))
    calendar = x.agg(F.sequence(F.min("t"), F.max("t"), F.expr(f"interval 1 {step}")).alias("ts")).select(F.explode("ts").alias("t"))
    grid = x.select(*keys).distinct().join(F.broadcast(calendar))  # keys by steps: what the result has
    of = [*(k for k in keys if k != "topic"), "t"]
    total = x.groupBy(*of).agg(F.sum("n").alias("total"))
    return grid.join(x, [*keys, "t"], "left").join(total, of, "left").select(*keys, "t", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


def prevalence_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir, "week").select("topic", F.col("t").alias("week"), "n", "total", rounded(F.try_divide("n", "total")).alias("share"))


def prevalence_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir, "week", CHANNEL_TOPIC).select("channel", "topic", F.col("t").alias("week"), "n", "total", rounded(F.try_divide("n", "total")).alias("share"))


def channel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, topic, y, s2): logit of each topic's share in a channel, and its variance."""
    x = adapt.lines(spark, sf_dir).groupBy("channel", "topic").agg(F.count("*").alias("n"))
    x = x.withColumn("total", F.sum("n").over(Window.partitionBy("channel")))
    return x.select("channel", "topic", empirical_logit(F.col("n"), F.col("total")).alias("y"), logit_variance(F.col("n"), F.col("total")).alias("s2"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, mu, tau2) by DerSimonian and Laird, not under 0."""
    w = 1 / F.col("s2")
    x = channel_rates(spark, sf_dir).groupBy("topic").agg(
        F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("y") * F.col("y")).alias("wyy"), F.count("*").alias("k"))
    mu = F.col("wy") / F.col("w")
    spread = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")
    tau2 = F.greatest(F.lit(0.0), F.try_divide(spread - (F.col("k") - 1), F.col("w") - F.col("w2") / F.col("w")))
    return x.select("topic", mu.alias("mu"), F.coalesce(tau2, F.lit(0.0)).alias("tau2"))


def hier_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial pooling of each channel's rate with its topic's mean."""
    x = channel_rates(spark, sf_dir).join(moments(spark, sf_dir), "topic")
    b = F.col("s2") / (F.col("s2") + F.col("tau2"))
    return x.select("channel", "topic", rounded(b).alias("weight"), rounded(b * F.col("mu") + (1 - b) * F.col("y")).alias("pooled"))


def series(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = TOPIC, step: str = "month") -> DataFrame:
    """(keys, xs, mu): logits of the steps in order, and the topic's pooled prior mean."""
    x = dense(spark, sf_dir, step, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("t", empirical_logit(F.col("n"), F.col("total")).alias("y"), logit_variance(F.col("n"), F.col("total")).alias("r")))).alias("xs"))
    return x.join(moments(spark, sf_dir).select("topic", "mu"), "topic")


def filtered(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = TOPIC, step: str = "month") -> DataFrame:
    return series(spark, sf_dir, keys, step).select(*keys, kalman_fold(F.col("xs"), F.col("mu"), F.lit(V0), Q).alias("k"), F.element_at("xs", -1)["r"].alias("r"))


def kalman_level(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = TOPIC, step: str = "month") -> DataFrame:
    return filtered(spark, sf_dir, keys, step).select(*keys, rounded("k.m").alias("level"), rounded("k.p").alias("state_var"))


def forecast_var(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = TOPIC, step: str = "month") -> DataFrame:
    return filtered(spark, sf_dir, keys, step).select(*keys, rounded(F.col("k.p") + Q + F.col("r")).alias("forecast_var"))


def runs(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = TOPIC, step: str = "month") -> DataFrame:
    return series(spark, sf_dir, keys, step).select(*keys, "xs", bocpd_fold(F.col("xs"), HAZARD, F.col("mu"), V0, LONGEST).alias("b"))


def bocpd_shortrun(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = TOPIC, step: str = "month") -> DataFrame:
    """Probability that the current run is at most SHORT steps long, and the run length's entropy."""
    p = F.col("b.p")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    short = F.aggregate(F.slice(p, 1, SHORT + 1), F.lit(0.0), lambda a, x: a + x)
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return runs(spark, sf_dir, keys, step).select(*keys, rounded(short / total).alias("changepoint_p"), rounded(entropy).alias("entropy"))


def emerging_flag(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = TOPIC, step: str = "month") -> DataFrame:
    """Likely changed of late, and the level is rising (mean of the last three steps over that of the three before)."""
    last = lambda k: F.aggregate(F.slice("xs", -k, 3), F.lit(0.0), lambda a, x: a + x["y"]) / 3
    rise = runs(spark, sf_dir, keys, step).select(*keys, (last(3) - last(6)).alias("rise"))
    x = bocpd_shortrun(spark, sf_dir, keys, step).join(rise, list(keys))
    return x.select(*keys, "changepoint_p", rounded("rise").alias("rise"), ((F.col("changepoint_p") >= THETA) & (F.round("rise", 8) > 0)).alias("emerging"))


def alert_view(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = TOPIC, step: str = "month") -> DataFrame:
    return emerging_flag(spark, sf_dir, keys, step).join(forecast_var(spark, sf_dir, keys, step), list(keys)).select(*keys, "changepoint_p", "emerging", "forecast_var")


def kalman_level_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kalman_level(spark, sf_dir, CHANNEL_TOPIC, "week")


def forecast_var_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_var(spark, sf_dir, CHANNEL_TOPIC, "week")


def bocpd_shortrun_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bocpd_shortrun(spark, sf_dir, CHANNEL_TOPIC, "week")


def emerging_flag_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emerging_flag(spark, sf_dir, CHANNEL_TOPIC, "week")


def alert_view_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_view(spark, sf_dir, CHANNEL_TOPIC, "week")
