"""Growth opportunities: indicators, labels, pooled learning, explanations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import rounded
from ..sources import adapt

AS_OF = "2001-11-05"
CUT = "1995-03-01"
FOLDS = ["1995-02-01", "1995-03-01", "1995-05-01"]
KAPPA, NEIGHBOURS = 5.0, 8
BLOCK = 16
#: A linear model of the indicators, for explanations in closed form.
BETA = {"views_per_day": 2.0, "likes_per_1000": -0.05, "comments_per_1000": 0.1}


def indicators_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, video, published, views, views_per_sub, views_per_day, likes_per_1000, comments_per_1000); null where a divisor is 0."""
    v = adapt.videos(spark, sf_dir)
    subs = adapt.comments(spark, sf_dir).groupBy("channel").agg(F.countDistinct("commenter").alias("subs"))
    age = F.greatest(F.lit(1), F.datediff(F.lit(AS_OF).cast("date"), "published"))
    return v.join(subs, "channel").select(
        "channel", "video", "published", "views", F.try_divide("views", "subs").alias("views_per_sub"), (F.col("views") / age).alias("views_per_day"),
        F.try_divide(F.lit(1000.0) * F.col("likes"), "views").alias("likes_per_1000"), F.try_divide(F.lit(1000.0) * F.col("comments"), "views").alias("comments_per_1000"))


def per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicators that need no commenters: no join with orders."""
    age = F.greatest(F.lit(1), F.datediff(F.lit(AS_OF).cast("date"), "published"))
    return adapt.videos(spark, sf_dir).withColumn("x", F.col("views") / age)


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = indicators_of(spark, sf_dir)
    return x.select("channel", "video", *(rounded(c).alias(c) for c in x.columns[4:]))


def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of a video: the mean of the channel's strictly earlier ones."""
    earlier = Window.partitionBy("channel").orderBy("published", "video").rowsBetween(Window.unboundedPreceding, -1)
    return per_day(spark, sf_dir).withColumn("baseline", F.avg("x").over(earlier))


def channel_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative(spark, sf_dir).select("channel", "video", rounded("baseline").alias("baseline"), rounded(F.try_divide("x", "baseline")).alias("relative"))


class BlockMean:
    """Mean of the values so far, added in the order in which the SQL's window adds them: 16 values to a block, 16 blocks to the next larger
    one and so on; a mean takes the largest full blocks first and single values last. A null holds a place and adds nothing."""

    def __init__(self):
        self.n = 0
        #: By size of block: those in the open larger one, their sum, and the sum of all before the next one.
        self.levels = [[0, 0.0, 0.0]]

    def add(self, x: float | None) -> None:
        self.n += x is not None
        node = 0.0 if x is None else x
        for i, level in enumerate(self.levels):
            level[0] += 1
            level[1] += node
            level[2] += node
            if level[0] < BLOCK:
                break
            node = level[1]
            level[:2] = 0, 0.0
            if i + 1 == len(self.levels):
                self.levels.append([0, 0.0, 0.0])
        for below in self.levels[:i]:
            below[2] = level[2]

    def mean(self) -> float | None:
        return self.levels[0][2] / self.n if self.n else None


def block_baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(channel, video, x, baseline) of (channel, video, x), a channel's rows in order and side by side."""
    channel, earlier = None, BlockMean()
    for batch in batches:
        baselines = []
        for c, x in zip(batch["channel"].to_pylist(), batch["x"].to_pylist(), strict=True):
            if c != channel:
                channel, earlier = c, BlockMean()
            baselines.append(earlier.mean())
            earlier.add(x)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(baselines, pa.float64())], [*batch.schema.names, "baseline"])


def label_above_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where x equals the mean of the earlier ones, rounding decides: so they are added in the SQL's order and not by a running sum."""
    x = per_day(spark, sf_dir).repartition("channel").sortWithinPartitions("channel", F.col("published").asc_nulls_last(), "video")
    b = x.select("channel", "video", "x").mapInArrow(block_baselines, "channel string, video bigint, x double, baseline double")
    return b.select("channel", "video", (F.col("x") > F.col("baseline")).alias("above"))


def label_top_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold is of videos published before CUT only."""
    x = per_day(spark, sf_dir)
    bar = x.where(F.col("published") < CUT).groupBy("channel").agg(F.percentile("x", F.lit(0.75)).alias("bar"))
    return x.join(bar, "channel", "left").select("channel", "video", (F.col("x") >= F.col("bar")).alias("top"), rounded("bar").alias("threshold"))


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds: videos before a cut train, those from it on test."""
    x = adapt.videos(spark, sf_dir).select("video", "published").withColumn("cut", F.explode(F.array(*(F.lit(c).cast("date") for c in FOLDS))))
    train = F.col("published") < F.col("cut")
    return x.groupBy("cut").agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.max(F.when(train, F.col("published"))).alias("last_train"), F.min(F.when(~train, F.col("published"))).alias("first_test"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, topic, p): the topics' shares of a channel's quantity, over sqrt of their squares' sum as u."""
    t = adapt.lines(spark, sf_dir).groupBy("channel", "topic").agg(F.sum("qty").alias("n"))
    w = Window.partitionBy("channel")
    return t.select("channel", "topic", (F.col("n") / F.sum("n").over(w)).alias("p"), (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(w))).alias("u"))


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, s) of all ordered pairs of channels that share a topic. Channels are a configured list, so pairs are bounded."""
    x = shares(spark, sf_dir).select("channel", "topic", "u")
    y = x.select(F.col("channel").alias("b"), "topic", F.col("u").alias("v"))
    return x.withColumnRenamed("channel", "a").join(y, "topic").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("s"))


def channel_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarities(spark, sf_dir).where("a < b").select("a", "b", rounded("s").alias("similarity"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.round("s", 8).desc(), "b")
    return similarities(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEIGHBOURS).drop("rank")


def channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_day(spark, sf_dir).groupBy("channel").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def pooled(spark: SparkSession, sf_dir: str, own: bool = True) -> DataFrame:
    """(channel, pooled, n_eff): mean over the channel's nearest ones (and itself, with similarity 1), weighted by similarity and size."""
    near = neighbours(spark, sf_dir)
    means = channel_means(spark, sf_dir)
    if own:
        near = near.union(means.select("channel", "channel", F.lit(1.0)))
    x = near.join(means, F.col("b") == F.col("channel"))
    sn = F.col("s") * F.col("n")
    return x.groupBy("a").agg(F.try_divide(F.sum(sn * F.col("mean")), F.sum(sn)).alias("pooled"), F.try_divide(F.sum("s") * F.sum("s"), F.sum(F.col("s") * F.col("s"))).alias("n_eff")).withColumnRenamed("a", "channel")


def pooled_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir).select("channel", rounded("pooled").alias("pooled"))


def confidence(n: Column) -> Column:
    return n / (n + KAPPA)


def confidence_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = confidence(F.col("n_eff"))
    return pooled(spark, sf_dir).select("channel", rounded(c).alias("confidence"), F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low").alias("level"))


def underperformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels under the similarity-weighted mean of their peers."""
    x = channel_means(spark, sf_dir).join(pooled(spark, sf_dir, own=False), "channel")
    return x.where(F.round("mean", 8) < F.round("pooled", 8)).select("channel", rounded("mean").alias("own"), rounded("pooled").alias("peers"), rounded(F.col("mean") - F.col("pooled")).alias("gap"))


def shap_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = indicators_of(spark, sf_dir).select("channel", "video", *BETA).na.fill(0.0, list(BETA))
    means = x.agg(*(F.avg(c).alias(f"m_{c}") for c in BETA))
    both = x.join(F.broadcast(means))  # one row
    return both.select("channel", "video", *((F.lit(b) * (F.col(c) - F.col(f"m_{c}"))).alias(c) for c, b in BETA.items()), sum((F.lit(b) * F.col(f"m_{c}") for c, b in BETA.items()), F.lit(0.0)).alias("base"))


def linear_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model's attributions: they sum, with the base, to the prediction."""
    s = shap_terms(spark, sf_dir)
    return s.select("video", *(rounded(c).alias(f"phi_{c}") for c in BETA), rounded("base").alias("base"), rounded(F.col("base") + sum((F.col(c) for c in BETA), F.lit(0.0))).alias("prediction"))


def opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, score, confidence, top_feature): what similar channels reach over the channel's own mean, relative to it."""
    s = shap_terms(spark, sf_dir).groupBy("channel").agg(*(F.avg(F.abs(c)).alias(c) for c in BETA))
    best = F.array_max(F.array(*(F.struct(rounded(c).alias("v"), F.lit(c).alias("k")) for c in BETA)))["k"]
    return (
        channel_means(spark, sf_dir).join(pooled(spark, sf_dir), "channel").join(s, "channel")
        .select("channel", F.try_divide(F.col("pooled") - F.col("mean"), "mean").alias("score"), confidence(F.col("n_eff")).alias("confidence"), best.alias("top_feature"))
    )


def opportunity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunity(spark, sf_dir).select("channel", rounded("score").alias("score"), rounded("confidence").alias("confidence"), "top_feature")
