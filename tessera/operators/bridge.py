"""Audience bridges: the graph, diffusion, similarity, scores, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import rounded
from ..sources import adapt
from ..sources.tables import settled
from . import growth

TARGET, ALPHA, STEPS, TOP = "Brand#12", 0.85, 6, 10
KAPPA, LAMBDA = 50.0, 0.5


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_type, src, dst, w): comments, uploads and topics, both ways. Commenters are salted hashes already."""
    from .shared import hashed

    c = adapt.comments(spark, sf_dir)
    made = c.groupBy(F.concat(F.lit("u:"), hashed(F.col("commenter"))).alias("src"), F.concat(F.lit("v:"), "video").alias("dst")).agg(F.count("*").cast("double").alias("w")).select(F.lit("commented").alias("edge_type"), "src", "dst", "w")
    v = adapt.lines(spark, sf_dir).select("channel", "video", "topic").distinct()
    up = v.select(F.lit("uploaded").alias("edge_type"), F.concat(F.lit("v:"), "video").alias("src"), F.concat(F.lit("c:"), "channel").alias("dst"), F.lit(1.0).alias("w"))
    about = v.groupBy("channel", "topic").agg(F.count("*").cast("double").alias("w")).select(F.lit("covers").alias("edge_type"), F.concat(F.lit("c:"), "channel").alias("src"), F.concat(F.lit("t:"), "topic").alias("dst"), "w")
    return made.unionByName(up).unionByName(about)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("edge_type").agg(F.count("*").alias("n_edges"), F.sum("w").alias("weight"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


def audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, commenter, w), a row a pair."""
    return adapt.comments(spark, sf_dir).groupBy("channel", "commenter").agg(F.count("*").cast("double").alias("w"))


def hops(a: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, p), for each of `keys`: probability of a step channel-commenter-channel. One join of the audience with itself by commenter; a
    commenter's pairs are bounded by the configured channel list."""
    out = a.select(*keys, F.col("channel").alias("src"), "commenter", (F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "channel"))).alias("out"))
    back = a.select(*keys, F.col("channel").alias("dst"), "commenter", (F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "commenter"))).alias("back"))
    return out.join(back, [*keys, "commenter"]).groupBy(*keys, "src", "dst").agg(F.sum(F.col("out") * F.col("back")).alias("p"))


def ppr(hop: DataFrame, targets: DataFrame, steps: int = STEPS, keys: tuple[str, ...] = ()) -> DataFrame:
    """(target, channel, r), for each of `keys`: personalised PageRank from each target. Each commenter leads back to a channel, so no mass dangles."""
    start = targets.select(*keys, F.col("channel").alias("target"), "channel", F.lit(1 - ALPHA).alias("r"))
    r = targets.select(*keys, F.col("channel").alias("target"), "channel", F.lit(1.0).alias("r"))
    by_source = hop.withColumnRenamed("src", "channel")
    for _ in range(steps):
        moved = r.join(by_source, [*keys, "channel"]).select(*keys, "target", F.col("dst").alias("channel"), (F.lit(ALPHA) * F.col("r") * F.col("p")).alias("r"))
        r = moved.union(start).groupBy(*keys, "target", "channel").agg(F.sum("r").alias("r"))
    return r


def target_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(TARGET,)], "channel string")


def diffusion(spark: SparkSession, a: DataFrame) -> DataFrame:
    """(target, channel, r) from the audience. The steps' probabilities, a row a pair of channels, are settled: each of the steps reads them."""
    return ppr(settled(hops(a), "hops"), target_of(spark))


def ppr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.round("r", 8).desc(), "channel")
    return diffusion(spark, audience(spark, sf_dir)).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= TOP).select("target", "channel", "rank", rounded("r").alias("r"))


def shared_with_target(a: DataFrame) -> DataFrame:
    """(channel, n) from the audience: commenters shared with the target. Joins the target's commenters only."""
    a = a.select("channel", "commenter")
    return a.where(F.col("channel") != TARGET).join(a.where(F.col("channel") == TARGET).select("commenter"), "commenter", "left_semi").groupBy("channel").agg(F.count("*").alias("n"))


def shared_audience_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_with_target(audience(spark, sf_dir)).select(F.lit(TARGET).alias("target"), "channel", F.col("n").alias("n_shared"), rounded(F.col("n") / (F.col("n") + KAPPA)).alias("confidence"))


def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, ppr, topic_similarity, confidence, score) of each other channel."""
    a = settled(audience(spark, sf_dir), "audience")
    r = settled(diffusion(spark, a).where(F.col("channel") != TARGET), "diffusion")
    most = r.agg(F.max("r").alias("most"))
    s = growth.similarities(spark, sf_dir).where(F.col("a") == TARGET).select(F.col("b").alias("channel"), "s")
    c = shared_with_target(a).select("channel", (F.col("n") / (F.col("n") + KAPPA)).alias("confidence"))
    x = r.join(F.broadcast(most)).join(s, "channel", "left").join(c, "channel", "left").na.fill(0.0, ["s", "confidence"])  # one row
    ppr_norm = F.try_divide("r", "most")
    return x.select("channel", ppr_norm.alias("ppr"), F.col("s").alias("topic_similarity"), "confidence", (F.col("confidence") * (LAMBDA * ppr_norm + (1 - LAMBDA) * F.col("s"))).alias("score"))


def bridge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridges(spark, sf_dir).select("channel", *(rounded(c).alias(c) for c in ("ppr", "topic_similarity", "confidence", "score")))


def bridge_rank(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The best bridges with the topics that both channels cover most. Names no commenter."""
    w = Window.orderBy(F.round("score", 8).desc(), "channel")
    top = bridges(spark, sf_dir).orderBy(F.round("score", 8).desc(), "channel").limit(k).withColumn("rank", F.row_number().over(w).cast("long"))
    p = growth.shares(spark, sf_dir).select("channel", "topic", "p")
    own = p.where(F.col("channel") == TARGET).select("topic", F.col("p").alias("own"))
    both = top.join(p, "channel").join(own, "topic").withColumn("m", F.round(F.least("p", "own"), 8))
    best = both.groupBy("channel", "rank", "score").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "topic"))).alias("t"))
    return best.select("channel", "rank", rounded("score").alias("score"), F.concat_ws(",", F.slice("t.topic", 1, 2)).alias("shared_topics"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audience(spark, sf_dir).select("channel").distinct()


def ppr_topk_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ppr_topk with each channel as target."""
    w = Window.partitionBy("target").orderBy(F.round("r", 8).desc(), "channel")
    r = ppr(hops(audience(spark, sf_dir)), channels(spark, sf_dir))
    return r.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= TOP).select("target", "channel", "rank", rounded("r").alias("r"))


def shared_audience_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shared_audience_conf with each channel as target."""
    n = F.col("w").cast("long")
    return channel_graph(spark, sf_dir).select(F.col("a").alias("target"), F.col("b").alias("channel"), n.alias("n_shared"), rounded(n / (n + KAPPA)).alias("confidence"))


def bridges_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bridges with each channel as target: (target, channel, ppr, topic_similarity, confidence, score)."""
    r = ppr(hops(audience(spark, sf_dir)), channels(spark, sf_dir)).where("channel <> target")
    r = r.withColumn("most", F.max("r").over(Window.partitionBy("target")))
    s = growth.similarities(spark, sf_dir).select(F.col("a").alias("target"), F.col("b").alias("channel"), "s")
    c = channel_graph(spark, sf_dir).select(F.col("a").alias("target"), F.col("b").alias("channel"), (F.col("w") / (F.col("w") + KAPPA)).alias("confidence"))
    x = r.join(s, ["target", "channel"], "left").join(c, ["target", "channel"], "left").na.fill(0.0, ["s", "confidence"])
    ppr_norm = F.try_divide("r", "most")
    return x.select("target", "channel", ppr_norm.alias("ppr"), F.col("s").alias("topic_similarity"), "confidence", (F.col("confidence") * (LAMBDA * ppr_norm + (1 - LAMBDA) * F.col("s"))).alias("score"))


def bridge_score_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridges_by_target(spark, sf_dir).select("target", "channel", *(rounded(c).alias(c) for c in ("ppr", "topic_similarity", "confidence", "score")))


def bridge_rank_by_target(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """bridge_rank with each channel as target."""
    w = Window.partitionBy("target").orderBy(F.round("score", 8).desc(), "channel")
    top = bridges_by_target(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    p = growth.shares(spark, sf_dir).select("channel", "topic", "p")
    own = p.select(F.col("channel").alias("target"), "topic", F.col("p").alias("own"))
    both = top.join(p, "channel").join(own, ["target", "topic"]).withColumn("m", F.round(F.least("p", "own"), 8))
    best = both.groupBy("target", "channel", "rank", "score").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "topic"))).alias("t"))
    return best.select("target", "channel", "rank", rounded("score").alias("score"), F.concat_ws(",", F.slice("t.topic", 1, 2)).alias("shared_topics"))


def bridge_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridges of each target anew for each week's comments: (target, channel, week, score, confidence, explanation). Names no commenter."""
    week = ("week",)
    a = adapt.comments(spark, sf_dir).groupBy("week", "channel", "commenter").agg(F.count("*").cast("double").alias("w"))
    r = ppr(hops(a, week), a.select("week", "channel").distinct(), keys=week).where("channel <> target")
    r = r.withColumn("ppr", F.try_divide("r", F.max("r").over(Window.partitionBy("week", "target"))))
    own, other = (a.select("week", F.col("channel").alias(c), "commenter") for c in ("target", "channel"))
    common = own.join(other, ["week", "commenter"]).where("target <> channel").groupBy("week", "target", "channel").agg(F.count("*").alias("n"))
    counts = adapt.lines(spark, sf_dir).groupBy("week", "channel", "topic").agg(F.sum("qty").cast("double").alias("q"))
    unit = counts.withColumn("u", F.col("q") / F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("week", "channel"))))
    mine = unit.select("week", F.col("channel").alias("target"), "topic", F.col("q").alias("qt"), F.col("u").alias("ut"))
    both = mine.join(unit, ["week", "topic"]).where("target <> channel")
    best = F.min(F.struct((-F.round(F.least("q", "qt"), 8)).alias("m"), "topic"))["topic"]
    topics = both.groupBy("week", "target", "channel").agg(F.sum(F.col("u") * F.col("ut")).alias("s"), best.alias("topic"))
    x = r.join(common, ["week", "target", "channel"], "left").join(topics, ["week", "target", "channel"], "left").na.fill(0.0, ["s"]).na.fill(0, ["n"])
    c = F.col("n") / (F.col("n") + KAPPA)
    told = F.concat(F.col("n").cast("string"), F.lit(" shared commenters; "), F.coalesce("topic", F.lit("no shared topic")))
    return x.select("target", "channel", "week", rounded(c * (LAMBDA * F.col("ppr") + (1 - LAMBDA) * F.col("s"))).alias("score"), rounded(c).alias("confidence"), told.alias("explanation"))


def channel_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, w), both ways: commenters that channels share. A commenter counts for each pair of its channels, whose number the configured list bounds."""
    x = audience(spark, sf_dir).select(F.col("channel").alias("a"), "commenter")
    y = x.withColumnRenamed("a", "b")
    return x.join(y, "commenter").where("a <> b").groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))


def modularity_of(graph: DataFrame, part: DataFrame) -> DataFrame:
    """Modularity of a partition (channel, community) of a graph (a, b, w; both ways)."""
    x = graph.join(part.select(F.col("channel").alias("a"), F.col("community").alias("ca")), "a").join(part.select(F.col("channel").alias("b"), F.col("community").alias("cb")), "b")
    by = x.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree"))
    total = by.agg(F.sum("degree").alias("m2"))
    y = by.join(F.broadcast(total))  # one row
    return y.agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)).alias("q"))


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of channels grouped by the last digit of their name."""
    g = channel_graph(spark, sf_dir)
    part = g.select(F.col("a").alias("channel")).distinct().withColumn("community", F.substring("channel", -1, 1))
    return modularity_of(g, part).select(rounded("q").alias("modularity"))


def louvain_labels(pairs: list[tuple[str, str, float]]) -> dict[str, str]:
    """Blondel et al. 2008: local moves, then the same on communities, while modularity rises."""
    graph: dict[str, dict[str, float]] = {}
    for a, b, w in pairs:
        graph.setdefault(a, {})[b] = graph.get(a, {}).get(b, 0.0) + w
        graph.setdefault(b, {})
    m2 = sum(w for v in graph.values() for w in v.values())
    label = {v: v for v in graph}
    while m2:
        own = {v: v for v in graph}
        degree = {v: sum(n.values()) for v, n in graph.items()}
        total = dict(degree)
        moved, again = False, True
        while again:
            again = False
            for v in sorted(graph):
                to: dict[str, float] = {}
                for u, w in graph[v].items():
                    if u != v:
                        to[own[u]] = to.get(own[u], 0.0) + w
                total[own[v]] -= degree[v]
                gain = {c: w - total[c] * degree[v] / m2 for c, w in to.items()}
                stay = to.get(own[v], 0.0) - total[own[v]] * degree[v] / m2
                best = max(gain, key=lambda c: (gain[c], c), default=own[v])
                if gain.get(best, stay) > stay + 1e-12:
                    own[v], again, moved = best, True, True
                total[own[v]] += degree[v]
        if not moved:
            break
        label = {v: own[c] for v, c in label.items()}
        smaller: dict[str, dict[str, float]] = {c: {} for c in set(own.values())}
        for v, n in graph.items():
            for u, w in n.items():
                smaller[own[v]][own[u]] = smaller[own[v]].get(own[u], 0.0) + w
        graph = smaller
    names = {c: min(v for v, x in label.items() if x == c) for c in set(label.values())}
    return {v: names[c] for v, c in label.items()}


def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, community) of the projected channel graph, which is as small as the configured channel list, in one group."""

    def run(pdf):
        import pandas as pd

        labels = louvain_labels(list(zip(pdf["a"], pdf["b"], pdf["w"], strict=True)))
        return pd.DataFrame(sorted(labels.items()), columns=["channel", "community"])

    return channel_graph(spark, sf_dir).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "channel string, community string")


def step_hash(seed: int, step: int) -> F.Column:
    return F.pmod(F.xxhash64("walk", F.lit(step), F.lit(seed)), F.col("degree"))


def walks(spark: SparkSession, sf_dir: str, length: int = 4, per_channel: int = 20, seed: int = 11) -> DataFrame:
    """(walk, nodes): random walks channel-commenter-channel. Each step joins walks to typed neighbour lists, and takes the one that a hash of walk and step names.
    A channel's neighbours are numbered rows, not an array, so the join finds one row a walk."""
    a = audience(spark, sf_dir).select("channel", "commenter")
    by_channel = a.select("channel", "commenter", (F.row_number().over(Window.partitionBy("channel").orderBy("commenter")) - 1).alias("i"), F.count("*").over(Window.partitionBy("channel")).alias("degree"))
    by_commenter = a.select("channel", "commenter", (F.row_number().over(Window.partitionBy("commenter").orderBy("channel")) - 1).alias("i"), F.count("*").over(Window.partitionBy("commenter")).alias("degree"))
    sizes = {"channel": by_channel.select("channel", "degree").distinct(), "commenter": by_commenter.select("commenter", "degree").distinct()}
    w = sizes["channel"].select("channel").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_channel))))
    w = w.select(F.xxhash64("channel", "k").alias("walk"), "channel", F.array("channel").alias("nodes"))
    for step in range(length):
        w = w.join(sizes["channel"], "channel").withColumn("i", step_hash(seed, 2 * step)).drop("degree")
        w = w.join(by_channel.select("channel", "i", "commenter"), ["channel", "i"]).select("walk", "nodes", "commenter")
        w = w.join(sizes["commenter"], "commenter").withColumn("i", step_hash(seed, 2 * step + 1)).drop("degree")
        w = w.join(by_commenter.select("commenter", "i", "channel"), ["commenter", "i"]).select("walk", F.concat("nodes", F.array("channel")).alias("nodes"), "channel")
    return w.select("walk", "nodes")


def metapath_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel embeddings of metapath walks (commenters are left out of the sentences)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=8, minCount=1, seed=5, inputCol="nodes", outputCol="v", maxIter=1).fit(walks(spark, sf_dir))
    return model.getVectors().select(F.col("word").alias("channel"), vector_to_array("vector").alias("embedding"))


def node2vec_walks(spark: SparkSession, sf_dir: str, p: float = 0.5, q: float = 2.0, length: int = 4, per_channel: int = 10, seed: int = 3) -> DataFrame:
    """(walk, nodes): second-order walks on the channel graph: weight w/p back to the node before, w to its neighbours, w/q to others; the next
    node is that of the largest weighted hash (a draw in proportion to the weights)."""
    g = channel_graph(spark, sf_dir)
    w = g.select(F.col("a").alias("v")).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_channel))))
    w = w.select(F.xxhash64("v", "k").alias("walk"), F.lit(None).cast("string").alias("u"), "v", F.array("v").alias("nodes"))
    near = g.select(F.col("a").alias("u"), F.col("b").alias("next"), F.lit(True).alias("linked"))
    for step in range(length):
        x = w.join(g.select(F.col("a").alias("v"), F.col("b").alias("next"), "w"), "v").join(near, ["u", "next"], "left")
        weight = F.col("w") * F.when(F.col("u").isNull() | F.col("linked"), 1.0).when(F.col("next") == F.col("u"), 1 / p).otherwise(1 / q)
        uniform = (F.pmod(F.xxhash64("walk", "next", F.lit(step), F.lit(seed)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
        best = x.groupBy("walk", "v").agg(F.max_by(F.struct("next", "nodes"), F.ln(uniform) / weight).alias("b"))
        w = best.select("walk", F.col("v").alias("u"), F.col("b.next").alias("v"), F.concat("b.nodes", F.array("b.next")).alias("nodes"))
    return w.select("walk", "nodes")
