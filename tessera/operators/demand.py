"""Audience demand and content gaps: text cleaning, weak labels, topic distributions, divergences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import jsd_term, rounded
from ..sources import adapt
from ..sources.tables import read

#: Words of romanised Sinhala that route a Latin text to Tanglish.
TANGLISH = ["mama", "oya", "api", "eka", "mokada", "kohomada", "hari", "nane", "puluwan", "kiyala", "karanna", "thiyenawa", "godak", "lassanai"]

#: Comments at which a week's divergence is half borne out.
KAPPA = 20.0


def clean(c: Column) -> Column:
    """Lower case, without links, mentions and markup, white space as single spaces."""
    c = F.lower(c)
    for pattern in (r"https?://[^\s]+", r"<[^<>]*>", r"@[a-z0-9_.]+"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, r"[ \n\r\t]+", " "))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts, empty ones dropped, one row for each distinct one."""
    d = read(spark, sf_dir, "documents").select("doc_id", clean(F.col("text")).alias("t")).where("t <> ''")
    return d.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars")).groupBy("text_md5", "n_chars").agg(F.min("doc_id").alias("doc_id"))


def route(c: Column) -> Column:
    """sinhala, tanglish, english or other, by script and words. Words keep their vowel signs and joiners."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}\p{M}]", ""))
    sinhala = F.length(F.regexp_replace(c, r"[^\x{0D80}-\x{0DFF}]", ""))
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\x{200D}]+"), F.lit(0))
    known = F.size(F.filter(words, lambda w: w.isin(TANGLISH)))
    latin = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    return F.when(letters == 0, "other").when(sinhala * 2 >= letters, "sinhala").when(known * 10 >= F.size(words), "tanglish").when(latin * 10 >= letters * 9, "english").otherwise("other")


def language_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(route(F.col("text")).alias("route")).agg(F.count("*").alias("n"))


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, v1, v2, v3, v4): labelling functions of a text's quality: 1, 0, or -1 to abstain."""
    t, n = F.col("text"), F.length("text")
    return docs.select(
        "doc_id", F.when(n >= 1500, 1).when(n < 200, 0).otherwise(-1).alias("v1"), F.when(F.instr(t, " | ") > 0, 0).otherwise(-1).alias("v2"),
        F.when((F.instr(t, "***") > 0) | (F.instr(t, "!!") > 0), 0).otherwise(-1).alias("v3"), F.when(F.instr(t, ".\n") > 0, 1).otherwise(-1).alias("v4"))


FUNCTIONS = ["v1", "v2", "v3", "v4"]


def majority(v: DataFrame) -> DataFrame:
    """(doc_id, label, n_votes): the majority of those that don't abstain; ties abstain."""
    yes, no = (sum((F.when(F.col(c) == k, 1).otherwise(0) for c in FUNCTIONS), F.lit(0)) for k in (1, 0))
    return v.select("doc_id", F.when(yes > no, 1).when(no > yes, 0).otherwise(-1).alias("label"), (yes + no).cast("long").alias("n_votes"))


def weak_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return majority(votes(read(spark, sf_dir, "documents")))


def label_model(v: DataFrame, rounds: int = 10, prior: float = 0.5) -> DataFrame:
    """(doc_id, p): probability of label 1 by Dawid and Skene's EM with an accuracy for each function. Votes are counted by
    pattern first, so rounds go over patterns (3 to the power of the functions at most), not over documents."""
    patterns = v.groupBy(*FUNCTIONS).agg(F.count("*").alias("n")).collect()
    acc = dict.fromkeys(FUNCTIONS, 0.7)
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for r in patterns:
            one, zero = prior, 1 - prior
            for c in FUNCTIONS:
                if r[c] >= 0:
                    one *= acc[c] if r[c] == 1 else 1 - acc[c]
                    zero *= acc[c] if r[c] == 0 else 1 - acc[c]
            post[tuple(r[c] for c in FUNCTIONS)] = one / (one + zero)
        for c in FUNCTIONS:
            cast = [(r["n"], r[c], post[tuple(r[k] for k in FUNCTIONS)]) for r in patterns if r[c] >= 0]
            total = sum(n for n, _, _ in cast)
            if total:
                acc[c] = min(0.99, max(0.51, sum(n * (p if x == 1 else 1 - p) for n, x, p in cast) / total))
        prior = sum(r["n"] * post[tuple(r[c] for c in FUNCTIONS)] for r in patterns) / max(1, sum(r["n"] for r in patterns))
    table = v.sparkSession.createDataFrame([(*k, p) for k, p in post.items()], ", ".join(f"{c} int" for c in FUNCTIONS) + ", p double")
    return v.join(F.broadcast(table), FUNCTIONS).select("doc_id", "p")


def weak_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_model(votes(read(spark, sf_dir, "documents"))).select("doc_id", rounded("p").alias("p"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters; null where chance alone agrees always."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n"))).alias("same"))
    rows, cols = cells.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("x")), cells.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, "k").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    both = total.join(chance)  # a row each
    po, pe = F.coalesce("same", F.lit(0)) / F.col("t"), F.coalesce("xy", F.lit(0)) / (F.col("t") * F.col("t"))
    return both.select(F.col("t").alias("n"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = read(spark, sf_dir, "labels").select("doc_id", "quality")
    weak = weak_majority_vote(spark, sf_dir).where("label >= 0").select("doc_id", "label")
    return kappa(weak.join(gold, "doc_id"), "label", "quality").select("n", rounded("kappa").alias("kappa"))


def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A teacher's labels, which arrive as a table, beside the weak ones."""
    teacher = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("teacher"))
    return weak_majority_vote(spark, sf_dir).join(teacher, "doc_id", "left").select("doc_id", F.coalesce("teacher", F.when(F.col("label") >= 0, F.col("label"))).alias("label"), F.when(F.col("teacher").isNotNull(), "teacher").when(F.col("label") >= 0, "weak").otherwise("none").alias("origin"))


def share(df: DataFrame, keys: list[str], n: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.groupBy(*keys, "topic").agg(n.alias("n")).select(*keys, "topic", (F.col("n") / F.sum("n").over(w)).alias(name))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share(adapt.lines(spark, sf_dir), ["channel"], F.sum("qty"), "p")


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("channel"), F.col("p_type").alias("topic"))
    return share(part, ["channel"], F.count("*"), "q")


def demand_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand(spark, sf_dir).select("channel", "topic", rounded("p").alias("share"))


def supply_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).select("channel", "topic", rounded("q").alias("share"))


def both_sides(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """Both distributions; a topic on one side only has 0 on the other."""
    return p.join(q, [*keys, "topic"], "full_outer").na.fill(0.0, ["p", "q"])


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = both_sides(demand(spark, sf_dir), supply(spark, sf_dir), ["channel"])
    return x.select("channel", "topic", "p", "q", jsd_term(F.col("p"), F.col("q")).alias("part"), (F.col("p") - F.col("q")).alias("gap"))


def demand_supply_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(spark, sf_dir).groupBy("channel").agg(rounded(F.sum("part")).alias("jsd"))


def jsd_contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(spark, sf_dir).select("channel", "topic", rounded("part").alias("part"), rounded("gap").alias("gap"))


def gaps_by(spark: SparkSession, sf_dir: str, step: str) -> DataFrame:
    """(channel, step, topic, p, q): each step's demand and the overall supply."""
    p = share(adapt.lines(spark, sf_dir), ["channel", step], F.sum("qty"), "p")
    q = supply(spark, sf_dir).join(p.select("channel", step).distinct(), "channel")
    return both_sides(p, q, ["channel", step])


def jsd_delta(spark: SparkSession, sf_dir: str, step: str) -> DataFrame:
    """Divergence of each step's demand from the overall supply, and its change since the channel's step before."""
    x = gaps_by(spark, sf_dir, step).groupBy("channel", step).agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("jsd"))
    before = F.lag("jsd").over(Window.partitionBy("channel").orderBy(step))
    return x.select("channel", step, rounded("jsd").alias("jsd"), rounded(F.col("jsd") - before).alias("change"))


def jsd_monthly_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsd_delta(spark, sf_dir, "month")


def jsd_weekly_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsd_delta(spark, sf_dir, "week")


def demand_gap_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, week, score, confidence, explanation): the divergence, how far the week's comments bear it, and the topic most in want."""
    x = gaps_by(spark, sf_dir, "week").withColumn("gap", F.round(F.col("p") - F.col("q"), 8))
    most = F.min(F.when(F.col("gap") > 0, F.struct((-F.col("gap")).alias("g"), "topic")))["topic"]
    score = x.groupBy("channel", "week").agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("jsd"), most.alias("topic"))
    n = adapt.lines(spark, sf_dir).groupBy("channel", "week").agg(F.count("*").alias("n"))
    told = F.coalesce(F.concat(F.lit("unmet: "), "topic"), F.lit("met"))
    return score.join(n, ["channel", "week"]).select("channel", "week", rounded("jsd").alias("score"), rounded(F.col("n") / (F.col("n") + KAPPA)).alias("confidence"), told.alias("explanation"))


def w1_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wasserstein distance over topics in a fixed order, a step apart."""
    w = Window.partitionBy("channel").orderBy("topic")
    x = gaps(spark, sf_dir).select("channel", F.abs(F.sum("gap").over(w)).alias("d"))
    return x.groupBy("channel").agg(rounded(F.sum("d")).alias("w1"))


def sinkhorn(spark: SparkSession, sf_dir: str, eps: float = 0.01, steps: int = 300) -> DataFrame:
    """Wasserstein distance by Sinkhorn's iterations, cost 1 - cosine of the topics' embeddings (one vector a topic: the mean of a label)."""
    import numpy as np

    e = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.array(*(F.avg(F.col("embedding")[i]) for i in range(64))).alias("v"))
    topics = sorted(r[0] for r in read(spark, sf_dir, "part").select("p_type").distinct().collect())
    vectors = {r["label"]: np.array(r["v"]) for r in e.collect()}  # a vector a topic
    unit = np.stack([(v := vectors[sorted(vectors)[i % len(vectors)]]) / np.linalg.norm(v) for i in range(len(topics))])
    cost = 1 - unit @ unit.T

    def run(pdf):
        import pandas as pd

        p, q = (np.array([dict(zip(pdf["topic"], pdf[c], strict=True)).get(t, 0.0) for t in topics]) for c in "pq")
        return pd.DataFrame({"channel": [pdf["channel"].iloc[0]], "distance": [sinkhorn_distance(p, q, cost, eps, steps)]})

    return gaps(spark, sf_dir).select("channel", "topic", "p", "q").groupBy("channel").applyInPandas(run, "channel string, distance double")


def sinkhorn_distance(p, q, cost, eps: float = 0.01, steps: int = 300) -> float:
    import numpy as np

    p, q = np.maximum(p, 1e-12), np.maximum(q, 1e-12)
    kernel = np.exp(-cost / eps)
    u, v = np.ones_like(p), np.ones_like(q)
    for _ in range(steps):
        u = p / np.maximum(kernel @ v, 1e-300)
        v = q / np.maximum(kernel.T @ u, 1e-300)
    return float((u[:, None] * kernel * v * cost).sum())


def unmet(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    w = Window.partitionBy("channel").orderBy(F.round("gap", 8).desc(), "topic")
    return gaps(spark, sf_dir).where(F.round("gap", 8) > 0).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def unmet_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmet(spark, sf_dir).select("channel", "topic", "rank", rounded("gap").alias("gap"))


def demand_gap_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = unmet(spark, sf_dir).where("rank = 1").select("channel", F.col("topic").alias("top_topic"))
    return demand_supply_jsd(spark, sf_dir).join(top, "channel", "left").select("channel", "jsd", "top_topic")


def ctfidf_topterms(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Class-based TF-IDF (tf * ln(1 + A / f)) of words by language, and the k best of each class."""
    w = read(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    tf = w.groupBy("lang", "term").agg(F.count("*").alias("n"))
    f = tf.groupBy("term").agg(F.sum("n").alias("f"))
    size = tf.groupBy("lang").agg(F.sum("n").alias("words"))
    mean = size.agg(F.avg("words").alias("a"))
    x = tf.join(f, "term").join(F.broadcast(size), "lang").join(F.broadcast(mean))  # a row a class; one row
    score = F.col("n") / F.col("words") * F.ln(1 + F.col("a") / F.col("f"))
    best = Window.partitionBy("lang").orderBy(F.round("score", 8).desc(), "term")
    return x.withColumn("score", score).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("lang", "term", "rank", rounded("score").alias("score"))
