"""Models: tree baselines, their attributions, intent classification, topic clusters. Fits are MLlib's, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import rounded
from ..sources.tables import read
from . import demand, growth

FEATURES = ["views_per_sub", "likes_per_1000", "comments_per_1000"]


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, video, published, label, features): labels of the videos above their channel's baseline."""
    x = growth.indicators_of(spark, sf_dir).na.fill(0.0, FEATURES)
    y = growth.label_above_baseline(spark, sf_dir).where("above is not null").select("video", F.col("above").cast("double").alias("label"))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x.join(y, "video")).select("channel", "video", "published", "label", "features")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("published") < growth.CUT), df.where(F.col("published") >= growth.CUT)


def scored(model, test: DataFrame) -> DataFrame:
    return model.transform(test).select("channel", "video", "label", rounded(vector_to_array("probability")[1]).alias("p"))


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(examples(spark, sf_dir))
    return scored(RandomForestClassifier(numTrees=10, maxDepth=4, seed=3).fit(train), test)


def gradient_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stands in for both boosting baselines, whose libraries aren't here."""
    train, test = split(examples(spark, sf_dir))
    return scored(GBTClassifier(maxIter=5, maxDepth=3, seed=3).fit(train), test)


def similarity_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier for a target channel, fitted on the rows of its nearest channels, weighted by similarity."""
    target = "Brand#12"
    near = growth.neighbours(spark, sf_dir).where(F.col("a") == target).select(F.col("b").alias("channel"), F.col("s").alias("weight"))
    near = near.union(spark.createDataFrame([(target, 1.0)], "channel string, weight double"))
    x = examples(spark, sf_dir).join(near, "channel")
    train, test = split(x)
    return scored(LogisticRegression(weightCol="weight", maxIter=20, regParam=0.1).fit(train), test.where(F.col("channel") == target))


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = split(examples(spark, sf_dir))
    values = RandomForestClassifier(numTrees=10, maxDepth=4, seed=3).fit(train).featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, values, strict=True)], "feature string, importance double")


def flat_tree(node) -> dict[str, list]:
    """A fitted tree as arrays: feature (-1: leaf), threshold, left, right, value, cover."""
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

    def add(n) -> int:
        i = len(out["feature"])
        stats = n.impurityStats()
        counts = np.array([stats.stats()[k] for k in range(len(stats.stats()))])
        for k, v in zip(out, (-1, 0.0, -1, -1, float(counts[1] / counts.sum()) if len(counts) > 1 else 0.0, float(counts.sum())), strict=True):
            out[k].append(v)
        if n.subtreeDepth() > 0:
            out["feature"][i], out["threshold"][i] = n.split().featureIndex(), n.split().threshold()
            out["left"][i] = add(n.leftChild())
            out["right"][i] = add(n.rightChild())
        return i

    add(node)
    return out


def expected(tree: dict[str, list], x: np.ndarray, known: frozenset[int], i: int = 0) -> float:
    """The tree's value when only the features in `known` are; others follow the training rows."""
    f = tree["feature"][i]
    if f < 0:
        return tree["value"][i]
    left, right = tree["left"][i], tree["right"][i]
    if f in known:
        return expected(tree, x, known, left if x[f] <= tree["threshold"][i] else right)
    a, b = tree["cover"][left], tree["cover"][right]
    return (a * expected(tree, x, known, left) + b * expected(tree, x, known, right)) / (a + b)


def tree_shap_values(trees: list[dict[str, list]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(attributions, base) of a row by Shapley's formula over all subsets of its few features; they sum to the prediction."""
    from itertools import combinations
    from math import factorial

    m = len(x)
    value = {}
    for k in range(m + 1):
        for s in combinations(range(m), k):
            value[frozenset(s)] = float(np.mean([expected(t, x, frozenset(s)) for t in trees]))
    phi = np.zeros(m)
    for i in range(m):
        for s, v in value.items():
            if i not in s:
                phi[i] += factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (value[s | {i}] - v)
    return phi, value[frozenset()]


def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-dependent attributions of the random forest, in the tasks that hold the rows; the trees are a few arrays."""
    train, test = split(examples(spark, sf_dir))
    model = RandomForestClassifier(numTrees=5, maxDepth=3, seed=3).fit(train)
    trees = [flat_tree(t._call_java("rootNode")) for t in model.trees]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [tree_shap_values(trees, np.array(x)) for x in pdf["x"]]
            out = pd.DataFrame({"video": pdf["video"], "base": [b for _, b in rows]})
            for k, f in enumerate(FEATURES):
                out[f"phi_{f}"] = [p[k] for p, _ in rows]
            yield out

    schema = "video bigint, base double, " + ", ".join(f"phi_{f} double" for f in FEATURES)
    return test.select("video", vector_to_array("features").alias("x")).mapInPandas(run, schema)


def intent_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A light student of the (teacher's and weak) labels, weighted by how sure they are."""
    labels = demand.pseudo_labels(spark, sf_dir).where("label is not null").select("doc_id", F.col("label").cast("double").alias("label"), F.when(F.col("origin") == "teacher", 1.0).otherwise(0.5).alias("weight"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    pipeline = Pipeline(stages=[Tokenizer(inputCol="text", outputCol="words"), HashingTF(inputCol="words", outputCol="tf", numFeatures=4096), IDF(inputCol="tf", outputCol="features"), LogisticRegression(weightCol="weight", maxIter=10, regParam=0.01)])
    x = docs.join(labels, "doc_id")
    return pipeline.fit(x).transform(docs).select("doc_id", F.col("prediction").cast("int").alias("intent"), rounded(F.array_max(vector_to_array("probability"))).alias("confidence"))


def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of embedded texts: principal components, then k-means (UMAP and HDBSCAN aren't here, so there is no outlier topic)."""
    x = read(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    reduced = PCA(k=8, inputCol="v", outputCol="features").fit(x).transform(x)
    return KMeans(k=10, seed=2, maxIter=20).fit(reduced).transform(reduced).select("vec_id", "label", F.col("prediction").alias("topic"))
