"""Closed forms, planted signals, privacy, retention and leakage."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import bridge, demand, growth, learning, shared
from tessera.sources import tables


def jsd(spark, p, q):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, q, strict=True)], "p double, q double")
    return df.select(F.sum(kernels.jsd_term(F.col("p"), F.col("q")))).first()[0]


def test_divergence_of_equal_and_disjoint_distributions(spark):
    assert jsd(spark, [0.5, 0.5], [0.5, 0.5]) == 0
    assert jsd(spark, [1, 0], [0, 1]) == pytest.approx(1)
    assert jsd(spark, [0.2, 0.8], [0.6, 0.4]) == pytest.approx(jsd(spark, [0.6, 0.4], [0.2, 0.8]))


def test_kappa_of_the_textbook_table(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    assert demand.kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()["kappa"] == pytest.approx(0.4)
    assert demand.kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first()["kappa"] is None


def series(ns, total):
    return [{"t": i, "n": n, "total": total} for i, n in enumerate(ns)]


def shortrun(spark, ns, total=400):
    rows = [(i, math.log((n + 0.5) / (total - n + 0.5)), 1 / (n + 0.5) + 1 / (total - n + 0.5)) for i, n in enumerate(ns)]
    x = spark.createDataFrame([(rows,)], "xs array<struct<t:int,y:double,r:double>>")
    b = x.select(kernels.bocpd_fold(F.col("xs"), 0.05, F.lit(rows[0][1]), 1.0, 24).alias("b")).first()["b"]
    return sum(b["p"][:4]) / sum(b["p"])


def test_a_step_is_detected_soon_and_not_before(spark):
    flat, step = [20] * 40, [20] * 40 + [100] * 3
    assert shortrun(spark, flat) < 0.5
    assert shortrun(spark, step) > 0.9


def test_filter_variance_is_positive_and_level_follows(spark):
    x = spark.createDataFrame([([(i, 2.0, 0.1) for i in range(30)],)], "xs array<struct<t:int,y:double,r:double>>")
    k = x.select(kernels.kalman_fold(F.col("xs"), F.lit(0.0), F.lit(1.0), 0.01).alias("k")).first()["k"]
    assert k["p"] > 0 and k["m"] == pytest.approx(2.0, abs=0.01)


def audience(spark, rows):
    return spark.createDataFrame([(c, u, 1.0) for c, u in rows], "channel string, commenter long, w double")


def test_diffusion_sums_to_one_and_prefers_a_shared_audience(spark):
    rows = [("a", i) for i in range(20)] + [("b", i) for i in range(10)] + [("c", 19)] + [("c", 100 + i) for i in range(9)]
    r = {x["channel"]: x["r"] for x in bridge.ppr(bridge.hops(audience(spark, rows)), spark.createDataFrame([("a",)], "channel string")).collect()}
    assert sum(r.values()) == pytest.approx(1)
    assert r["b"] > r["c"]


def test_communities_of_two_cliques():
    clique = lambda vs: [(a, b, 1.0) for a in vs for b in vs if a != b]
    pairs = clique("abcd") + clique("wxyz") + [("d", "w", 1.0), ("w", "d", 1.0)]
    labels = bridge.louvain_labels(pairs)
    assert len({labels[v] for v in "abcd"}) == 1 and len({labels[v] for v in "wxyz"}) == 1 and labels["a"] != labels["z"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=3, max_size=3))
def test_attributions_sum_to_the_prediction(x):
    tree = {"feature": [0, -1, 1, -1, -1], "threshold": [0.0, 0, 1.0, 0, 0], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "value": [0.4, 0.1, 0.6, 0.5, 0.9], "cover": [10.0, 4.0, 6.0, 4.0, 2.0]}
    phi, base = learning.tree_shap_values([tree], np.array(x))
    assert phi.sum() + base == pytest.approx(learning.expected(tree, np.array(x), frozenset({0, 1, 2})))
    assert phi[2] == 0


def test_transport_tends_to_the_exact_distance():
    cost = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert demand.sinkhorn_distance(np.array([1.0, 0.0]), np.array([0.25, 0.75]), cost) == pytest.approx(0.75, abs=1e-3)


def test_hashes_follow_the_salt_and_stay_out_of_plans(spark, capsys):
    df = spark.createDataFrame([("u1",), ("u2",), (None,)], "id string")
    one, two = ([r[0] for r in shared.hashed_ids(df, "id", s).collect()] for s in ("pepper-a", "pepper-b"))
    assert one != two and one[2] is None and len(one[0]) == 64
    assert one[:2] == [r[0] for r in df.select(shared.hashed(F.col("id"), "pepper-a")).collect()][:2]
    shared.hashed_ids(df, "id", "pepper-a").explain(True)
    assert "pepper-a" not in capsys.readouterr().out


def test_outputs_that_name_commenters_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("h", dt.date(2024, 1, 1))], "commenter_hash string, snapshot_week date")
    with pytest.raises(ValueError):
        tables.write_snapshot(df, str(tmp_path / "x"))


def test_a_week_written_again_replaces_itself(spark, tmp_path):
    at = str(tmp_path / "snap")
    rows = lambda n, d: spark.createDataFrame([(n, dt.date(2024, 1, d))], "n int, snapshot_week date")
    tables.write_snapshot(rows(1, 1), at)
    tables.write_snapshot(rows(2, 8), at)
    tables.write_snapshot(rows(3, 8), at)
    assert sorted(r["n"] for r in spark.read.parquet(at).collect()) == [1, 3]


def test_retention_keeps_29_days_and_drops_31(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 10)), (2, dt.datetime(2024, 1, 12))], "id int, ts timestamp_ntz")
    assert [r["id"] for r in shared.retained(df, "ts").collect()] == [2]


def test_routes(spark):
    rows = [("හෙලෝ ක්‍රියාව ලංකාව",), ("mama gedara yanawa api eka",), ("the cat sat on the mat",), ("123",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(demand.route(F.col("t"))).collect()]
    assert got == ["sinhala", "tanglish", "english", "other"]


def test_folds_do_not_leak(spark, data):
    for r in growth.time_split(spark, data).collect():
        assert r["last_train"] is None or r["first_test"] is None or r["last_train"] < r["first_test"]


def test_components_keep_their_contracts(spark, data):
    from tessera.plans import contracts, registry

    for name in contracts.CONTRACTS:
        contracts.validated(registry.QUERIES[name](spark, data), name)
    with pytest.raises(ValueError):
        contracts.validated(spark.range(1), "bridge_score")


def test_a_saved_model_predicts_as_before(spark, data, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier

    x = learning.examples(spark, data)
    model = Pipeline(stages=[RandomForestClassifier(numTrees=2, maxDepth=2, seed=1)]).fit(x)
    learning.save(model, str(tmp_path / "model"))
    before, after = (sorted((r["video"], r["prediction"]) for r in m.transform(x).select("video", "prediction").collect()) for m in (model, learning.load(str(tmp_path / "model"))))
    assert before == after


def test_landed_rows_are_typed(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"channel_id": "a", "title": "A", "niche": "x"}\n')
    df = tables.read_landed(spark, str(tmp_path / "c.json"), "channels")
    assert tables.validated(df, "channels").first()["niche"] == "x"
    with pytest.raises(ValueError):
        tables.validated(spark.range(1), "channels")


def test_weekly_series_are_of_channel_and_topic(spark, data):
    from tessera.operators import emerging

    rows = emerging.dense(spark, data, "week", emerging.CHANNEL_TOPIC).collect()
    series = {(r["channel"], r["topic"]) for r in rows}
    assert len({r["channel"] for r in rows}) > 1 and len(rows) == len(series) * len({r["t"] for r in rows})
    by = {}
    for r in rows:
        by[r["topic"], r["t"]] = by.get((r["topic"], r["t"]), 0) + r["n"]
    assert by == {(r["topic"], r["t"]): r["n"] for r in emerging.dense(spark, data, "week").collect()}
    for f in (emerging.kalman_level_weekly, emerging.alert_view_weekly):
        got = f(spark, data).collect()
        assert {(r["channel"], r["topic"]) for r in got} == series and len(got) == len(series)


def test_each_channel_is_a_target(spark, data):
    from tessera.operators import bridge

    every = {r["channel"] for r in bridge.channels(spark, data).collect()}
    assert len(every) > 1
    for name, one in (("ppr_topk", bridge.ppr_topk), ("shared_audience", bridge.shared_audience_conf), ("bridge_score", bridge.bridge_score), ("bridge_rank", bridge.bridge_rank)):
        got = getattr(bridge, f"{name}_by_target")(spark, data).collect()
        want = one(spark, data)
        assert {r["target"] for r in got} == every
        assert sorted(tuple(r[c] for c in want.columns) for r in got if r["target"] == bridge.TARGET) == sorted(map(tuple, want.collect()))


def test_the_plan_of_recommendations_stays_small(spark, data):
    """The components' own plans, with a join of lines for each use, are not in it: the driver holds what it plans."""
    from tessera.operators import fusion

    plan = fusion.recommend_topk(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3


def test_baselines_are_added_in_the_order_of_the_sql(duck):
    r = np.random.default_rng(3)
    xs = [None if r.random() < 0.1 else float(v) for v in r.normal(size=5000) * 10.0 ** r.integers(-6, 6, 5000)]
    rows = pa.table({"i": range(len(xs)), "x": pa.array(xs, pa.float64())})  # noqa: F841
    want = duck.execute("SELECT avg(x) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) FROM rows ORDER BY i").fetchall()
    # Two channels, over batches that end inside of them.
    both = pa.table({"channel": ["a"] * len(xs) + ["b"] * len(xs), "video": [*range(len(xs))] * 2, "x": pa.array(xs * 2, pa.float64())})
    assert [b for out in growth.block_baselines(both.to_batches(777)) for b in out["baseline"].to_pylist()] == [b for (b,) in want] * 2


@pytest.mark.parametrize("undated", [0, 1])
def test_equal_videos_are_labelled_as_by_the_sql(spark, tmp_path, undated):
    """300 videos alike, which rounding decides; one without a date comes last."""
    import duckdb

    from tessera.plans import oracles

    n, day = 300, dt.datetime(1992, 3, 1)
    spark.createDataFrame([(i, "Brand#1", "t") for i in range(n + undated)], "p_partkey bigint, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(i, i, 7.0, "N", day) for i in range(n)] + [(n, n, 1000.0, "N", None)] * undated
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT video, above FROM ({oracles.ORACLES['label_above_baseline']})").fetchall())
    assert {True, False} <= set(want.values())
    assert {r["video"]: r["above"] for r in growth.label_above_baseline(spark, str(tmp_path)).collect()} == want
