import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.operators import collections as C
from tessella.operators import joins as J
from tessella.operators import metrics as M
from tessella.operators import models, patch, preprocess, simulation, statistics


def test_with_index_numbers_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = sorted((r["__ix"], r["v"]) for r in C.with_index(df, "v").collect())
    assert got == [(k, k) for k in range(1000)]
    assert C.with_index(df.where("v < 0"), "v").count() == 0


def test_flat_map_drops_empty_and_null(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k long, a array<int>")
    assert sorted(r["x"] for r in C.flat_map(df, F.col("a"), "x").collect()) == [1, 2]


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 0, "b"), (2, 9, "c"), (3, 1, "d")], "k long, t long, n string")
    right = spark.createDataFrame([(1, 1, 10), (1, 5, 50), (1, 5, 51), (1, 6, 60), (2, 1, 20)], "k long, t2 long, v long")
    got = {r["n"]: r["v"] for r in J.as_of(left, right, "k", "t", "t2", ["v"]).collect()}
    assert got == {"a": 51, "b": None, "c": 20, "d": None}


def test_patches_round_trip(spark):
    rng = random.Random(3)
    schema = "k long, a long, b string"
    make = lambda: [(k, rng.randint(0, 2), rng.choice("xy")) for k in range(30) if rng.random() < 0.7]
    for _ in range(3):
        a, b, c = (spark.createDataFrame(make(), schema) for _ in range(3))
        rows = lambda df: sorted(map(tuple, df.collect()))
        d1, d2 = patch.diff(a, b, ["k"]), patch.diff(b, c, ["k"])
        assert rows(patch.apply(a, d1, ["k"])) == rows(b)
        assert rows(patch.apply(b, patch.invert(d1, ["k"]), ["k"])) == rows(a)
        assert rows(patch.apply(a, patch.compose(d1, d2, ["k"]), ["k"])) == rows(c)
    with pytest.raises(PySparkException):
        patch.apply(c, d1.unionByName(patch.diff(spark.createDataFrame([(99, 1, "x")], schema), c.where("false"), ["k"])), ["k"]).collect()


def test_common_subsequence(spark):
    df = spark.createDataFrame([(list("abcbdab"), list("bdcaba")), ([], ["a"])], "a array<string>, b array<string>")
    got = [r["s"] for r in df.select(patch.common_subsequence(F.col("a"), F.col("b")).alias("s")).collect()]
    assert len(got[0]) == 4 and got[1] == []


def test_metrics_against_small_examples(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 0), (2, 2)], "y int, p int")
    m = M.classification(df, "y", "p", "weighted").first()
    assert m["accuracy"] == pytest.approx(4 / 6)
    assert m["recall"] == pytest.approx(4 / 6)
    assert M.classification(df, "y", "p", "micro").first()["f1"] == pytest.approx(4 / 6)
    scores = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    assert M.roc_auc(scores, "y", "s").first()["roc_auc"] == pytest.approx(0.75)
    pts = spark.createDataFrame([(0, 0, [0.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 1, [10.0, 0.0]), (3, 1, [10.0, 1.0])], "i long, c int, x array<double>")
    a, b = 1.0, (10 + (101**0.5)) / 2
    assert M.silhouette(pts, "x", "c", "i").first()["silhouette"] == pytest.approx((b - a) / b)


def test_metrics_of_many_targets(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1, 1), (3.0, 3.0, 0, 1)], "y double, p double, c int, d int")
    each = M.regression_multi(df, {"a": ("y", "p"), "b": ("p", "y")}, ["mae", "mean_error"]).collect()
    assert [(r["target"], r["mae"], r["mean_error"]) for r in each] == [("a", 0.5, 0.5), ("b", 0.5, -0.5)]
    assert M.regression_multi(df, {"a": ("y", "p"), "b": ("p", "y")}, ["mean_error"], True).first()["mean_error"] == 0
    assert [r["accuracy"] for r in M.classification_multi(df, {"x": ("c", "d"), "z": ("c", "c")}).orderBy("target").collect()] == [0.5, 1.0]


def test_unseen_label_is_an_error(spark):
    e = preprocess.label_encoder(spark.createDataFrame([("a",), ("b",)], "v string"), "v")
    with pytest.raises(PySparkException):
        preprocess.encode(spark.createDataFrame([("c",)], "v string"), e, "v", "code").collect()


def test_split_is_repeatable_and_sized(spark):
    df = spark.range(1003)
    s = preprocess.split(df, [0.5, 0.25, 0.25], "id", 5)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert all(abs(counts[k] - 1003 * w) <= 1 for k, w in enumerate([0.5, 0.25, 0.25]))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, preprocess.split(df.repartition(7), [0.5, 0.25, 0.25], "id", 5).collect()))


def test_histogram_rules_and_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    h = statistics.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2, 3]
    assert sum(r["count"] for r in statistics.histogram(df, "x", "sturges").collect()) == 11
    d = statistics.histogram(df, "x", 5, density=True).collect()
    assert sum(r["density"] * (r["high"] - r["low"]) for r in d) == pytest.approx(1)


def test_exact_quantiles_by_narrowing(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for values in (rng.normal(size=6000), np.repeat([1.0, 2.0, 7.0], 900), np.round(rng.exponential(size=5000), 1), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        points = [0.0, 0.25, 0.5, 0.9, 1.0]
        for small in (50, 10_000):
            assert statistics.exact_quantiles(df, "x", points, small=small, accuracy=200) == pytest.approx(np.quantile(values, points).tolist())
    assert statistics.robust(df.where("false"), "x").first()["median"] is None


def test_curve_fit_and_least_squares(spark):
    df = spark.range(40).select((F.col("id") / 4).alias("x")).withColumn("y", 3 * F.exp(-0.5 * F.col("x")))
    got = models.curve_fit(df, "x", "y", "exponential_decay", [1.0, 1.0])
    assert got["success"] and got["params"] == pytest.approx([3, 0.5], rel=1e-3)
    line = spark.range(20).select(F.col("id").cast("double").alias("x"), (2 + 3 * F.col("id")).alias("y"))
    fit = models.least_squares(line, ["x"], "y")
    assert fit["intercept"] == pytest.approx(2) and fit["x"] == pytest.approx(3)


def test_boosted_trees_and_intervals(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("y", F.col("a") * 2 + F.col("b"))
    model = models.boosted_regressor(df, ["a", "b"], "y", rounds=8)
    p = models.predict(model, df, ["a", "b"])
    width = models.conformal_width(p, "y", 0.9)
    inside = models.conformal_interval(p, width).agg(F.avg(((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("int")).alias("r")).first()["r"]
    assert inside >= 0.9


def test_mixture_scores_sum_up(spark):
    df = spark.range(300).select((F.randn(1) + F.when(F.col("id") % 2 == 0, 8).otherwise(0)).alias("x"), F.randn(2).alias("y"))
    model = models.mixture(df, ["x", "y"], 2, seed=3)
    total = models.mixture_scores(model, df, ["x", "y"]).agg(F.sum("score").alias("s")).first()["s"]
    assert total == pytest.approx(model.summary.logLikelihood, rel=1e-2)
    assert models.mixture_sample(spark, model, 50, ["x", "y"]).count() == 50
    assert models.mixture_criteria(model, 2, 300)["bic"] > models.mixture_criteria(model, 2, 300)["aic"]


def test_simulation_orders_events(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    events = spark.createDataFrame([("a", day(3), -30.0), ("a", day(1), 100.0), ("a", day(2), 50.0), ("b", day(1), 1.0)], "k string, at timestamp, amount double")

    def process(state, t, e):
        more = [(t, {"amount": 20.0})] if e["amount"] == -30.0 else []
        return {"cash": state["cash"] + e["amount"]}, more

    got = {r["k"]: (r["cash"], r["events_processed"]) for r in simulation.simulate(events, "k", "at", {"cash": 0.0}, process, "k string, cash double, events_processed long, final_time timestamp").collect()}
    assert got == {"a": (140.0, 4), "b": (1.0, 1)}


def test_search_and_annealing(spark):
    want = [3, 1, 0, 2]
    best = simulation.anneal_permutation(spark, 4, lambda p: sum(a != b for a, b in zip(p, want, strict=True)), restarts=2, steps=400)
    assert best["energy"] == 0 and best["state"] == want
    found = simulation.coordinate_search(spark, [[0, 1, 2]] * 3, lambda s: -sum((x - 1) ** 2 for x in s), restarts=2)
    assert found["state"] == [1, 1, 1] and found["value"] == 0
    rows = simulation.search_space(spark, {"x": (0.0, 1.0), "k": [1, 2]}, lambda p: (p["x"] - 0.5) ** 2 + p["k"], trials=16).collect()
    assert len(rows) == 16 and min(r["value"] for r in rows) < 1.3


def test_silhouette_with_empty_blocks_and_missing_values(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(3000, 3)), rng.integers(0, 4, 3000)
    c[0] = 9
    rows = [(k, None if k in (7, 8) else int(c[k]), None if k in (8, 9) else x[k].tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, c int, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[:, [8, 9]] = 0
    want = []
    for k in range(3000):
        if k in (0, 7, 8, 9):  # alone, or label or features are missing
            want.append(0.0)
            continue
        near = {g: d[k, (c == g) & ~np.isin(np.arange(3000), (7, 8))].sum() for g in (0, 1, 2, 3, 9)}
        n = {g: int(((c == g) & ~np.isin(np.arange(3000), (7, 8))).sum()) for g in near}
        a, b = near[c[k]] / (n[c[k]] - 1), min(near[g] / n[g] for g in near if g != c[k])
        want.append((b - a) / max(a, b))
    for cut in ({}, {"left": 700, "right": 900}):
        assert M.silhouette(df, "x", "c", "id", **cut).first()["silhouette"] == pytest.approx(np.mean(want), abs=1e-9)
    assert M.silhouette(df.where("id < 2"), "x", "c", "id").first()["silhouette"] == 0
    assert M.silhouette(df.where("false"), "x", "c", "id").first()["silhouette"] is None


def test_medians_and_group_quantiles_need_no_percentile_aggregate(spark):
    rows = spark.range(50_000).select((F.col("id") * 7919 % 50_021 % 997 + F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 11).cast("double").alias("p"), F.when(F.col("id") % 5 > 0, F.lit("a")).alias("g"))
    names = ["mae", "median_ae"]
    got = M.regression_row(rows, F.col("y"), F.col("p"), names)
    want = rows.agg(*(M.regression(F.col("y"), F.col("p"))[n].alias(n) for n in names))
    assert tuple(got.first()) == pytest.approx(tuple(want.first()))
    multi = M.regression_multi(rows, {"t": ("y", "p")}, names)
    for plan in (got, multi):
        assert "percentile" not in plan._jdf.queryExecution().toString().lower() and "median(" not in plan._jdf.queryExecution().toString().lower()
    more = rows.select("g", "y").unionByName(spark.createDataFrame([("few", 1.0), ("few", 4.0), ("none", None)], "g string, y double"))
    points = [0.0, 0.05, 0.5, 0.95, 1.0]
    exact = {r["g"]: r["q"] for r in more.groupBy("g").agg(statistics.percentiles(F.col("y"), [100 * q for q in points]).alias("q")).collect()}
    for accuracy in (100, 10_000):
        quantiles = {r["g"]: r["quantiles"] for r in statistics.group_quantiles(more, ["g"], "y", points, accuracy).collect()}
        assert set(quantiles) == set(exact) == {"a", "few", "none", None} and quantiles["none"] is None
        assert all(quantiles[g] == pytest.approx(exact[g]) for g in ("a", "few", None))


def test_conformal_width_is_the_exact_order_statistic(spark):
    n = 150_001
    rows = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("y"), F.lit(0.0).alias("prediction"))
    for confidence in (0.9, 0.5, 1.0):
        assert models.conformal_width(rows, "y", confidence) == min(n, -(-(n + 1) * round(confidence * 10) // 10)) - 1
    plan = []
    real = F.percentile_approx
    F.percentile_approx = lambda c, p, a: plan.append(a) or real(c, p, a)
    try:
        models.conformal_width(rows, "y", 0.9)
    finally:
        F.percentile_approx = real
    assert all(a <= 10_000 for a in plan)  # a sketch of 100,000 from each task went to one
