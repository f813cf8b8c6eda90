"""Known truths: exact spectra, recovered coefficients, injected outliers."""

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel
from pyspark.sql import functions as F

from tagloom.operators import anomaly, forests, linear, models, series, spectrum
from tests.conftest import rows


def signal(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i bigint, x double")


@pytest.mark.parametrize("n, group_rows", [(120, 1000), (120, 16), (127, 32)])
def test_spectrum_is_exact_for_any_length(spark, n, group_rows):
    """One group, four steps, and Bluestein for a prime length."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=n) + np.sin(np.arange(n) * 2 * np.pi / 12)
    df = signal(spark, x)
    got = {round(r["frequency"] * n): r["power"] for r in spectrum.periodogram(df, "x", order_by=["i"], group_rows=group_rows).collect()}
    z = (x - x.mean()) / x.std(ddof=1)
    want = np.abs(np.fft.fft(z)) ** 2
    assert sorted(got) == [k for k in range(1, n) if np.fft.fftfreq(n)[k] > 0]
    assert all(got[k] == pytest.approx(want[k], rel=1e-8, abs=1e-8) for k in got)


def test_main_period_of_a_sine(spark):
    x = np.sin(np.arange(240) * 2 * np.pi / 24)
    table = spectrum.periodogram(signal(spark, x), "x", order_by=["i"])
    assert spectrum.main_periods(table, 240).first()["period"] == pytest.approx(24)


def test_ridge_recovers_and_matches_direct_solution(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(200, 4))
    y = x @ [2.0, 1.5, 0.8, 3.0] + 10 + rng.normal(size=200) * 0.1
    data = [(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "i bigint, a double, b double, c double, d double, y double")
    fit = linear.fit_ridge(df, ["a", "b", "c", "d"], "y", order_by=["i"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    direct = np.linalg.solve(z.T @ z + fit.alpha * np.eye(4), z.T @ (y - y.mean()))
    assert np.allclose(fit.coef, direct) and fit.intercept == pytest.approx(y.mean())
    # contiguous-fold R2 by hand for the chosen alpha
    scores = []
    for test in np.array_split(np.arange(200), 5):
        train = np.setdiff1d(np.arange(200), test)
        m, my = z[train].mean(axis=0), y[train].mean()
        w = np.linalg.solve((z[train] - m).T @ (z[train] - m) + fit.alpha * np.eye(4), (z[train] - m).T @ (y[train] - my))
        p = (z[test] - m) @ w + my
        scores.append(1 - ((y[test] - p) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
    assert fit.scores[fit.alpha] == pytest.approx(np.mean(scores))


def test_wide_moments_equal_native_ones(spark, monkeypatch):
    df = spark.range(50).select(F.sin("id").alias("a"), F.cos("id").alias("b"), F.col("id").cast("double").alias("y"), (F.col("id") % 3).alias("f"))
    native = linear.moments(df, ["a", "b"], "y", "f")
    monkeypatch.setattr(linear, "_NATIVE_FEATURES", 0)
    wide = linear.moments(df, ["a", "b"], "y", "f")
    assert all(np.allclose(native[k].gram, wide[k].gram) for k in native)


def test_descent_equals_the_full_data_loop(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(-2, 2, 50)
    y = 2 * x + 1 + rng.normal(size=50) * 0.3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = linear.descent_history(df, ["x"], "y", epochs=30, learning_rate=0.1).orderBy("epoch").collect()
    w = b = 0.0
    for r in got:
        e = w * x + b - y
        dw, db = np.mean(2 * e * x), np.mean(2 * e)
        w, b = w - 0.1 * dw, b - 0.1 * db
        assert (r["w"][0], r["b"], r["loss"]) == pytest.approx((w, b, np.mean((y - w * x - b) ** 2)))
    assert abs(w - 2) < 0.2 and abs(b - 1) < 0.2


def test_splits_expand():
    assert models.split_bounds(13, 5) == [(3, 5), (5, 7), (7, 9), (9, 11), (11, 13)]


def test_injected_outliers_rank_lowest(spark):
    rng = np.random.default_rng(0)
    data = [(i, *map(float, rng.normal(size=2))) for i in range(600)] + [(1000 + i, 9.0 + i, -9.0 - i) for i in range(3)]
    df = spark.createDataFrame(data, "i bigint, a double, b double")
    scored = anomaly.anomaly_scores(df, ["a", "b"], ["i"], contamination=0.1)
    assert {r["i"] for r in scored.orderBy("score").limit(3).collect()} == {1000, 1001, 1002}
    assert scored.where("is_anomaly").count() == pytest.approx(60, abs=2)
    again = anomaly.anomaly_scores(df.repartition(7), ["a", "b"], ["i"], contamination=0.1)
    assert rows(scored.select("i", "score")) == rows(again.select("i", "score"))


def test_components_and_clusters(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 2 * 10.0).alias("a"), (F.col("id") % 2 * 10.0 + F.rand(1)).alias("b"))
    need = anomaly.components_needed(anomaly.pca_variance(df, ["a", "b"])).first()
    assert (need["n_80"], need["n_95"]) == (1, 1)
    sizes = anomaly.cluster_sizes(anomaly.kmeans_clusters(df, ["a", "b"], k=2)).collect()
    assert sorted(r["n"] for r in sizes) == [100, 100]


def test_decomposition_of_a_known_series(spark):
    i = np.arange(84)
    x = 0.5 * i + np.tile([3.0, -1.0, -2.0, 0.0, 1.0, -2.0, 1.0], 12)
    out = series.decompose(signal(spark, x), "x", order_by=["i"], period=7).orderBy("i").collect()
    assert np.allclose([r["trend"] for r in out], 0.5 * i) and np.allclose([r["resid"] for r in out], 0, atol=1e-9)


def test_qq_of_normal_quantiles(spark):
    from statistics import NormalDist

    x = [NormalDist(5, 2).inv_cdf((k + 0.5) / 300) for k in range(300)]
    fit = series.qq_fit(series.qq_table(signal(spark, x), "x", ["i"])).first()
    assert fit["r"] > 0.999 and fit["slope"] == pytest.approx(2, rel=0.02) and fit["intercept"] == pytest.approx(5)


class Probe(Estimator):
    """A learner that notes how its training rows lie in the tasks."""

    def __init__(self, seen):
        super().__init__()
        self.seen = seen

    def _fit(self, dataset):
        self.seen.append(sorted(r["count"] for r in dataset.groupBy(F.spark_partition_id()).count().collect()))
        return SQLTransformer(statement="SELECT *, 0.0D AS prediction FROM __THIS__")


def test_training_rows_of_every_fold_are_spread_over_the_tasks(spark):
    n, seen = 4800, []
    df = spark.range(n).select("id", F.col("id").cast("double").alias("a"), F.lit(1.0).alias("y"))
    models.cross_validate(df, ["a"], "y", lambda: Probe(seen), order_by=["id"], rows_per_chunk=400)
    assert sorted(map(sum, seen)) == [n * k // 6 for k in range(1, 6)]
    assert all(len(s) >= 4 and s[-1] <= sum(s) / 2 for s in seen)


@pytest.mark.parametrize("n,group_rows", [(300, 8), (293, 8), (293, 16), (64, 3), (1000, 10), (1000, 12)])
def test_spectrum_is_exact_beyond_the_square_of_a_group(spark, n, group_rows):
    x = np.random.default_rng(n).normal(size=n)
    got = {round(r["frequency"] * n): r["power"] for r in spectrum.periodogram(signal(spark, x), "x", order_by=["i"], group_rows=group_rows).collect()}
    want = np.abs(np.fft.fft((x - x.mean()) / x.std(ddof=1))) ** 2
    assert sorted(got) == list(range(1, (n + 1) // 2))
    assert np.allclose([got[k] for k in sorted(got)], want[1 : (n + 1) // 2])


def _sloped(spark, n):
    """Two features, the second of nine values, and a label with a bend."""
    a, b = (F.xxhash64("id") % 1000 / 100).alias("a"), (F.col("id") % 9).cast("double").alias("b")
    df = spark.range(n).select(a, b).withColumn("y", F.col("a") * 3 + F.when(F.col("b") > 4, 7.0).otherwise(0.0))
    return VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)


def test_forest_of_many_rows_needs_no_more_jobs_for_deeper_trees(spark):
    """MLlib's fit reads the rows once per level."""
    df, jobs = _sloped(spark, 120_000).cache(), []
    df.count()
    for depth in (2, 6):
        spark.sparkContext.setJobGroup(f"forest-{depth}", "")
        models.forest("y", num_trees=4, max_depth=depth)().fit(df)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    spark.sparkContext._jsc.clearJobGroup()
    df.unpersist()
    assert jobs[0] == jobs[1]


def test_forest_of_cells_is_mllibs_model(spark, monkeypatch, tmp_path):
    df, fewer = _sloped(spark, 4000), models.forest("y", num_trees=20, max_depth=6)().fit(_sloped(spark, 4000))
    monkeypatch.setattr(forests, "FEW_ROWS", 0)
    fit = models.forest("y", num_trees=20, max_depth=6)().fit(df)
    again = models.forest("y", num_trees=20, max_depth=6)().fit(df)
    assert type(fit) is forests.CellForestModel and type(fewer) is RandomForestRegressionModel
    assert fit._java is None  # the driver has no trees until they are asked for
    fit.save(str(tmp_path / "model"))
    stored = RandomForestRegressionModel.load(str(tmp_path / "model"))
    assert stored.getNumTrees == 20 and max(t.depth for t in stored.trees) == 6 and stored.getMaxDepth() == 6
    wide = _sloped(spark, 300).union(VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(spark.createDataFrame([(-99.0, 50.0, 0.0), (99.0, -1.0, 0.0)], "a double, b double, y double")))
    got = rows(fit.transform(wide), "a", "b", "prediction")
    assert got == rows(stored.transform(wide), "a", "b", "prediction") == rows(again.transform(wide), "a", "b", "prediction")
    error = lambda m: linear.evaluate(m.transform(df), "y", "prediction").first()["r2"]
    assert error(fit) == pytest.approx(error(fewer), abs=0.03) and error(fit) > 0.9
    assert fit.featureImportances.toArray() == pytest.approx(fewer.featureImportances.toArray(), abs=0.1)


def test_tree_of_sums_is_mllibs_tree(spark):
    """Every row once and all features: nothing is drawn, so both trees must be the same."""
    df = _sloped(spark, 3000).withColumn("a", F.round("a")).drop("x")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df).withColumn("y", F.col("y") + F.col("a") * F.col("b"))
    fit = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=5).fit(df)
    data = df.select("a", "b", "y", F.col("a").alias("k")).toPandas()
    cuts = [forests.thresholds(data[c].to_numpy(), 32) for c in ("a", "b")]
    cell = np.searchsorted(cuts[0], data["a"]) * (len(cuts[1]) + 1) + np.searchsorted(cuts[1], data["b"])
    sums = np.stack([np.bincount(cell, v, (len(cuts[0]) + 1) * (len(cuts[1]) + 1)) for v in (np.ones(len(data)), data["y"], data["y"] ** 2)])
    nodes, means = forests.grow(sums, cuts, 5, 2, np.random.default_rng(0))
    assert len(nodes) == fit.numNodes and nodes["left"].max() < len(nodes)
    at = np.zeros(len(data), int)
    for _ in range(5):
        n = nodes.iloc[at]
        value = np.where(n["feature"] == 0, data["a"], data["b"])
        at = np.where(n["left"] < 0, at, np.where(value <= n["threshold"], n["left"], n["right"]))
    want = sorted(r["prediction"] for r in fit.transform(df).select("prediction").collect())
    assert np.allclose(np.sort(nodes["prediction"].to_numpy()[at]), want)
    assert np.array_equal(nodes["prediction"].to_numpy()[at], means[cell])


def test_rows_are_drawn_with_poisson_weights(spark, monkeypatch):
    """The rows of one crowded cell, in blocks: as many in all as there are rows, and as much spread."""
    monkeypatch.setattr(forests, "BLOCK", 700)
    n, trees = 5000, 300
    df = spark.range(n).select(F.when(F.col("id") < n - 1, 3).otherwise(5).cast("int").alias("cell"), F.col("id").cast("double").alias("y"))
    drawn = df.mapInArrow(forests._drawn(trees, 1), "tree int, part int, cells binary, sums binary").toPandas()
    weight = np.zeros((trees, 2))
    for _, r in drawn.iterrows():
        cells, sums = np.frombuffer(r["cells"], np.int32), np.frombuffer(r["sums"]).reshape(3, -1)
        weight[r["tree"], (cells == 5).astype(int)] += sums[0]
        assert np.all(sums[1] ** 2 <= sums[0] * sums[2] * (1 + 1e-9))
    assert weight[:, 0].mean() == pytest.approx(n - 1, abs=5 * (n / trees) ** 0.5) and weight[:, 0].var() == pytest.approx(n, rel=0.4)
    assert weight[:, 1].mean() == pytest.approx(1, abs=0.3) and weight[:, 1].var() == pytest.approx(1, abs=0.4)


def test_thresholds_are_between_values_or_at_equal_shares():
    assert forests.thresholds(np.array([1.0, 3.0, 3.0, 7.0]), 4).tolist() == [2.0, 5.0]
    assert forests.thresholds(np.ones(9), 4).tolist() == []
    assert forests.thresholds(np.arange(100.0), 4).tolist() == [24.5, 49.5, 74.5]
