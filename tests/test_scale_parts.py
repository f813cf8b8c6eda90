"""Dictionary, forest sample, density and spectrum where the data are many, equal or far apart."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.functions import scalars
from tagloom.operators import anomaly, features, plotdata, spectrum
from tests.conftest import rows


def test_codes_are_the_same_on_both_ways(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "often").when(F.col("id") % 11 > 0, F.concat(F.lit("v"), F.col("id") % 4000)).alias("c"))
    few, many = (scalars.category_codes(df, "c", limit=k, rows_per_chunk=300) for k in (10_000, 10))
    assert few.schema == many.schema and rows(few) == rows(many)
    assert many.where("c IS NULL").agg(F.count("c_code")).first()[0] == 0


def test_a_hundred_thousand_categories(spark):
    df = spark.range(150_000).select("id", F.format_string("%06d", F.col("id") % 100_000).alias("c"))
    got = scalars.category_codes(df, "c")
    assert got.where(F.col("c_code") == F.col("c").cast("int")).count() == 150_000


def test_long_dummies_equal_columns(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id long, line_id string")
    wide = df.select("id", *features.line_dummies(df))
    ones = [(r["id"], c) for r in wide.collect() for c in wide.columns[1:] if r[c]]
    assert sorted((r["id"], r["feature"]) for r in features.line_dummies_long(df, ["id"]).collect()) == sorted(ones)
    assert features.line_dummies_long(df.drop("line_id"), ["id"]).count() == 0


def trees(df, **options):
    f = anomaly.fit_isolation_forest(df, ["a", "b"], ["i"], trees=20, **options)
    return f.sample_size, [{k: v.tolist() for k, v in t.items()} for t in f.trees]


def test_forest_depends_on_keys_alone(spark):
    df = spark.range(5000).select(F.col("id").alias("i"), F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    one = trees(df, sample_size=64)
    assert one[0] == 64 and len(one[1]) == 20
    assert trees(df.repartition(7), sample_size=64) == one
    assert trees(df.union(df), sample_size=64) == one
    third = df
    for _ in range(4):
        third = third.union(df.where("i < 500"))
    assert trees(third, sample_size=64) == one


def test_forest_of_fewer_keys_than_a_sample(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0 + 2e-16), (3, 5.0, 1.0)], "i long, a double, b double")
    size, built = trees(df)
    assert size == 3 and len(built) == 20
    assert anomaly.anomaly_scores(df, ["a", "b"], ["i"]).count() == 3


@pytest.mark.parametrize("kind", ["normal", "ties", "far"])
def test_density_equals_the_sum_over_all_values(spark, kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(10, 3, 3000), "ties": np.repeat([1.0, 2.0, 2.5], [700, 200, 100]), "far": np.append(rng.normal(size=500), [5e4, -3e4])}[kind]
    got = plotdata.density(spark.createDataFrame(pd.DataFrame({"v": x})).repartition(3), "v", points=200).orderBy("i").toPandas()
    band = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-(((got["x"].to_numpy()[:, None] - x) / band) ** 2) / 2).sum(1) / (len(x) * band * np.sqrt(2 * np.pi))
    assert len(got) == 200 and np.abs(got["density"] - want).max() < 1e-9 / band


@pytest.mark.parametrize("n", [2, 3, 64, 97, 1000, 4096, 2003])
def test_every_length_goes_by_strips(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "re": x, "im": np.zeros(n)})).repartition(3)
    got = spectrum.fft(df, n).orderBy("k").toPandas()
    assert np.allclose(got["re"] + 1j * got["im"], np.fft.fft(x), atol=1e-8)


def test_no_group_holds_the_series():
    for n in (100_000, 262_144):
        n1, n2 = spectrum._factors(n, 8 * int(n**0.5))
        assert spectrum._strip(n1, n2) * n1 <= n / 10 and spectrum._strip(n2, n1) * n2 <= n / 10


def test_distinct_counts_in_parts(spark, monkeypatch):
    from tagloom.operators import aggregates, quality, quantiles

    monkeypatch.setattr(quantiles, "ROWS_PER_GROUPING", 50)
    df = spark.range(400).selectExpr("id AS k", "IF(id % 5 = 0, NULL, id % 7) AS a", "IF(id < 390, 'x', 'y') AS b", "CAST(NULL AS DOUBLE) AS e", "1.0D AS d")
    found = quality.column_profile(df, ["k"])
    assert {r["column"]: r["n_distinct"] for r in found.collect()} == {"k": 400, "a": 7, "b": 2, "e": 0, "d": 1}
    plan = found._jdf.queryExecution().toString()
    assert "Expand" not in plan and "hashpartitioning" in plan
    twice = df.union(df.where("k % 4 = 0")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    assert aggregates.duplicate_rows(twice).first()["n_duplicates"] == 100
    constant = quality.quality_checks(df).where("kind = 'constant_column'")
    assert {r["column"]: r["value"] for r in constant.collect()} == {"e": 0.0, "d": 1.0}
    assert "Expand" not in constant._jdf.queryExecution().toString()
