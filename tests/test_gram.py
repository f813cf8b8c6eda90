"""Products of column tiles against one expression per pair."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.operators import gram, relate


def frame(spark, n, columns, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 3))
    x = base @ rng.normal(size=(3, columns)) + rng.normal(size=(n, columns)) + 1000
    x[rng.random(x.shape) < 0.2] = np.nan
    return pd.DataFrame(x, columns=[f"x{i}" for i in range(columns)])


@pytest.mark.parametrize("tile,pairs", [(128, 4_000_000), (4, 40), (5, 1)])
def test_tiles_and_passes_equal_pandas(spark, monkeypatch, tile, pairs):
    monkeypatch.setattr(gram, "TILE", tile)
    monkeypatch.setattr(gram, "PAIRS", pairs)
    monkeypatch.setattr(relate, "FEW_PAIRS", 0)
    pdf = frame(spark, 700, 11)
    df = spark.createDataFrame(pdf).repartition(3)
    want = pdf.corr()
    got = relate.corr_matrix(df).collect()
    assert len(got) == 55 and all(abs(r["r"] - want.loc[r["var1"], r["var2"]]) < 1e-9 for r in got)
    target = relate.corr_with_target(df, "x3", top=20).collect()
    assert len(target) == 10 and all(abs(r["abs_r"] - abs(want.loc[r["column"], "x3"])) < 1e-9 for r in target)


def test_what_does_not_vary_or_meet_has_no_correlation(spark, monkeypatch):
    monkeypatch.setattr(relate, "FEW_PAIRS", 0)
    pdf = pd.DataFrame({"a": [0.1, 0.1, 0.1, None], "b": [1.0, 2.0, None, 3.0], "c": [None, None, None, 5.0], "d": [1e9, 1e9 + 1, 1e9 + 2, 1e9 + 3]})
    got = {(r["var1"], r["var2"]): r["r"] for r in relate.corr_matrix(spark.createDataFrame(pdf), list("abcd")).collect()}
    assert got.pop(("b", "d")) == pytest.approx(pdf["b"].corr(pdf["d"]))
    assert len(got) == 5 and set(got.values()) == {None}
    empty = spark.createDataFrame(pdf).where("1 = 0")
    assert {r["r"] for r in relate.corr_matrix(empty, list("abcd")).collect()} == {None}


def test_three_hundred_columns(spark, events):
    wide = events.select(*[F.when(F.col("event_id") % (i % 13 + 2) != 0, F.col("value") * (i % 7) + F.sin(F.col("event_id") * (i + 1))).alias(f"w{i}") for i in range(300)])
    relate.corr_matrix(wide.select("w0", "w1")).collect()
    start = time.time()
    assert relate.corr_matrix(wide).where("r IS NOT NULL").count() == 44_850
    assert time.time() - start < 30


def test_lagged_series_share_one_pass(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"i": range(600), "a": rng.normal(size=600)})
    pdf["b"], pdf["c"] = pdf["a"].shift(3) + 0.1 * rng.normal(size=600), rng.normal(size=600)
    pdf.loc[pdf["i"] % 11 == 0, "c"] = None
    df = spark.createDataFrame(pdf).repartition(4)
    for size in (None, 70):
        got = {(r["var1"], r["var2"], r["lag"]): r["r"] for r in relate.cross_corr(df, ["a", "b", "c"], order_by=["i"], max_lag=5, rows_per_chunk=size).collect()}
        assert len(got) == 33
        for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
            both = pdf[[x, y]].dropna().reset_index(drop=True)
            for k in range(-5, 6):
                assert got[x, y, k] == pytest.approx(both[x].corr(both[y].shift(-k)))
