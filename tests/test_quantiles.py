import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import quantiles as q

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """Heavy repeats, gaps and an empty column."""
    i = F.col("id")
    return spark.range(4000, numPartitions=4).select(
        F.when(i % 3 == 0, 7.0).otherwise((i * 7919) % 4001 / 3).alias("a"),
        F.when(i % 5 != 0, F.sqrt(i.cast("double"))).alias("b"),
        F.lit(None).cast("double").alias("nothing"),
        (i % 2).alias("g"),
    )


def test_bracketed_equals_numpy(skewed):
    got = q.quantile_values(skewed, ["a", "b", "nothing"], PROBS, rows_per_chunk=300)
    data = skewed.toPandas()
    for c in ("a", "b"):
        assert np.allclose(got[c], np.quantile(data[c].dropna(), PROBS), rtol=0, atol=1e-12)
    assert got["nothing"] == [None] * len(PROBS)


def test_grouped_by_rank_equals_built_in(skewed):
    small = q.quantiles(skewed, ["a", "b"], PROBS, by=["g"])
    ranked = q.quantiles(skewed, ["a", "b"], PROBS, by=["g"], rows_per_chunk=300)
    key = lambda df: sorted((r["g"], r["column"], r["p"], round(r["value"], 9)) for r in df.collect())
    assert key(small) == key(ranked)


def test_unproved_bracket_falls_back(skewed, monkeypatch):
    monkeypatch.setattr(q, "_ACCURACY", 3)
    got = q.quantile_values(skewed, ["a"], [0.4, 0.6], rows_per_chunk=300)
    assert np.allclose(got["a"], np.quantile(skewed.toPandas()["a"], [0.4, 0.6]))
