"""Seeded sample tag tables, used as fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.order import from_micros, micros

# Column -> (mean, standard deviation)
SAMPLE_TAGS = {
    "temperature": (80.0, 10.0),
    "pressure": (1.5, 0.2),
    "flow_rate": (100.0, 15.0),
    "moisture": (12.0, 2.0),
}


def sample_tags(spark: SparkSession, start: str, end: str, step_minutes: int = 5, seed: int = 42) -> DataFrame:
    """Regular grid from ``start`` to ``end`` inclusive with independent normal columns."""
    first, last = (micros(F.lit(t)) for t in (start, end))
    step = step_minutes * 60_000_000
    first_us, n = spark.range(1).select(first, F.floor((last - first) / step) + 1).first()
    grid = spark.range(n).select("id", from_micros(F.lit(first_us) + F.col("id") * step).alias("ts"))
    columns = [
        (F.lit(mean) + F.lit(std) * F.randn(seed + i)).alias(name)
        for i, (name, (mean, std)) in enumerate(SAMPLE_TAGS.items())
    ]
    return grid.select("ts", *columns)
