"""Grouped statistics, counts, duplicates and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.scalars import numeric_columns
from tagloom.operators.quantiles import in_parts, per_column, quartiles


def cv(column: str | Column) -> Column:
    """Coefficient of variation, sample standard deviation."""
    return F.try_divide(F.stddev_samp(column), F.avg(column))


def value_range(column: str | Column) -> Column:
    return F.max(column) - F.min(column)


def grouped(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], where: Column | str | None = None) -> DataFrame:
    """Group and aggregate; rows with a missing key are left out."""
    kept = df if where is None else df.where(where)
    return kept.dropna(subset=list(by)).groupBy(*by).agg(*aggs)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``value, n`` by falling count, ties by value; missing values are not counted."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )
    return counts if top is None else counts.limit(top)


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct count, mode, its count and its share of all rows, one row per column.

    All columns are counted in one pass over an unpivoted view.
    """
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", F.col("value"))).alias("b")
    top = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.max("n").alias("mode_count"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
    )
    return top.withColumn("n_rows", n.scalar()).withColumn("mode_share", F.col("mode_count") / F.col("n_rows")).drop("n_rows")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, q25, q50, q75, max per numeric column."""
    columns = list(columns or numeric_columns(df))
    num = lambda c: F.col(c).cast("double")
    base = per_column(
        df, columns,
        {
            "count": F.count,
            "mean": lambda c: F.avg(num(c)),
            "std": lambda c: F.stddev_samp(num(c)),
            "min": lambda c: F.min(num(c)),
            "max": lambda c: F.max(num(c)),
        },
    )
    q = quartiles(df, columns)
    return base.join(F.broadcast(q), "column", "left")  # one row per column on both sides


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one (missing values compare equal), and their share."""
    keys = list(columns or df.columns)
    copies = in_parts(df.select(*keys), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return copies.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"),
    ).withColumn("duplicate_ratio", F.coalesce(F.try_divide("n_duplicates", "n_rows"), F.lit(0.0)))


def duplicate_timestamps(df: DataFrame, ts: str) -> DataFrame:
    counts = df.where(F.col(ts).isNotNull()).groupBy(ts).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def weighted_mean(weights: Mapping[str, float]) -> Column:
    """Row-wise weighted mean of columns."""
    total = sum(weights.values())
    terms = [F.col(c) * F.lit(float(w)) for c, w in weights.items()]
    return sum(terms[1:], terms[0]) / F.lit(float(total))


def union_rows(*frames: DataFrame) -> DataFrame:
    """Stack by column name; columns a frame lacks become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_keyed(frames: Mapping[str, DataFrame], key: str = "source") -> DataFrame:
    return union_rows(*[f.withColumn(key, F.lit(name)) for name, f in frames.items()])


def keep_first(df: DataFrame, by: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row of each key, combined map-side."""
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct(*order_by)).alias("r"))
    return picked.select("r.*")


def keep_extreme_hours(df: DataFrame, ts: str) -> DataFrame:
    """Hours with the most and the fewest rows, the earlier one on ties."""
    counts = df.groupBy(F.hour(ts).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"),
        F.min_by("hour", F.struct("n", "hour")).alias("min_hour"),
    )


def bottom_k(df: DataFrame, column: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(column), *tie).limit(k)


def top_k_abs(df: DataFrame, column: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(F.abs(F.col(column))), *tie).limit(k)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows by smallest seeded hash of a unique key: repeatable on re-runs."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
