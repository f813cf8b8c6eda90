"""Operating patterns, change points, decomposition and distribution reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import temporal
from tagloom.operators import order
from tagloom.operators.quantiles import quantile_values
from tagloom.session import ROWS_PER_CHUNK, setting


def operating_pattern(df: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Row count and column means by hour, weekday (Monday = 0) and month, in one aggregate."""
    hour, weekday, _, month = temporal.calendar(ts)
    parts = F.array(
        *[F.struct(F.lit(n).alias("part"), c.alias("key")) for n, c in (("hour", hour), ("weekday", weekday), ("month", month))]
    )
    spread = df.select(*columns, F.inline(parts))
    means = [F.avg(c).alias(f"mean_{c}") for c in columns]
    return spread.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), *means)


def weekend_share(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.avg(temporal.is_weekend(ts)).alias("weekend_share"))


def _series(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    return df.select(*order_by, F.col(column).cast("double").alias("x")).where("x IS NOT NULL")


def change_scores(
    df: DataFrame, column: str, *, order_by: Sequence[str], rows_per_chunk: int | None = None
) -> DataFrame:
    """Absolute change of the rolling mean and of the rolling deviation at every row.

    The window is ``min(10, n/5)`` known values.
    """
    series = _series(df, column, order_by)
    n = series.count()
    size = min(10, n // 5)

    def build(w):
        now, prev = w.rowsBetween(-(size - 1), 0), w.rowsBetween(-size, -1)
        full = (F.count("x").over(now) == size) & (F.count("x").over(prev) == size)
        delta = lambda f: F.when(full, F.abs(f("x").over(now) - f("x").over(prev)))
        return [delta(F.avg).alias("mean_change"), delta(F.stddev_samp).alias("std_change")]

    scores = order.over_rows(series, build, order_by=order_by, before=size, n_rows=n, rows_per_chunk=rows_per_chunk)
    return order.settle(scores, n, rows_per_chunk)


def change_points(
    df: DataFrame, columns: Sequence[str], *, order_by: Sequence[str], quantile: float = 0.95, rows_per_chunk: int | None = None
) -> DataFrame:
    """Rows whose change exceeds the column's own ``quantile`` of changes; columns without changes give none."""
    out = df.where("1 = 0").select(*order_by, F.lit("").alias("column"), F.lit("").alias("kind"), F.lit(0.0).alias("change"))
    for c in columns:
        scores = change_scores(df, c, order_by=order_by, rows_per_chunk=rows_per_chunk)
        limits = quantile_values(scores, ["mean_change", "std_change"], [quantile], rows_per_chunk, df.count())
        for kind, name in (("mean", "mean_change"), ("std", "std_change")):
            limit = limits[name][0]
            if limit is None:
                continue
            hits = scores.where(F.col(name) > F.lit(limit)).select(
                *order_by, F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(name).alias("change")
            )
            out = out.unionByName(hits)
    return out


def decomposition_period(n: int, span_days: int) -> int:
    """Weekly-or-shorter period for spans of two weeks, a tenth of the rows below."""
    return min(7, n // 4) if span_days >= 14 else max(2, n // 10)


def _by_index(df: DataFrame, value: str, offsets: Sequence[int]) -> DataFrame:
    """``value`` at ``idx + offset`` for every offset, in one shuffle on the index."""
    pieces = F.array(*[F.struct((F.col("idx") - o).alias("idx"), F.lit(i).alias("slot")) for i, o in enumerate(offsets)])
    moved = df.select(F.col(value).alias("__v"), F.inline(pieces))
    return moved.groupBy("idx").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("__v"))).alias(f"at{i}") for i in range(len(offsets))]
    )


def _trend(indexed: DataFrame, period: int, n: int, rows_per_chunk: int | None) -> DataFrame:
    """Centred moving average (2 x MA for even periods), NULL where it is incomplete."""
    half = period // 2
    limit = rows_per_chunk or setting(indexed.sparkSession, ROWS_PER_CHUNK)
    inner = F.col("idx").between(half, n - 1 - half)
    if 4 * half <= limit:

        def build(w):
            left = F.sum("x").over(w.rowsBetween(-half, half - 1 + period % 2))
            right = F.sum("x").over(w.rowsBetween(-half + 1 - period % 2, half))
            return [F.when(inner, (left + right) / (2 * period)).alias("trend")]

        return order.over_rows(
            indexed, build, order_by=["idx"], before=half, after=half, n_rows=n, rows_per_chunk=rows_per_chunk
        )
    # A window of a fixed share of the rows: differences of running sums instead of a frame.
    mean = indexed.agg(F.avg("x")).first()[0]
    sums = order.running_sum(
        indexed, F.col("x") - F.lit(mean), "upto", order_by=["idx"], rows_per_chunk=rows_per_chunk, n_rows=n
    )
    offsets = [half - 1 + period % 2, -half - 1, half, -half - period % 2]
    at = _by_index(sums, "upto", offsets)
    part = lambda hi, lo: F.col(f"at{hi}") - F.coalesce(F.col(f"at{lo}"), F.lit(0.0))
    value = (part(0, 1) + part(2, 3)) / (2 * period) + F.lit(mean)
    return indexed.join(at, "idx", "left").select(*indexed.columns, F.when(inner, value).alias("trend"))


def decompose(
    df: DataFrame,
    column: str,
    *,
    order_by: Sequence[str],
    ts: str | None = None,
    period: int | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Additive decomposition: ``idx, x, trend, seasonal, resid`` next to ``order_by``.

    Gaps are filled forward, then backward; the trend ends are extended by least-squares
    lines over one period of complete trend points; seasonal means sum to zero.
    """
    if period is None:
        first, last, n = df.agg(F.min(ts), F.max(ts), F.count(F.lit(1))).first()
        period = decomposition_period(n, (last - first).days)
    else:
        n = df.count()
    opts = dict(order_by=order_by, rows_per_chunk=rows_per_chunk, n_rows=n)
    series = df.select(*order_by, F.col(column).cast("double").alias("x"))
    filled = order.settle(order.fill(series, ["x"], direction="both", **opts), n, rows_per_chunk)
    indexed = order.settle(order.row_index(filled, "idx", **opts), n, rows_per_chunk)
    half = period // 2
    with_trend = order.settle(_trend(indexed, period, n, rows_per_chunk), n, rows_per_chunk)
    front, back = half, n - 1 - half
    fits = {
        "front": F.col("idx").between(front, min(front + period, back) - 1),
        "back": F.col("idx").between(max(front, back - period), back - 1),
    }
    line = lambda f, cond: f(F.when(cond, F.col("trend")), F.when(cond, F.col("idx")))
    k = with_trend.agg(
        *[e for n_, c in fits.items() for e in (line(F.regr_slope, c).alias(f"{n_}_k"), line(F.regr_intercept, c).alias(f"{n_}_n"))]
    ).first()
    extend = lambda side: F.col("idx") * F.lit(k[f"{side}_k"]) + F.lit(k[f"{side}_n"])
    trend = F.when(F.col("idx") < front, extend("front")).when(F.col("idx") > back, extend("back")).otherwise(F.col("trend"))
    full = with_trend.withColumn("trend", trend).withColumn("phase", F.col("idx") % period)
    means = full.groupBy("phase").agg(F.avg(F.col("x") - F.col("trend")).alias("s"))
    centre = means.agg(F.avg("s").alias("m"))
    seasonal = means.select("phase", (F.col("s") - centre.scalar()).alias("seasonal"))
    joined = full.join(F.broadcast(seasonal) if period <= 100_000 else seasonal, "phase")
    return joined.select(
        *order_by, "idx", "x", "trend", "seasonal", (F.col("x") - F.col("trend") - F.col("seasonal")).alias("resid")
    )


def decomposition_strength(parts: DataFrame) -> DataFrame:
    """Variance shares of trend and season, and the two flags (> 0.3, > 0.1)."""
    v = parts.agg(*[F.var_samp(c).alias(c) for c in ("trend", "seasonal", "resid")])
    total = F.col("trend") + F.col("seasonal") + F.col("resid")
    share = lambda c: F.try_divide(F.col(c), total)
    return v.select(
        share("trend").alias("trend_share"), share("seasonal").alias("seasonal_share"),
        (share("trend") > 0.3).alias("strong_trend"), (share("seasonal") > 0.1).alias("clear_season"),
    )


def custom_variable(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, deviation, extremes, population skewness and excess kurtosis."""
    median = quantile_values(df, [column], [0.5])[column][0]
    return df.agg(
        F.avg(column).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"),
        F.max(column).cast("double").alias("max"),
        F.skewness(column).alias("skew"),
        F.kurtosis(column).alias("kurtosis"),
    )


def period_vs_overall(df: DataFrame, columns: Sequence[str], start: str, end: str, ts: str = "ts") -> DataFrame:
    """Column means inside ``[start, end]`` against the overall means, with difference and percent."""
    inside = F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    means = [
        F.struct(F.lit(c).alias("column"), F.avg(F.when(inside, F.col(c))).alias("period_mean"), F.avg(c).alias("overall_mean"))
        for c in columns
    ]
    diff = F.col("period_mean") - F.col("overall_mean")
    return df.agg(F.array(*means).alias("m")).select(F.inline("m")).select(
        "*", diff.alias("diff"), (F.try_divide(diff, "overall_mean") * 100).alias("diff_pct")
    )


@F.pandas_udf(T.DoubleType())
def normal_quantile(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    inverse = NormalDist().inv_cdf
    for p in batches:
        yield p.map(inverse)


def qq_table(df: DataFrame, column: str, tie: Sequence[str], rows_per_chunk: int | None = None) -> DataFrame:
    """Ordered values with the normal quantile of their plotting position."""
    series = df.select(F.col(column).cast("double").alias("value"), *tie).where("value IS NOT NULL")
    n = series.count()
    indexed = order.row_index(series, "idx", order_by=["value", *tie], rows_per_chunk=rows_per_chunk, n_rows=n)
    i = F.col("idx") + 1
    edge = 0.5 ** (1 / n)
    position = F.when(i == n, F.lit(edge)).when(i == 1, F.lit(1 - edge)).otherwise((i - 0.3175) / (n + 0.365))
    return indexed.withColumn("position", position).select("idx", "value", "position", normal_quantile("position").alias("quantile"))


def qq_fit(table: DataFrame) -> DataFrame:
    return table.agg(
        F.regr_slope("value", "quantile").alias("slope"),
        F.regr_intercept("value", "quantile").alias("intercept"),
        F.corr("value", "quantile").alias("r"),
    )
