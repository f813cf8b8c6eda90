"""Lags, differences, rolling statistics, interpolation, gaps and resampling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tagloom.functions import temporal
from tagloom.operators import order
from tagloom.operators.order import from_micros, micros
from tagloom.operators.spans import At, Rolling, over_spans

MINUTE = 60_000_000


def lag(column: str, k: int, w: WindowSpec, name: str) -> Column:
    return F.lag(column, k).over(w).alias(name)


def lead(column: str, k: int, w: WindowSpec, name: str) -> Column:
    return F.lead(column, k).over(w).alias(name)


def diff(column: str, k: int, w: WindowSpec, name: str) -> Column:
    return (F.col(column) - F.lag(column, k).over(w)).alias(name)


def pct_change(column: str, w: WindowSpec, name: str) -> Column:
    return (F.try_divide(F.col(column), F.lag(column, 1).over(w)) - 1).alias(name)


_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def rolling(column: str, rows: int, stat: str, w: WindowSpec, name: str, min_periods: int | None = None) -> Column:
    """Rolling statistic over the last ``rows`` rows.

    ``min_periods`` defaults to the full window; 1 allows partial windows.
    """
    frame = w.rowsBetween(-(rows - 1), Window.currentRow)
    value = _STATS[stat](column).over(frame)
    need = rows if min_periods is None else min_periods
    return F.when(F.count(column).over(frame) >= need, value).alias(name)


def rolling_time(column: str, minutes: int, stat: str, name: str, min_count: int | None = None) -> Rolling:
    """Rolling statistic over ``(t - minutes, t]`` with at least half as many values as minutes."""
    return Rolling(column, minutes * MINUTE, stat, name, max(1, minutes // 2) if min_count is None else min_count)


def at_offset(column: str, minutes: int, name: str) -> At:
    """Value at exactly ``t + minutes`` (negative: in the past), NULL when no row is there."""
    return At(column, minutes * MINUTE, name)


def time_lags(
    df: DataFrame,
    columns: Sequence[str],
    minutes: Sequence[int],
    *,
    ts: str = "ts",
    tie: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``{c}_lag{m}m``: the value ``m`` minutes earlier by time, all lags in one shuffle."""
    specs = [at_offset(c, -m, f"{c}_lag{m}m") for m in minutes for c in columns]
    return over_spans(df, specs, ts=ts, tie=tie, partition_by=partition_by, rows_per_chunk=rows_per_chunk)


def horizon_label(
    df: DataFrame,
    target: str,
    minutes: int,
    *,
    ts: str = "ts",
    tie: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    name: str = "label",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``label(t) = target(t + minutes)``."""
    return over_spans(
        df, [at_offset(target, minutes, name)], ts=ts, tie=tie, partition_by=partition_by, rows_per_chunk=rows_per_chunk
    )


def interpolate(
    df: DataFrame,
    columns: Sequence[str],
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Linear interpolation by row position; leading gaps stay, trailing gaps take the last value."""
    n = df.count()
    opts = dict(order_by=order_by, partition_by=partition_by, rows_per_chunk=rows_per_chunk, n_rows=n)
    indexed = order.settle(order.row_index(df, "__i", **opts), n, rows_per_chunk)
    ch = order.chunk(indexed, **opts)
    points = {
        c: F.when(F.col(c).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(c).cast("double").alias("v")))
        for c in columns
    }
    back = order._fill(ch, points, "forward")
    back = back.select(*indexed.columns, order.CHUNK, *[F.col(f"__f_{c}").alias(f"__prev_{c}") for c in columns])
    back = order.settle(back, n, rows_per_chunk)
    both = order._fill(replace(ch, df=back), points, "backward")

    def value(c: str) -> Column:
        prev, nxt = F.col(f"__prev_{c}"), F.col(f"__f_{c}")
        step = F.try_divide(F.col("__i") - prev["i"], nxt["i"] - prev["i"])
        inner = prev["v"] + (nxt["v"] - prev["v"]) * step
        return F.coalesce(F.col(c).cast("double"), F.when(prev.isNotNull(), F.coalesce(inner, prev["v"]))).alias(c)

    return both.select(*[value(c) if c in columns else F.col(c) for c in df.columns])


def time_gaps(
    df: DataFrame,
    ts: str,
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Add ``gap_s``: seconds since the previous row in ``order_by`` order (e.g. file order)."""

    def build(w):
        return [((micros(ts) - F.lag(micros(ts)).over(w)) / F.lit(1e6)).alias("gap_s")]

    return order.over_rows(
        df, build, order_by=order_by, partition_by=partition_by, before=1, rows_per_chunk=rows_per_chunk
    )


def sampling_stats(df: DataFrame, ts: str, *, order_by: Sequence[str], rows_per_chunk: int | None = None) -> DataFrame:
    """Span, row count, gap statistics, duplicate timestamps and the two time-quality flags."""
    gaps = time_gaps(df.select(*dict.fromkeys([ts, *order_by])), ts, order_by=order_by, rows_per_chunk=rows_per_chunk)
    stats = gaps.agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("gap_s").alias("mean_gap_s"),
        F.min("gap_s").alias("min_gap_s"),
        F.max("gap_s").alias("max_gap_s"),
        F.stddev_samp("gap_s").alias("std_gap_s"),
        (F.count(ts) - F.count_distinct(F.col(ts))).alias("dup_timestamps"),
    )
    return stats.withColumns(
        {
            "irregular": F.coalesce(F.try_divide("std_gap_s", "mean_gap_s") > 0.1, F.lit(False)),
            "non_monotonic": F.coalesce(F.col("min_gap_s") <= 0, F.lit(False)),
        }
    )


def nominal_step_minutes(df: DataFrame, ts: str, *, order_by: Sequence[str]) -> DataFrame:
    """Median gap in minutes."""
    from tagloom.operators.quantiles import quantiles

    gaps = time_gaps(df.select(*dict.fromkeys([ts, *order_by])), ts, order_by=order_by)
    table = quantiles(gaps, ["gap_s"], [0.5])
    return table.select((F.col("value") / 60).alias("step_minutes"))


def normalize_minutes(
    df: DataFrame,
    *,
    ts: str = "ts",
    tie: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Floor ``ts`` to the minute and keep the first row of each minute (and key).

    The first row is picked by a map-side combined ``min_by``, so a minute that holds
    a third of all rows costs no more than any other.
    """
    keys = list(partition_by)
    first = F.min_by(F.struct(*df.columns), F.struct(ts, *tie)).alias("r")
    kept = df.groupBy(*keys, temporal.floor_minute(ts).alias("__minute")).agg(first)
    return kept.select(*[F.col("__minute").alias(c) if c == ts else F.col(f"r.{c}").alias(c) for c in df.columns])


def second_distribution(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows per second-of-minute, the check done before minutes are normalised."""
    return df.groupBy(F.second(ts).cast("bigint").alias("second")).agg(F.count(F.lit(1)).alias("n"))


def resample(
    df: DataFrame,
    aggs: Sequence[Column],
    *,
    ts: str = "ts",
    seconds: int = 3600,
    partition_by: Sequence[str] = (),
    keep_empty: bool = True,
) -> DataFrame:
    """Aggregate into tumbling time bins starting at multiples of ``seconds``.

    Empty bins between the first and the last one are kept with NULLs.  The spine is
    generated distributed from the per-key first and last bin.
    """
    keys = list(partition_by)
    bins = df.groupBy(*keys, temporal.floor_to(ts, seconds).alias("bin")).agg(*aggs)
    if not keep_empty:
        return bins
    step = seconds * 1_000_000
    ends = bins.groupBy(*keys).agg(micros(F.min("bin")).alias("a"), micros(F.max("bin")).alias("b"))
    # long spans are first cut into blocks of bins, so that no row explodes into more than 10k
    wide = step * 10_000
    blocks = ends.withColumn("o", F.explode(F.sequence("a", "b", F.lit(wide)))).repartition(*keys, "o")
    upto = F.least(F.col("b"), F.col("o") + (wide - step))
    spine = blocks.select(
        *keys, F.explode(F.transform(F.sequence("o", upto, F.lit(step)), from_micros)).alias("bin")
    )
    return spine.join(bins, [*keys, "bin"], "left")


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    length: int = 60,
    horizon: int = 1,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Full windows of the ``length`` rows before each row, with the target ``horizon - 1`` rows on."""

    def build(w):
        vector = F.array(*[F.col(c).cast("double") for c in features])
        return [
            F.collect_list(vector).over(w.rowsBetween(-length, -1)).alias("sequence"),
            F.lead(target, horizon - 1).over(w).alias("label"),
            F.count(F.lit(1)).over(w.rowsBetween(horizon - 1, horizon - 1)).alias("__ahead"),
        ]

    out = order.over_rows(
        df, build, order_by=order_by, partition_by=partition_by,
        before=length, after=horizon - 1, rows_per_chunk=rows_per_chunk,
    )
    return out.where((F.size("sequence") == length) & (F.col("__ahead") == 1)).drop("__ahead")
