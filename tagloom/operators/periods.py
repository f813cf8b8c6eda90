"""Operation periods, variety segments and gap-free positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import temporal
from tagloom.operators import order
from tagloom.operators.joins import interval_join


def operation_periods(extracted: DataFrame) -> DataFrame:
    """One row per run: start, end, product, equipment and row count."""
    return (
        extracted.groupBy("run_start", "product", "equipment")
        .agg(F.min("run_end").alias("run_end"), F.count(F.lit(1)).alias("data_count"))
        .select("run_start", "run_end", "product", "equipment", "data_count")
    )


def rows_by_period(rows: DataFrame, periods: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows matched to periods by time span only; the row's own equipment plays no part."""
    return interval_join(rows, periods, ts=ts)


def period_stats(rows: DataFrame, periods: DataFrame, column: str, ts: str = "ts") -> DataFrame:
    """Mean, deviation, min, max and count per period."""
    keys = ["run_start", "run_end", "product", "equipment"]
    joined = rows_by_period(rows.select(ts, column), periods.select(*keys), ts)
    return joined.groupBy(*keys).agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"), F.count(column).alias("n"),
    )


def with_segments(
    df: DataFrame,
    variety: str,
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Add ``segment_id``: 0-based number of the run of equal ``variety`` a row belongs to."""

    def build(w):
        changed = ~F.col(variety).eqNullSafe(F.lag(variety).over(w)) & (F.lag(F.lit(1)).over(w) == 1)
        return [F.coalesce(changed, F.lit(False)).cast("int").alias("__new")]

    n = df.count()
    opts = dict(order_by=order_by, partition_by=partition_by, rows_per_chunk=rows_per_chunk, n_rows=n)
    flagged = order.settle(order.over_rows(df, build, before=1, **opts), n, rows_per_chunk)
    numbered = order.running_sum(flagged, F.col("__new"), "segment_id", **opts)
    return numbered.drop("__new")


def segments(
    df: DataFrame,
    variety: str,
    *,
    ts: str = "ts",
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``segment_id, start, end, variety, n`` of each run of equal ``variety``."""
    tagged = with_segments(
        df, variety, order_by=order_by, partition_by=partition_by, rows_per_chunk=rows_per_chunk
    )
    return tagged.groupBy(*partition_by, "segment_id", F.col(variety).alias("variety")).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")
    )


def segment_positions(table: DataFrame, partition_by: Sequence[str] = (), rows_per_chunk: int | None = None) -> DataFrame:
    """Add first, last and label position of each segment on the gap-free axis."""
    opts = dict(order_by=["segment_id"], partition_by=partition_by, rows_per_chunk=rows_per_chunk)
    cum = order.running_sum(table, F.col("n"), "__upto", **opts)
    first = F.col("__upto") - F.col("n")
    return cum.withColumns(
        {"first_pos": first, "last_pos": F.col("__upto") - 1, "label_pos": first + F.floor(F.col("n") / 2)}
    ).drop("__upto")


def continuous_position(
    rows: DataFrame, *, period: Sequence[str], order_by: Sequence[str], rows_per_chunk: int | None = None
) -> DataFrame:
    """Gap-free ``position`` of every (period, row) in period order."""
    return order.row_index(rows, "position", order_by=[*period, *order_by], rows_per_chunk=rows_per_chunk)


def position_by_equipment(
    rows: DataFrame, *, equipment: str, order_by: Sequence[str], gap: int = 10, rows_per_chunk: int | None = None
) -> DataFrame:
    """Gap-free position along all equipment, ``gap`` empty places between two of them."""
    keys = [equipment, *order_by]

    def build(w):
        moved = F.lag(F.lit(1)).over(w).isNotNull() & ~F.col(equipment).eqNullSafe(F.lag(equipment).over(w))
        return [F.when(moved, 1 + gap).otherwise(1).alias("__step")]

    n = rows.count()
    opts = dict(order_by=keys, rows_per_chunk=rows_per_chunk, n_rows=n)
    stepped = order.settle(order.over_rows(rows, build, before=1, **opts), n, rows_per_chunk)
    placed = order.running_sum(stepped, F.col("__step"), "position", **opts)
    return placed.withColumn("position", F.col("position") - 1).drop("__step")


def position_bounds(positioned: DataFrame, by: Sequence[str]) -> DataFrame:
    """First, last and label position per group of rows."""
    out = positioned.groupBy(*by).agg(
        F.min("position").alias("first_pos"), F.max("position").alias("last_pos"), F.count(F.lit(1)).alias("n")
    )
    return out.withColumn("label_pos", F.col("first_pos") + F.floor(F.col("n") / 2))


def gantt(periods: DataFrame) -> DataFrame:
    """Bar per run: equipment lane, start, hours, midpoint and product."""
    return periods.select(
        "equipment", "product", "run_start",
        temporal.duration_hours("run_start", "run_end").alias("hours"),
        temporal.midpoint("run_start", "run_end").alias("midpoint"),
    )
