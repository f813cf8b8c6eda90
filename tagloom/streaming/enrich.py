"""Stateless and windowed streaming forms of schedule enrichment and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.joins import levels_of, row_places, run_pieces
from tagloom.session import BROADCAST_ROWS, setting

HOUR = 3_600_000_000


def stream_enrich(stream: DataFrame, runs: DataFrame, ts: str = "ts", salts: int = 8, broadcast_rows: int | None = None) -> DataFrame:
    """Rows of a stream with the runs they fall in (stream-static join, no state).

    The index of runs is broadcast when counted small.  Otherwise the join is shuffled; a stream's hot buckets are not
    known beforehand and its plan is not adapted, so every bucket is dealt over ``salts`` tasks.
    """
    columns = ["product", "equipment", "run_start", "run_end", "run_date"]
    pieces = run_pieces(runs.select(*columns), "run_start", "run_end", HOUR)
    limit = setting(stream.sparkSession, BROADCAST_ROWS) if broadcast_rows is None else broadcast_rows
    placed, keys = row_places(stream, ts, levels_of(pieces), HOUR), ["__level", "__b"]
    if pieces.limit(limit + 1).count() <= limit:
        pieces = F.broadcast(pieces)
    else:
        keys.append("__salt")
        placed = placed.withColumn("__salt", F.pmod(F.xxhash64(*stream.columns), F.lit(salts)).cast("int"))
        pieces = pieces.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    joined = placed.join(pieces, keys).where(F.col(ts).between(F.col("run_start"), F.col("run_end")))
    return joined.select(*stream.columns, *columns)


def stream_tumbling(
    stream: DataFrame, aggs: Sequence[Column], *, ts: str = "ts", window: str = "1 hour", delay: str = "10 minutes",
    by: Sequence[str] = (),
) -> DataFrame:
    """Tumbling aggregate that emits a window once the watermark has passed it."""
    timed = stream.withColumn("__et", F.col(ts).cast("timestamp")).withWatermark("__et", delay)
    grouped = timed.groupBy(F.window("__et", window), *by).agg(*aggs)
    rest = [c for c in grouped.columns if c not in ("window", *by)]
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("bin"), *by, *rest)
