"""Date/time detection, parsing and calendar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.order import from_micros, micros

# Name fragments that mark a time column, and the mixed formats accepted.
TIME_NAME_PARTS = ["time", "timestamp", "時刻", "時間", "date"]
MIXED_DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "yyyy/M/d"]
MIXED_TIME_FORMATS = ["H:mm", "h:mm a", "H:mm:ss"]


def _ntz(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def parse_or_null(text: Column, fmt: str | None = None) -> Column:
    """Timestamp, or NULL where the text does not parse."""
    return _ntz(F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text))


def parse_any(text: Column, formats: Sequence[str]) -> Column:
    """First format that parses."""
    return F.coalesce(*[parse_or_null(text, f) for f in formats])


def combine_date_time(date: Column, time: Column, fmt: str = "yyyy/M/d H:mm:ss") -> Column:
    return parse_or_null(F.concat_ws(" ", date, time), fmt)


def parse_mixed(date: Column, time: Column) -> Column:
    """Date and time texts in any of the accepted formats, joined to one timestamp."""
    formats = [f"{d} {t}" for d in MIXED_DATE_FORMATS for t in MIXED_TIME_FORMATS]
    return parse_any(F.concat_ws(" ", date, time), formats)


def from_parts(year, month, day, hour, minute) -> Column:
    return F.make_timestamp_ntz(year, month, day, hour, minute, F.lit(0))


def detect_timestamp_columns(df: DataFrame) -> list[str]:
    """String columns that hold values, all of which parse as timestamps; every row counts, in one aggregate."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []
    bad = lambda c: F.count_if(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull())
    row = df.agg(*[F.struct(bad(c).alias("bad"), F.count(c).alias("n")).alias(c) for c in texts]).first()
    return [c for c in texts if row[c]["n"] > 0 and row[c]["bad"] == 0]


def detect_timestamps(df: DataFrame) -> DataFrame:
    """Convert the columns found by :func:`detect_timestamp_columns`."""
    return df.withColumns({c: parse_or_null(F.col(c)) for c in detect_timestamp_columns(df)})


def find_time_column(df: DataFrame) -> str:
    """A timestamp-typed column, else one named like a time, else the first column."""
    typed = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    named = [c for c in df.columns if any(k in c.lower() for k in TIME_NAME_PARTS)]
    return (typed + named + df.columns)[0]


def floor_minute(ts: str | Column) -> Column:
    return from_micros(micros(ts) - F.pmod(micros(ts), F.lit(60_000_000)))


def floor_to(ts: str | Column, seconds: int) -> Column:
    return from_micros(micros(ts) - F.pmod(micros(ts), F.lit(seconds * 1_000_000)))


def calendar(ts: str) -> list[Column]:
    """Hour, weekday (Monday = 0), day of month, month."""
    c = F.col(ts)
    return [
        F.hour(c).cast("bigint").alias("hour"),
        F.weekday(c).cast("bigint").alias("day_of_week"),
        F.dayofmonth(c).cast("bigint").alias("day_of_month"),
        F.month(c).cast("bigint").alias("month"),
    ]


def is_weekend(ts: str) -> Column:
    return (F.weekday(F.col(ts)) >= 5).cast("int")


def is_night(ts: str) -> Column:
    hour = F.hour(F.col(ts))
    return ((hour >= 22) | (hour <= 6)).cast("int")


def duration_hours(start: str, end: str) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def midpoint(start: str, end: str) -> Column:
    return from_micros(micros(start) + F.floor((micros(end) - micros(start)) / 2))


def run_bounds(date: Column, start: Column, end: Column, next_day: Column) -> list[Column]:
    """Schedule cells to run_start/run_end: seconds dropped, '翌' ends on the next day."""
    at = lambda t: parse_or_null(F.concat_ws(" ", date.cast("string"), F.substring(t, 1, 5)), "yyyy-MM-dd HH:mm")
    extra = F.when(next_day == "翌", F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    present = date.isNotNull() & start.isNotNull() & end.isNotNull()
    return [
        F.when(present, at(start)).alias("run_start"),
        F.when(present, at(end) + extra).alias("run_end"),
    ]
