"""Readers for tag data, schedules and extracted tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import temporal
from tagloom.functions.scalars import nan_to_null

SCHEDULE_COLUMNS = ["date", "product", "equipment", "start_time", "sep", "next_day", "end_time", "total", "note"]


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    encoding: str = "UTF-8",
    timestamp_format: str | None = None,
) -> DataFrame:
    """CSV with header.  Give a schema for large inputs: inference is one more pass."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.option("preferDate", False)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
        reader = reader.option("timestampNTZFormat", timestamp_format)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = nan_to_null(reader.csv(path))
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_to_null(reader.json(path))


def read_tags(spark: SparkSession, path: str, schema=None, encoding: str = "UTF-8") -> DataFrame:
    """Wide tag CSV: the time column is found by type or name, parsed and named ``ts``."""
    df = read_csv(spark, path, schema, encoding=encoding)
    time_column = temporal.find_time_column(df)
    ts = F.col(time_column)
    if isinstance(df.schema[time_column].dataType, T.StringType):
        ts = temporal.parse_or_null(ts)
    rest = [c for c in df.columns if c != time_column]
    return df.select(ts.cast("timestamp_ntz").alias("ts"), *rest)


def schedule_runs(schedule: DataFrame) -> DataFrame:
    """Nine-column schedule to runs with start and end; rows that lack a time are left out."""
    runs = schedule.select(
        "product",
        "equipment",
        *temporal.run_bounds(F.col("date"), F.col("start_time"), F.col("end_time"), F.col("next_day")),
        F.col("date").alias("run_date"),
    )
    return runs.where("run_start IS NOT NULL AND run_end IS NOT NULL")


def read_schedule(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Operation schedule CSV: the header and the sub-header row below it are dropped.

    A sheet is one small file, so it is read unsplit; the sub-header is recognised as
    the row without a valid date.
    """
    names = ", ".join(f"{c} STRING" for c in SCHEDULE_COLUMNS)
    raw = spark.read.option("header", True).option("enforceSchema", True).option("encoding", encoding)
    sheet = raw.schema(names).csv(path)
    date = F.coalesce(*[F.try_to_timestamp("date", F.lit(f)) for f in temporal.MIXED_DATE_FORMATS])
    typed = sheet.withColumn("date", date.cast("date")).withColumn("equipment", F.col("equipment").try_cast("int"))
    return typed.where(F.col("date").isNotNull())


def read_extracted(spark: SparkSession, path: str, tag_schema: str) -> DataFrame:
    """Re-load an extracted table written as CSV with its types."""
    schema = (
        f"ts TIMESTAMP_NTZ, {tag_schema}, product STRING, equipment INT, "
        "run_start TIMESTAMP_NTZ, run_end TIMESTAMP_NTZ, run_date DATE"
    )
    return read_csv(spark, path, schema)
