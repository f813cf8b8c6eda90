"""Registration of queries with their SQL oracles, and the tables they read.

``tags`` is the event table seen as a wide tag table: unit = user, product = event
type, a PV/SV pair, a flow with gaps, a pressure and a moisture target.  All of it is
derived from the given rows, so it grows with them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import configure
from tagloom.sources.readers import schedule_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        run.family = fn.__module__.rsplit(".", 1)[-1]
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def R(col: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: R(c, digits) for c in columns})


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def tags(self) -> DataFrame:
        k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
        e, v = F.col("event_id"), F.col("value")
        gap = (e % 7 == 0) | (e < 3) | (F.col("ts") >= F.lit("2024-01-30 23:30:00").cast("timestamp_ntz"))
        return self.events.select(
            "event_id", "ts", F.col("user_id").alias("unit"), F.col("event_type").alias("product"),
            v.alias("temp_PV"), k.alias("temp_SV"), F.when(~gap, v * 0.5 + k).alias("flow_rate"),
            (k * 0.1 + (e % 24)).alias("pressure"), (v * 0.3 - k * 0.05 + (e % 24) * 0.5).alias("moisture"),
        )

    @cached_property
    def minutes(self) -> DataFrame:
        from tagloom.operators.windows import normalize_minutes

        return normalize_minutes(self.tags, tie=["event_id"])

    @cached_property
    def schedule(self) -> DataFrame:
        days = self.spark.range(30).select(F.expr("date_add(DATE'2024-01-01', CAST(id AS INT))").alias("date"))
        cells = F.array(
            F.struct(F.lit("H").alias("product"), F.lit(1).alias("equipment"), F.lit("08:00:00").alias("start_time"),
                     F.lit("").alias("next_day"), F.lit("16:00:00").alias("end_time")),
            F.struct(F.lit("L").alias("product"), F.lit(2).alias("equipment"), F.lit("22:00:30").alias("start_time"),
                     F.lit("翌").alias("next_day"), F.lit("06:00:00").alias("end_time")),
        )
        odd = self.spark.createDataFrame(
            [("M", 3, "09:00:00", "", None, "2024-01-05"), ("S", 3, "09:00:00", "", "10:00:00", "2025-06-01")],
            "product string, equipment int, start_time string, next_day string, end_time string, date string",
        ).withColumn("date", F.col("date").cast("date"))
        return days.select("date", F.inline(cells)).unionByName(odd)

    @cached_property
    def runs(self) -> DataFrame:
        return schedule_runs(self.schedule)

    @cached_property
    def unit_runs(self) -> DataFrame:
        """One two-hour run per signup on the unit that made it: a schedule as long as the data."""
        starts = self.events.where("event_type = 'signup'")
        end = F.col("ts") + F.expr("INTERVAL 2 HOURS")
        return starts.select(F.col("user_id").alias("unit"), F.col("event_id").alias("run_id"), F.col("ts").alias("run_start"), end.alias("run_end"))


TAGS = """tags AS (
  SELECT event_id, ts, user_id AS unit, event_type AS product, value AS "temp_PV", k AS "temp_SV",
    CASE WHEN NOT (event_id % 7 = 0 OR event_id < 3 OR ts >= TIMESTAMP '2024-01-30 23:30:00')
         THEN value * 0.5 + k END AS flow_rate,
    k * 0.1 + (event_id % 24) AS pressure,
    value * 0.3 - k * 0.05 + (event_id % 24) * 0.5 AS moisture
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events))"""

MINUTES = TAGS + """, minutes AS (
  SELECT event_id, date_trunc('minute', ts) AS ts, unit, product, "temp_PV", "temp_SV", flow_rate, pressure, moisture
  FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) AS rn FROM tags)
  WHERE rn = 1)"""

RUNS = """runs AS (
  SELECT product, equipment, run_start, run_end, run_date FROM (
    SELECT 'H' AS product, 1 AS equipment, d + INTERVAL 8 HOUR AS run_start, d + INTERVAL 16 HOUR AS run_end, CAST(d AS DATE) AS run_date
    FROM (SELECT TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS d FROM range(30) t(i))
    UNION ALL
    SELECT 'L', 2, d + INTERVAL 22 HOUR, d + INTERVAL 30 HOUR, CAST(d AS DATE)
    FROM (SELECT TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS d FROM range(30) t(i))
    UNION ALL
    SELECT 'S', 3, TIMESTAMP '2025-06-01 09:00:00', TIMESTAMP '2025-06-01 10:00:00', DATE '2025-06-01'))"""

EXTRACTED = TAGS + ", " + RUNS + """, extracted AS (
  SELECT t.*, r.product AS run_product, r.equipment, r.run_start, r.run_end, r.run_date
  FROM tags t JOIN runs r ON t.ts BETWEEN r.run_start AND r.run_end)"""
