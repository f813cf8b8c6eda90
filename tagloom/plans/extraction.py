"""Schedule x tags: extraction and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.aggregates import describe
from tagloom.operators.joins import enrich_by_schedule
from tagloom.operators.periods import operation_periods
from tagloom.sources.readers import schedule_runs


def extract(tags: DataFrame, schedule: DataFrame, ts: str = "ts") -> DataFrame:
    """Tag rows inside any scheduled run, with the run's five columns."""
    return enrich_by_schedule(tags, schedule_runs(schedule), ts=ts)


def extraction_counts(extracted: DataFrame) -> DataFrame:
    """Row counts by product, equipment and day in one aggregate: ``part, key, n``."""
    parts = F.array(
        *[
            F.struct(F.lit(part).alias("part"), F.col(c).cast("string").alias("key"))
            for part, c in (("product", "product"), ("equipment", "equipment"), ("day", "run_date"))
        ]
    )
    spread = extracted.select(F.inline(parts)).where("key IS NOT NULL")
    return spread.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))


def extraction_summary(extracted: DataFrame, columns, ts: str = "ts") -> dict[str, DataFrame]:
    """Totals, counts, numeric statistics (equipment left out) and the operation periods."""
    totals = extracted.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return {
        "totals": totals,
        "counts": extraction_counts(extracted),
        "statistics": describe(extracted, columns),
        "periods": operation_periods(extracted),
    }
