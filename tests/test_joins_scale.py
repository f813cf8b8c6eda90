"""Every form of a join must give the same rows, also with a hot key."""

import pytest
from pyspark.sql import functions as F

from tagloom.operators import joins
from tests.conftest import rows


@pytest.fixture(scope="module")
def sides(events):
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).alias("unit")
    ev = events.select("event_id", "ts", hot)
    runs = ev.where("event_id % 9 = 0").select(
        "unit", F.col("event_id").alias("run"), F.col("ts").alias("run_start"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("run_end")
    )
    return ev, runs


@pytest.mark.parametrize("options", [dict(broadcast_rows=0, hot_rows=5), dict(broadcast_rows=0, hot_rows=10**6), dict()])
def test_interval_join_forms(sides, options):
    ev, runs = sides
    naive = ev.join(runs.withColumnRenamed("unit", "u"), (F.col("unit") == F.col("u")) & F.col("ts").between(F.col("run_start"), F.col("run_end")))
    got = joins.interval_join(ev, runs, on=["unit"], **options)
    assert rows(got, "event_id", "run") == rows(naive, "event_id", "run")


@pytest.mark.parametrize("size", [20, 100])
def test_asof_forms(sides, events, size):
    ev, _ = sides
    right = events.where("event_type = 'view'").select("ts", F.col("user_id").alias("unit"), "value")
    plain = joins.asof(ev, right, "ts", by=["unit"], left_tie=["event_id"], right_tie=["value"])
    cut = joins.asof(ev, right, "ts", by=["unit"], left_tie=["event_id"], right_tie=["value"], rows_per_chunk=size)
    assert rows(plain, "event_id", "value") == rows(cut, "event_id", "value")
