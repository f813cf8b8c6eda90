"""The chunked forms must equal the plain global window for any chunk size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.operators import order
from tests.conftest import rows

SIZES = [40, 333]


@pytest.fixture(scope="module")
def ev(events):
    # one equipment holds more than a third of all rows, one instant a tenth
    hot = F.when(F.col("event_id") % 5 < 2, F.lit(3)).otherwise(F.col("user_id"))
    ts = F.when(F.col("event_id").between(200, 300), F.lit("2024-01-07 00:00:00").cast("timestamp_ntz"))
    return events.select(
        "event_id",
        hot.alias("unit"),
        F.coalesce(ts, F.col("ts")).alias("ts"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"),
    ).repartition(5)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("keys", [[], ["unit"]])
def test_index_sum_and_fill(ev, size, keys):
    w = Window.partitionBy(*keys).orderBy("ts", "event_id") if keys else Window.orderBy("ts", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    opts = dict(order_by=["ts", "event_id"], partition_by=keys, rows_per_chunk=size)
    got = order.row_index(ev, "idx", **opts)
    assert rows(got, "event_id", "idx") == rows(ev.select("event_id", (F.row_number().over(w) - 1).alias("idx")))
    got = order.running_sum(ev, F.col("v"), "s", **opts)
    want = ev.select("event_id", F.round(F.coalesce(F.sum("v").over(run), F.lit(0.0)), 4).alias("s"))
    assert rows(got.select("event_id", F.round("s", 4).alias("s"))) == rows(want)
    for direction, expr in {
        "forward": F.last("v", True).over(run),
        "backward": F.first("v", True).over(rest),
        "both": F.coalesce(F.last("v", True).over(run), F.first("v", True).over(rest)),
    }.items():
        got = order.fill(ev, ["v"], direction=direction, **opts)
        assert rows(got, "event_id", "v") == rows(ev.select("event_id", expr.alias("v")))


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("keys", [[], ["unit"]])
def test_halos(ev, size, keys):
    def by_row(w):
        return [
            F.lag("v", 12).over(w).alias("lag"),
            F.lead("v", 5).over(w).alias("lead"),
            F.avg("v").over(w.rowsBetween(-9, 3)).alias("ma"),
        ]

    def by_time(w):
        return [
            F.sum("event_id").over(w.rangeBetween(-3_600_000_000, 0)).alias("hour"),
            F.count("v").over(w.rangeBetween(1, 7_200_000_000)).alias("ahead"),
        ]

    plain = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    got = order.over_rows(
        ev, by_row, order_by=["ts", "event_id"], partition_by=keys, before=12, after=5, rows_per_chunk=size
    )
    assert rows(got) == rows(ev.select("*", *by_row(plain.orderBy("ts", "event_id"))))
    got = order.over_time(
        ev, by_time, ts="ts", tie=["event_id"], partition_by=keys,
        before_us=3_600_000_000, after_us=7_200_000_000, rows_per_chunk=size,
    )
    assert rows(got) == rows(ev.select("*", *by_time(plain.orderBy(order.micros("ts")))))


def test_chunks_stay_small(ev):
    ch = order.chunk(ev, ["ts", "event_id"], ["unit"], rows_per_chunk=50)
    sizes = [r["count"] for r in ch.df.groupBy(order.CHUNK).count().collect()]
    assert sum(sizes) == ev.count() and max(sizes) < 250 and len(sizes) > 8
