"""Time windows and lookups must equal plain RANGE frames for any chunk size, density and skew."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.operators import order, spans
from tagloom.operators.spans import At, Rolling

SECOND, HOUR = 1_000_000, 3_600_000_000
STATS = ("mean", "sum", "std", "min", "max", "count")


def plain(df, specs, keys=(), tie=("event_id",)):
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("us")
    out = df.withColumn("us", order.micros("ts"))
    cols = []
    for s in specs:
        if isinstance(s, At):
            # the last of the tied rows is looked up by an own aggregate below
            cols.append(F.max(F.struct(*tie, F.col(s.column).alias("v"))).over(w.rangeBetween(s.shift_us, s.shift_us))["v"].alias(s.name))
            continue
        frame = w.rangeBetween(-s.span_us + 1, 0)
        stat = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}[s.stat]
        cols.append(F.when(F.count(s.column).over(frame) >= s.min_count, stat(s.column).over(frame)).alias(s.name))
    return out.select(*df.columns, *cols)


def same(df, specs, size, keys=()):
    got = spans.over_spans(df, specs, tie=["event_id"], partition_by=keys, rows_per_chunk=size)
    names = [s.name for s in specs]
    assert got.columns == [*df.columns, *names]
    pick = lambda d: d.select("event_id", *names).orderBy("event_id").toPandas().astype(float)
    # two ways of adding up differ in the last digits, not in what is missing
    pd.testing.assert_frame_equal(pick(got), pick(plain(df, specs, keys)), rtol=1e-9, atol=1e-9)


SPECS = [Rolling("v", 6 * HOUR, s, f"{s}_6h", 2) for s in STATS] + [Rolling("v", 90 * HOUR, s, f"{s}_90h") for s in ("mean", "max")] + [
    At("v", -2 * SECOND, "before"), At("v", 3 * SECOND, "behind"), At("event_id", 0, "own")
]


@pytest.fixture(scope="module")
def ev(events):
    # a third of all rows falls on one instant, another third on few; one key holds half
    ts = F.when(F.col("event_id") % 3 == 0, F.lit("2024-01-07 00:00:00").cast("timestamp_ntz")).when(F.col("event_id") % 3 == 1, F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return events.select(
        "event_id", F.when(F.col("event_id") % 2 == 0, F.lit(3)).otherwise(F.col("user_id") % 5).alias("unit"),
        F.coalesce(ts, F.col("ts")).alias("ts"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"),
    ).repartition(5).cache()


@pytest.mark.parametrize("size", [15, 120, 100_000])
@pytest.mark.parametrize("keys", [[], ["unit"]])
def test_equal_to_range_frames(ev, size, keys):
    same(ev, SPECS, size, keys)


@pytest.mark.parametrize("span", [700_000, 20_000])
def test_dense_rows_travel_twice_at_most(spark, span, monkeypatch):
    """Several rows a millisecond: windows hold most of the table or many chunks, rows still go to two chunks per reach."""
    dense = spark.range(4000).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 250).cast("timestamp_ntz").alias("ts"), F.sin("id").alias("v"))
    specs = [Rolling("v", span, s, s) for s in STATS]
    travelled = []
    spread = spans._Plan._spread

    def counted(self, members):
        out = spread(self, members)
        travelled.append(out.count())
        return out

    monkeypatch.setattr(spans._Plan, "_spread", counted)
    same(dense, specs, 100)
    same(dense, [*specs, At("v", -span, "lag")], 100)
    assert travelled[0] <= 2 * 4000 and travelled[1] <= 3 * 4000


def test_one_instant_is_aggregated_before_it_travels(spark, monkeypatch):
    rows_ = spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.when(F.col("id") % 3 == 0, 5_000_000).otherwise(F.col("id") * 10_000)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 11).cast("double").alias("v"))
    travelled = []
    spread = spans._Plan._spread
    monkeypatch.setattr(spans._Plan, "_spread", lambda self, m: travelled.append(spread(self, m).count()) or spread(self, m))
    same(rows_, [Rolling("v", 400_000, s, s) for s in STATS] + [At("v", -10_000, "lag")], 100)
    assert travelled[0] < 3 * 2100


def test_odd_rows(spark):
    data = [(1, None, 1.0, "a"), (2, "2024-01-01 00:00:00", None, "a"), (3, "2024-01-01 00:00:00", 2.0, None), (4, "2024-01-01 00:01:00", float("nan"), None), (5, "2024-01-01 00:01:00", 4.0, "a"), (6, None, None, None)]
    df = spark.createDataFrame(data, "event_id long, t string, v double, k string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    specs = [Rolling("v", 120 * SECOND, "count", "n", 0), Rolling("v", 120 * SECOND, "mean", "m"), Rolling("v", 120 * SECOND, "std", "s"), At("event_id", -60 * SECOND, "lag")]
    for size in (2, 100):
        got = {r["event_id"]: (r["n"], r["m"], r["s"], r["lag"]) for r in spans.over_spans(df, specs, tie=["event_id"], partition_by=["k"], rows_per_chunk=size).collect()}
        assert got == {1: (None,) * 4, 2: (0, None, None, None), 3: (1, 2.0, None, None), 4: (1, 2.0, None, 3), 5: (1, 4.0, None, 2), 6: (None,) * 4}
        assert spans.over_spans(df.where("1 = 0"), specs, rows_per_chunk=size).count() == 0
