"""Event-time order in streams: no batch size changes an answer, late rows go to the side."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.catalogue import QUERIES
from tagloom.operators import joins
from tagloom.streaming import enrich, ordered
from tagloom.streaming.buffer import OK, TOO_SHORT, LatestRowModel, buffer_predict
from tagloom.streaming.run import run_available, with_end
from tests.conftest import DATA, rows

MODEL = LatestRowModel(["value"], [1.0], [2.0], [4.0], 3.0)
ARROW = ("spark.sql.execution.arrow.maxRecordsPerBatch",)


def answers(stream, end=None, **options):
    return run_available(ordered.ordered_predict(stream, MODEL, key="user_id", length=20, **options), end)


@pytest.mark.parametrize("size", [10, 10_000])
def test_answers_do_not_depend_on_arrow_batches(spark, events, size):
    before = {k: spark.conf.get(k) for k in ARROW}
    try:
        for k in ARROW:
            spark.conf.set(k, size)
        stream, end = with_end(spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parque[t]"))
        got = answers(stream, end, resamples=30, bucket_us=86_400_000_000)
        assert rows(got) == rows(ordered.rolling_interval(events, MODEL, key="user_id", length=20, resamples=30))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def parts(spark, events, folder, pieces):
    for p in pieces:
        p.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_disorder_within_the_delay_changes_nothing(spark, events, tmp_path):
    # files overlap in time by up to two days; a row waits for three
    span = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000
    days = events.withColumn("__p", F.floor((span - F.lit(events.agg(F.min(span)).first()[0]) + F.pmod("event_id", F.lit(3))) / 8))
    pieces = [days.where(F.col("__p") == k).drop("__p") for k in range(5)]
    stream, end = with_end(parts(spark, events, str(tmp_path / "in"), pieces))
    got = answers(stream, end, delay="3 days")
    want = buffer_predict(events, MODEL, key="user_id", order_by=["ts", "event_id"], length=20)
    keep = ["user_id", "event_id", "prediction", "status"]
    assert rows(got, *keep) == rows(want, *keep)


def test_late_rows_and_rows_without_time_are_answered_on_the_side(spark, events, tmp_path):
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    early, late = events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)
    behind = early.orderBy("ts").limit(3).withColumn("event_id", F.col("event_id") - 1000)
    lost = early.orderBy("ts").limit(2).withColumns({"event_id": F.col("event_id") - 5000, "ts": F.lit(None).cast("timestamp_ntz")})
    stream, end = with_end(parts(spark, events, str(tmp_path / "in"), [early, late.unionByName(behind).unionByName(lost)]))
    got = answers(stream, end).cache()
    assert got.where(F.col("status") == ordered.LATE).count() == 3
    assert rows(got.where("ts IS NULL"), "status", "prediction") == [(TOO_SHORT, None)] * 2
    want = buffer_predict(events, MODEL, key="user_id", order_by=["ts", "event_id"], length=20)
    keep = ["user_id", "event_id", "prediction", "status"]
    assert rows(got.where("event_id >= 0"), *keep) == rows(want, *keep)


def test_rows_of_the_delay_wait_without_an_end(spark, events):
    got = answers(spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parque[t]"), delay="5 days")
    last = events.agg(F.max("ts")).first()[0]
    waiting = events.where(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 5 DAYS")).count()
    assert 0 < waiting and got.count() == events.count() - waiting and got.where(F.col("status") == OK).count() > 0


def test_last_interval_is_the_rolling_one_at_the_last_row(events):
    every = ordered.rolling_interval(events, MODEL, key="user_id", length=20)
    last = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    want = every.join(last, ["user_id", "event_id"]).where("mean_prediction IS NOT NULL")
    keep = ["user_id", "mean_prediction", "low", "high"]
    assert rows(ordered.last_interval(events, MODEL, key="user_id", length=20), *keep) == rows(want, *keep)


@pytest.mark.parametrize("name,like", [("stream_buffer_batches", "stream_buffer"), ("stream_tumbling_batches", "stream_tumbling")])
def test_three_batches_equal_one(spark, name, like):
    assert [r for r in rows(QUERIES[name](spark, DATA)) if -1 not in r] == rows(QUERIES[like](spark, DATA))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_stream_meets_runs_of_every_length(spark, events, limit):
    runs = events.where("event_id % 50 = 0").select(
        F.col("event_type").alias("product"), F.col("event_id").cast("int").alias("equipment"), F.col("ts").alias("run_start"),
        F.when(F.col("event_id") % 100 == 0, F.lit("9999-12-31").cast("timestamp_ntz")).otherwise(F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("run_end"), F.to_date("ts").alias("run_date"))
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parque[t]").select("event_id", "ts")
    got = run_available(enrich.stream_enrich(stream, runs, broadcast_rows=limit))
    want = events.join(runs, F.col("ts").between(F.col("run_start"), F.col("run_end")))
    assert rows(got, "event_id", "equipment") == rows(want, "event_id", "equipment")


def test_runs_take_two_rows_at_most(spark):
    runs = spark.createDataFrame([("1900-01-01", "9999-12-31"), ("2024-01-01", "2024-01-01"), ("2024-01-01", "2024-01-03"), ("2024-01-03", "2024-01-01"), (None, "2024-01-01")], "a string, b string")
    runs = runs.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    pieces = joins.run_pieces(runs, "a", "b", joins.HOUR)
    assert {r["count"] for r in pieces.groupBy("a", "b").count().collect()} <= {1, 2} and pieces.select("a", "b").distinct().count() == 3
    rows_ = spark.createDataFrame([("2024-01-02",), ("2024-01-01",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert joins.interval_join(rows_, runs, ts="t", start="a", end="b").count() == 5
    assert joins.interval_join(rows_, runs.where("1 = 0"), ts="t", start="a", end="b").count() == 0


class State:
    """State of one key that counts its calls."""

    calls = 0

    def __init__(self):
        self.held = {}

    def __getattr__(self, name):
        def call(*args):
            State.calls += 1
            key = args[0] if "Key" in name or "Value" in name else None
            if name in ("update", "put", "updateValue"):
                self.held[key] = args[-1]
            elif name in ("removeKey", "clear"):
                self.held.pop(key, None)
            elif name == "keys":
                return list(self.held)
            else:
                return key in self.held if name == "exists" else self.held.get(key)

        return call


class Handle:
    """Handle and timer values at once; a watermark in days."""

    def __init__(self):
        self.timers = set()

    getValueState = getMapState = getListState = lambda self, *schema: State()

    def registerTimer(self, ms):
        State.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        State.calls += 1
        self.timers.remove(ms)

    def getCurrentWatermarkInMs(self):
        return self.now


def released(sizes, n=200, marks=(0, 40, 90, 400)):
    """Answers of one key whose rows come in Arrow batches of ``sizes`` in each of three micro-batches; the calls of the state."""
    us = pd.Series(range(n)).mul(104_729).mod(n) * 43_200_000_000  # twice a day, in no order
    all_rows = pd.DataFrame({"user_id": 7, "ts": us.astype("datetime64[us]"), "event_id": range(n), "value": [float(i % 13) for i in range(n)]})
    p, handle, out, State.calls = ordered.OrderedBuffer(MODEL, "user_id", "ts", "event_id", 20, 30, 42, ordered.BUCKET_US), Handle(), [], 0
    p.init(handle)
    spans = [(marks[k], marks[k + 1] if k < 2 else 10**6) for k in range(3)]
    for k, (low, high) in enumerate(spans):
        rows_ = all_rows[(us >= low * 86_400_000_000) & (us < high * 86_400_000_000)]
        handle.now = marks[k] * 86_400_000
        out += p.handleInputRows((7,), iter([rows_[i : i + sizes] for i in range(0, len(rows_), sizes)]), handle)
        handle.now = marks[k + 1] * 86_400_000 - 3_600_000
        for ms in sorted(t for t in handle.timers if t <= handle.now):
            handle.timers.remove(ms)
            out += p.handleExpiredTimer((7,), handle, None)
    return pd.concat(out, ignore_index=True), State.calls


def test_a_key_costs_few_calls_of_the_state():
    table, calls = released(1000)
    assert len(table) == 200 and table["ts"].is_monotonic_increasing and (table["status"] == OK).sum() == 181
    assert calls <= 3 * 6


@pytest.mark.parametrize("pack,sizes", [(5, 1000), (5, 3), (150, 30), (0, 7)])
def test_a_busy_key_waits_in_buckets_with_the_same_answers(monkeypatch, pack, sizes):
    want, _ = released(1000)
    monkeypatch.setattr(ordered, "PACK", max(pack, 1))
    pd.testing.assert_frame_equal(released(sizes)[0], want)
