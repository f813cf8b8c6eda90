import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.catalogue import QUERIES
from tagloom.streaming import buffer, enrich
from tagloom.streaming.run import run_available
from tests.conftest import DATA, rows

MODEL = buffer.LatestRowModel(["value"], [1.0], [2.0], [4.0], 3.0)


def batch(*minutes):
    ts = pd.to_datetime([f"2024-01-01 00:{m:02d}" for m in minutes])
    return pd.DataFrame({"ts": ts, "event_id": minutes, "value": [float(m) for m in minutes]})


def test_buffer_orders_evicts_and_refuses_late_rows():
    p = buffer.BufferPredictor(MODEL, "user_id", "ts", "event_id", length=3)
    held = []
    first = p._answer(7, batch(10, 12).sort_values("ts"), held)
    assert list(first["status"]) == [buffer.TOO_SHORT] * 2
    second = p._answer(7, batch(11, 14), held)
    assert list(second["status"]) == [buffer.OK] * 2
    assert second["prediction"].tolist() == [(11 - 1) / 2 * 4 + 3, (14 - 1) / 2 * 4 + 3]
    assert [r[1] for r in held] == [11, 12, 14]
    late = p._answer(7, batch(5), held)
    assert list(late["status"]) == [buffer.TOO_SHORT] and [r[1] for r in held] == [11, 12, 14]


def test_interval_is_of_the_row_and_not_of_the_batch():
    minutes, whole, parts = [3, 1, 4, 9, 5, 8, 7, 2, 6], [], []
    p = buffer.BufferPredictor(MODEL, "user_id", "ts", "event_id", length=3, resamples=50)
    ordered = sorted(minutes)
    want = p._answer(7, batch(*ordered), whole)
    got = pd.concat([p._answer(7, batch(m), parts) for m in ordered], ignore_index=True)
    pd.testing.assert_frame_equal(want, got, check_dtype=False)
    assert whole == parts
    columns = ["mean_prediction", "low", "high"]
    assert want[columns][:2].isna().all(axis=None) and want[columns][2:].notna().all(axis=None)
    assert (want["low"][2:] <= want["mean_prediction"][2:]).all() and (want["mean_prediction"][2:] <= want["high"][2:]).all()
    assert want["low"].nunique() > 3


@pytest.fixture
def stream(spark, events):
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(DATA)


def test_buffer_stream_equals_batch_twin(spark, events, stream):
    got = run_available(buffer.stream_buffer(stream, MODEL, key="user_id", length=20))
    want = buffer.buffer_predict(events, MODEL, key="user_id", order_by=["ts", "event_id"], length=20)
    key = ["user_id", "event_id", "prediction", "status"]
    assert rows(got, *key) == rows(want, *key)


def test_closed_windows_equal_batch(spark, events, stream):
    got = run_available(enrich.stream_tumbling(stream, [F.count("value").alias("n")]))
    want = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bin")).agg(F.count("value").alias("n"))
    left = rows(want.join(got, "bin", "left_anti"), "bin")
    assert len(left) <= 1 and rows(got.join(want, ["bin", "n"], "left_anti")) == []


def test_bootstrap_interval_brackets_the_mean(events):
    out = buffer.bootstrap_interval(events, MODEL, key="user_id", order_by=["ts", "event_id"], length=20)
    assert out.count() > 0 and out.where("NOT (low <= mean_prediction AND mean_prediction <= high)").count() == 0


@pytest.fixture(scope="module")
def part_files(spark, tmp_path_factory):
    """The tables of DATA with events in part files that overlap in time."""
    folder = tmp_path_factory.mktemp("parts")
    for path in glob.glob(f"{DATA}/*.parquet"):
        if not path.endswith("/events.parquet"):
            os.symlink(path, folder / os.path.basename(path))
    spark.read.parquet(f"{DATA}/events.parquet").repartition(5, "event_id").write.parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["stream_enrich", "stream_buffer", "stream_bootstrap", "stream_tumbling"])
def test_streams_read_tables_of_part_files(spark, part_files, name):
    got = rows(QUERIES[name](spark, part_files))
    assert got and got == rows(QUERIES[name](spark, DATA))
