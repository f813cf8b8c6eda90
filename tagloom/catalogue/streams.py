"""Structured Streaming queries and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalogue.base import EXTRACTED, R, query, r, rounded
from tagloom.session import shared_dir
from tagloom.streaming import buffer, enrich, ordered
from tagloom.streaming.run import run_available, with_end

MODEL = buffer.LatestRowModel(["value"], [10.0], [4.0], [2.0], 1.0)
BUFFER = """SELECT user_id, ts, event_id, CASE WHEN full_ THEN (value - 10) / 4 * 2 + 1 END AS prediction,
    CASE WHEN full_ THEN '予測成功' ELSE 'データが不足しています' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 60 AS full_ FROM events)"""


def _stream(t):
    """The event table, one plain file or a folder of part files, in one micro-batch.

    A stream starts from one plain file only by a pattern.  Part files need not be in time order: taken one by one,
    the first would move the watermark past rows of the next.
    """
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.path}/events.parque[t]")


@query("buffer_predict", BUFFER)
def buffer_predict(t):
    return buffer.buffer_predict(t.events, MODEL, key="user_id", order_by=["ts", "event_id"])


@query("buffer_predict_chunked", BUFFER)
def buffer_predict_chunked(t):
    return buffer.buffer_predict(t.events, MODEL, key="user_id", order_by=["ts", "event_id"], rows_per_chunk=15)


DRAWN = """d AS (SELECT t // 16 AS k, CAST(4 * (t % 16) + 1 AS INTEGER) AS pos FROM range(100) x(t))"""
_SLOT = "CAST('0x' || substr(sha256(concat('42:', {key}, ':', epoch_us(ts), ':', event_id, ':', k)), pos, 4) AS BIGINT) % 60"


@query(
    "bootstrap_interval",
    f"""WITH {DRAWN}, e AS (SELECT *, (value - 10) / 4 * 2 + 1 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
      last AS (SELECT user_id, 60 - back AS slot, y FROM e WHERE back <= 60),
      draws AS (SELECT user_id, {_SLOT.format(key="user_id")} AS slot FROM e, d WHERE back = 1 AND user_id IN (SELECT user_id FROM last WHERE slot = 0))
      SELECT user_id, {r("avg(y)")} AS mean_prediction, {r("quantile_cont(y, 0.025)")} AS low, {r("quantile_cont(y, 0.975)")} AS high
      FROM draws JOIN last USING (user_id, slot) GROUP BY user_id""",
)
def bootstrap_interval(t):
    out = ordered.last_interval(t.events, MODEL, key="user_id")
    return rounded(out, "mean_prediction", "low", "high")


@query("stream_buffer", BUFFER)
def stream_buffer(t):
    """Answers in event-time order of everything, the end of the input included."""
    stream, end = with_end(_stream(t))
    return run_available(ordered.ordered_predict(stream, MODEL, key="user_id"), end)


INTERVALS = f"""WITH {DRAWN}, e AS (SELECT *, (value - 10) / 4 * 2 + 1 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  drawn AS (SELECT user_id, ts, event_id, i - 59 + {_SLOT.format(key="user_id")} AS j FROM e, d WHERE i >= 60),
  q AS (SELECT a.user_id, a.ts, a.event_id, {r("avg(y)")} AS mean_prediction, {r("quantile_cont(y, 0.025)")} AS low, {r("quantile_cont(y, 0.975)")} AS high
    FROM drawn a JOIN e ON e.user_id = a.user_id AND e.i = a.j GROUP BY ALL)
  SELECT e.user_id, e.ts, e.event_id, CASE WHEN i >= 60 THEN {r("e.y")} END AS prediction,
    CASE WHEN i >= 60 THEN '予測成功' ELSE 'データが不足しています' END AS status, mean_prediction, low, high
  FROM e LEFT JOIN q USING (user_id, ts, event_id)"""
_NUMBERS = ("prediction", "mean_prediction", "low", "high")


@query("rolling_interval", INTERVALS)
def rolling_interval(t):
    """Batch twin of the stream: the interval of every row over its buffer."""
    return rounded(ordered.rolling_interval(t.events, MODEL, key="user_id"), *_NUMBERS)


@query("stream_bootstrap", INTERVALS)
def stream_bootstrap(t):
    stream, end = with_end(_stream(t))
    return rounded(run_available(ordered.ordered_predict(stream, MODEL, key="user_id", resamples=100), end), *_NUMBERS)


def _batches(t):
    """The events in three micro-batches by thirds of their time, the last with a copy of the first event, number -1, which is late there."""
    spark, folder = t.spark, shared_dir(t.spark) + "/events"
    low, high = t.events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    third = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * 3 / (high - low)), F.lit(2))
    late = t.events.orderBy("ts", "event_id").limit(1).withColumn("event_id", F.lit(-1).cast("long"))
    files = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(3):
        part = t.events.where(third == k)
        part = part if k < 2 else part.unionAll(late)
        # the same number of files each, so that one trigger takes one third
        part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query(
    "stream_buffer_batches",
    BUFFER + " UNION ALL (SELECT user_id, ts, -1, NULL, '遅延データ' FROM events ORDER BY ts, event_id LIMIT 1)",
)
def stream_buffer_batches(t):
    """Three micro-batches and a late row: the same answers as in one, and one late row on the side."""
    stream, end = with_end(_batches(t))
    return run_available(ordered.ordered_predict(stream, MODEL, key="user_id"), end)


@query(
    "stream_late_count",
    "SELECT '遅延データ' AS status, 1::BIGINT AS n UNION ALL SELECT CASE WHEN full_ THEN '予測成功' ELSE 'データが不足しています' END, count(*) FROM "
    "(SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 60 AS full_ FROM events) GROUP BY 1",
)
def stream_late_count(t):
    """Rows by status, late ones counted."""
    stream, end = with_end(_batches(t))
    answers = run_available(ordered.ordered_predict(stream, MODEL, key="user_id"), end)
    return answers.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _tumbling(t, stream):
    aggs = [F.count(F.lit(1)).alias("n"), R(F.avg("value")).alias("mean_value")]
    return run_available(enrich.stream_tumbling(stream, aggs, by=["event_type"]))


TUMBLING = f"""SELECT date_trunc('hour', ts) AS bin, event_type, count(*) AS n, {r('avg(value)')} AS mean_value FROM events GROUP BY 1, 2
      HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


@query("stream_tumbling", TUMBLING)
def stream_tumbling(t):
    """Windows that the watermark has closed; the last open one stays in the state."""
    return _tumbling(t, _stream(t))


@query("stream_tumbling_batches", TUMBLING)
def stream_tumbling_batches(t):
    """Windows over three micro-batches: state and watermark carry over, and the late row changes no closed window."""
    return _tumbling(t, _batches(t))


ENRICHED = f"WITH {EXTRACTED} SELECT event_id, ts, run_product AS product, equipment, run_start FROM extracted"


@query("stream_enrich", ENRICHED)
def stream_enrich(t):
    out = enrich.stream_enrich(_stream(t).select("event_id", "ts"), t.runs)
    return run_available(out).select("event_id", "ts", "product", "equipment", "run_start")


@query("stream_enrich_shuffled", ENRICHED)
def stream_enrich_shuffled(t):
    """The salted shuffle form for a schedule too long to broadcast."""
    out = enrich.stream_enrich(_stream(t).select("event_id", "ts"), t.runs, broadcast_rows=0)
    return run_available(out).select("event_id", "ts", "product", "equipment", "run_start")
