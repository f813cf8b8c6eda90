"""Rolling-buffer prediction in event-time order, whatever order and batches rows arrive in.

Rows wait in keyed state until the watermark has passed them: up to PACK rows of a key in one value next to its buffer, which costs
a few calls of the state per key and micro-batch; more are packed by time bucket.  A timer then releases them in order of
(time, tie) into the buffer of the last ``length`` predictions, and each gets its answer.  Rows behind the watermark on arrival
are answered at once with the status LATE and never enter the buffer: filter on it for the side output and its count.
Neither the size of Arrow batches nor that of micro-batches changes an answer, as long as the delay covers the disorder.

What a task holds is one Arrow batch and PACK rows on arrival, one time bucket or PACK rows of one key on release.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagloom.operators import order
from tagloom.operators.order import micros
from tagloom.streaming import buffer as _buffer
from tagloom.streaming.buffer import OK, TOO_SHORT, LatestRowModel

# The process that sets up the state does not see files sent to the workers, so processor and model travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(_buffer)

LATE = "遅延データ"
BUCKET_US = 3_600_000_000
_ROW = np.dtype([("us", "<i8"), ("tie", "<i8"), ("y", "<f8")])
#: Rows of a key that wait in one value; a key with more is kept by time bucket.
PACK = 4096
#: Draws that one digest gives, four hex digits each.
_PER_DIGEST = 16


def draws(seed: int, key, us: int, tie: int, resamples: int, length: int) -> np.ndarray:
    """Slots of the buffer drawn for one row: digits of SHA-256 of seed, key, time and tie."""
    digests = b"".join(hashlib.sha256(f"{seed}:{key}:{us}:{tie}:{k}".encode()).digest() for k in range(-(-resamples // _PER_DIGEST)))
    return np.frombuffer(digests, ">u2")[:resamples].astype(np.int64) % length


def draw_column(seed: int, key: Column, us: Column, tie: Column, number: Column, length: int) -> Column:
    """The same draw as an expression; ``number`` counts from 0."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), us.cast("string"), tie.cast("string"), F.floor(number / _PER_DIGEST).cast("string"))
    digits = F.substring(F.sha2(text, 256), (number % _PER_DIGEST * 4 + 1).cast("int"), F.lit(4))
    return (F.conv(digits, 16, 10).cast("long") % length).cast("int")


class OrderedBuffer(StatefulProcessor):
    """Answers rows of a key in event-time order, see the module."""

    def __init__(self, model: LatestRowModel, key: str, ts: str, tie: str, length: int, resamples: int, seed: int, bucket_us: int):
        self.model, self.key, self.ts, self.tie, self.length = model, key, ts, tie, length
        self.resamples, self.seed, self.bucket_us = resamples, seed, bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # timer, buffer and waiting rows in one value: every access is a round trip to the JVM
        self.own = handle.getValueState("own", "timer bigint, held binary, packed binary, spread boolean")
        self.waiting = handle.getMapState("waiting", "bucket bigint", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs(), None
        timer, held, packed, spread = self.own.get() or (None, b"", b"", False)
        for batch in rows:
            at, tie = batch[self.ts].to_numpy("datetime64[us]"), batch[self.tie]
            known, us = ~np.isnat(at), at.view(np.int64)
            arrived = np.zeros(len(batch), _ROW)
            arrived["us"], arrived["tie"] = us, tie.to_numpy() if tie.dtype == np.int64 else tie.fillna(np.iinfo(np.int64).min).to_numpy()
            arrived["y"] = self.model.predict(np.column_stack([batch[c].to_numpy(dtype=float) for c in self.model.features]))
            late = ~known | (us < now * 1000)
            if late.any():
                yield self._table(key[0], arrived[late], None, np.where(known[late], LATE, TOO_SHORT), known[late])
            fresh = arrived[~late]
            if not len(fresh):
                continue
            first = min(first, fresh["us"].min()) if first is not None else fresh["us"].min()
            if not spread and len(packed) // _ROW.itemsize + len(fresh) <= PACK:
                packed = bytes(packed) + fresh.tobytes()
                continue
            if packed:
                fresh = np.concatenate([np.frombuffer(packed, _ROW), fresh])
            packed, spread = b"", True
            self._spread(fresh)
        if first is not None:
            timer = self._wake(timer, int(first) // 1000 + 1)
            self._keep(timer, held, packed, spread)

    def _spread(self, fresh: np.ndarray) -> None:
        """Rows into their time buckets."""
        buckets = fresh["us"] // self.bucket_us
        for b in np.unique(buckets).tolist():
            held = self.waiting.getValue((b,))
            self.waiting.updateValue((b,), ((bytes(held[0]) if held else b"") + fresh[buckets == b].tobytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, held, packed, spread = self.own.get() or (None, b"", b"", False)
        held, timer, rest = np.frombuffer(held, float), None, None
        for b in sorted(k[0] for k in self.waiting.keys()) if spread else [None] * bool(packed):
            if b is not None and b * self.bucket_us >= now * 1000:
                rest = b * self.bucket_us
                break
            rows = np.frombuffer(packed if b is None else self.waiting.getValue((b,))[0], _ROW)
            rows = rows[np.lexsort((rows["tie"], rows["us"]))]
            ready = int(np.searchsorted(rows["us"], now * 1000))
            left = rows[ready:].tobytes()
            if b is None:
                packed = left
            elif left:
                self.waiting.updateValue((b,), (left,))
            else:
                self.waiting.removeKey((b,))
            if left:
                rest = int(rows["us"][ready])
            if ready:
                every = np.concatenate([held, rows["y"][:ready]])
                yield self._answers(key[0], rows[:ready], every, len(held))
                held = every[-self.length :]
            if rest is not None:
                break
        if rest is not None:
            timer = self._wake(None, max(rest // 1000 + 1, now + 1))
        self._keep(timer, held.tobytes(), packed, spread and rest is not None)

    def _wake(self, before: int | None, ms: int) -> int:
        """One timer per key, at the earliest waiting row."""
        if before is not None:
            if before <= ms:
                return before
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        return ms

    def _keep(self, timer: int | None, held: bytes, packed: bytes, spread: bool) -> None:
        self.own.update((timer, bytes(held), bytes(packed), bool(spread)))

    def _answers(self, key, rows: np.ndarray, every: np.ndarray, before: int) -> pd.DataFrame:
        """``every``: the buffer's predictions, then the rows' own."""
        full = np.arange(len(rows)) + before + 1 >= self.length
        interval = None
        if self.resamples:
            interval = np.full((len(rows), 3), np.nan)
            at = np.flatnonzero(full)
            for some in np.array_split(at, -(-len(at) // PACK)) if len(at) else []:
                slots = [draws(self.seed, key, us, tie, self.resamples, self.length) for us, tie in zip(rows["us"][some].tolist(), rows["tie"][some].tolist())]
                drawn = every[(before + some + 1 - self.length)[:, None] + np.stack(slots)]
                interval[some, 0], interval[some, 1:] = drawn.mean(axis=1), np.percentile(drawn, [2.5, 97.5], axis=1).T
        return self._table(key, rows, np.where(full, rows["y"], np.nan), np.where(full, OK, TOO_SHORT), interval=interval)

    def _table(self, key, rows: np.ndarray, prediction, status, known=None, interval=None) -> pd.DataFrame:
        at = rows["us"].astype("datetime64[us]")
        if known is not None:
            at[~known] = np.datetime64("NaT")
        nothing = np.full(len(rows), np.nan)  # NaN becomes NULL
        out = {self.key: [key] * len(rows), self.ts: at, self.tie: rows["tie"], "prediction": nothing if prediction is None else prediction, "status": status.astype(object)}
        if self.resamples:
            for i, name in enumerate(("mean_prediction", "low", "high")):
                out[name] = nothing if interval is None else interval[:, i]
        return pd.DataFrame(out)

    def close(self) -> None:
        pass


def ordered_predict(
    stream: DataFrame, model: LatestRowModel, *, key: str, ts: str = "ts", tie: str = "event_id", length: int = 60, resamples: int = 0,
    seed: int = 42, delay: str = "10 minutes", bucket_us: int = BUCKET_US,
) -> DataFrame:
    """Answers in event-time order; needs the RocksDB state store.

    Rows of the last ``delay`` stay in the state until later ones arrive; ``run.with_end`` ends a finished input.
    """
    kind = lambda c: stream.schema[c].dataType.simpleString()
    schema = f"{key} {kind(key)}, {ts} {kind(ts)}, {tie} bigint, prediction double, status string"
    if resamples:
        schema += ", mean_prediction double, low double, high double"
    # Spark drops late rows by the marked column itself; the processor gets the rows without it, and answers them
    timed = stream.withColumn("__et", F.col(ts).cast("timestamp")).withWatermark("__et", delay)
    rows = timed.where(F.col("__et").isNull() | (F.col("__et") < F.lit("9000-01-01").cast("timestamp"))).select(*dict.fromkeys([key, ts, tie, *model.features]))
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=OrderedBuffer(model, key, ts, tie, length, resamples, seed, bucket_us),
        outputStructType=schema, outputMode="Append", timeMode="EventTime",
    )


def rolling_interval(
    df: DataFrame, model: LatestRowModel, *, key: str, ts: str = "ts", tie: str = "event_id", length: int = 60, resamples: int = 100,
    seed: int = 42, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Batch twin of :func:`ordered_predict` with ``resamples``: the interval of every row over its buffer."""
    value = df.withColumn("__y", model.column())
    last = lambda w: [F.collect_list("__y").over(w.rowsBetween(-(length - 1), 0)).alias("__held")]
    held = order.over_rows(value, last, order_by=[ts, tie], partition_by=[key], before=length - 1, rows_per_chunk=rows_per_chunk)
    full = F.size("__held") == length
    slots = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda k: draw_column(seed, F.col(key), micros(ts), F.col(tie), k, length))
    drawn = F.transform(slots, lambda s: F.get("__held", s))
    ranked = held.select(key, ts, tie, full.alias("__full"), "__y", F.array_sort(F.when(full, drawn)).alias("__d"))

    def quantile(q: float) -> Column:
        at = q * (resamples - 1)
        low, share = int(at), at - int(at)
        a, b = F.get("__d", F.lit(low)), F.get("__d", F.lit(min(low + 1, resamples - 1)))
        return a + (b - a) * share

    mean = F.aggregate("__d", F.lit(0.0), lambda s, x: s + x) / resamples
    return ranked.select(
        key, ts, tie, F.when(F.col("__full"), F.col("__y")).alias("prediction"), F.when(F.col("__full"), OK).otherwise(TOO_SHORT).alias("status"),
        mean.alias("mean_prediction"), quantile(0.025).alias("low"), quantile(0.975).alias("high"),
    )


def last_interval(
    df: DataFrame, model: LatestRowModel, *, key: str, ts: str = "ts", tie: str = "event_id", length: int = 60, resamples: int = 100,
    seed: int = 42, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Interval over the last ``length`` rows of each key that has so many: mean and 2.5/97.5 % of the prediction over resamples.

    The last rows of a key are found by counting from its end, not by gathering the key.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= length)
    indexed = order.row_index(df.withColumn("__y", model.column()), "__i", order_by=[ts, tie], partition_by=[key], rows_per_chunk=rows_per_chunk)
    held = indexed.join(counts.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).where(F.col("__i") >= F.col("__n") - length)
    at = F.struct("__i", F.struct(micros(ts).alias("us"), F.col(tie).alias("tie")).alias("row"), "__y")
    rows = held.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("__rows"))  # ``length`` rows per key
    last = F.get("__rows", F.lit(length - 1))["row"]
    slots = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda k: draw_column(seed, F.col(key), last["us"], last["tie"], k, length))
    drawn = rows.select(key, F.explode(F.transform(slots, lambda s: F.get("__rows", s)["__y"])).alias("__y"))
    q = F.percentile("__y", F.array(F.lit(0.025), F.lit(0.975)))
    out = drawn.groupBy(key).agg(F.avg("__y").alias("mean_prediction"), q.alias("q"))
    return out.select(key, "mean_prediction", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
