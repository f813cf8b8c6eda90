"""Rolling buffer per equipment: predict once the last L rows are known."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagloom.operators import order
from tagloom.operators.linear import RidgeFit

# The process that sets up the state does not see files sent to the workers, so the
# processor travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Status texts.
OK = "予測成功"
TOO_SHORT = "データが不足しています"


@dataclass(frozen=True)
class LatestRowModel:
    """Linear model on scaled features of the latest row; travels to the tasks as plain numbers."""

    features: list[str]
    mean: list[float]
    std: list[float]
    coef: list[float]
    intercept: float

    @staticmethod
    def of(fit: RidgeFit) -> LatestRowModel:
        f = fit.features
        std = [fit.scaler.std[c] or 1.0 for c in f]
        return LatestRowModel(f, [fit.scaler.mean[c] for c in f], std, [float(w) for w in fit.coef], float(fit.intercept))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.mean)) / np.array(self.std) @ np.array(self.coef) + self.intercept

    def column(self):
        terms = [
            (F.col(c).cast("double") - F.lit(m)) / F.lit(s) * F.lit(w)
            for c, m, s, w in zip(self.features, self.mean, self.std, self.coef)
        ]
        return sum(terms, F.lit(self.intercept))


def buffer_predict(
    df: DataFrame, model: LatestRowModel, *, key: str, order_by: Sequence[str], length: int = 60, rows_per_chunk: int | None = None
) -> DataFrame:
    """Batch twin of :class:`BufferPredictor`: a row is predicted when ``length`` rows of its key are known."""
    indexed = order.row_index(df, "__i", order_by=order_by, partition_by=[key], rows_per_chunk=rows_per_chunk)
    full = F.col("__i") >= length - 1
    return indexed.select(
        key, *order_by, F.when(full, model.column()).alias("prediction"),
        F.when(full, OK).otherwise(TOO_SHORT).alias("status"),
    )


def bootstrap_interval(
    df: DataFrame, model: LatestRowModel, *, key: str, order_by: Sequence[str], length: int = 60, resamples: int = 100,
    seed: int = 42, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Mean and 2.5/97.5 % of the prediction over resamples of each key's last ``length`` rows.

    A resample's prediction uses its last drawn row, so one index is drawn per resample.
    The last rows of a key are picked by counting from its end, not by gathering the key.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= length)
    indexed = order.row_index(
        df.withColumn("__y", model.column()), "__i", order_by=order_by, partition_by=[key], rows_per_chunk=rows_per_chunk
    )
    last = indexed.join(counts, key).where(F.col("__i") >= F.col("__n") - length)
    last = last.select(key, (F.col("__i") - (F.col("__n") - length)).cast("int").alias("slot"), "__y")
    tries = counts.select(key, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("try"))
    draws = tries.select(key, F.pmod(F.xxhash64(F.lit(seed), key, "try"), F.lit(length)).cast("int").alias("slot"))
    q = F.percentile("__y", F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.join(last, [key, "slot"]).groupBy(key).agg(F.avg("__y").alias("mean_prediction"), q.alias("q"))
    return out.select(key, "mean_prediction", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


class BufferPredictor(StatefulProcessor):
    """Keeps the last ``length`` rows of a key and emits one prediction or status per new row.

    Rows are taken Arrow batch by Arrow batch, in time order within each, so memory does
    not grow with a busy key.  A row older than everything in a full buffer is late beyond
    repair and answered with the status only.  With ``resamples``, a row also gets the mean and the
    2.5/97.5 % of the prediction over resamples of the buffer as it is at that row, drawn by key,
    time and tie, so that answers do not depend on how rows are batched.
    """

    def __init__(self, model: LatestRowModel, key: str, ts: str, tie: str, length: int = 60, resamples: int = 0, seed: int = 42):
        self.model, self.key, self.ts, self.tie, self.length = model, key, ts, tie, length
        self.resamples, self.seed = resamples, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"x{i} double" for i in range(len(self.model.features)))
        self.rows = handle.getListState("rows", f"us bigint, tie bigint, {fields}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        for batch in rows:
            yield self._answer(key[0], batch.sort_values([self.ts, self.tie], kind="stable"), held)
        self.rows.put(held)

    def _answer(self, key, batch: pd.DataFrame, held: list[tuple]) -> pd.DataFrame:
        """Answers for one Arrow batch; ``held`` is updated in place."""
        us = batch[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
        ties = batch[self.tie].to_numpy()
        x = batch[self.model.features].to_numpy(dtype=float)
        y = self.model.predict(x)
        known = self.model.predict(np.array([r[2:] for r in held])).tolist() if held else []
        out = []
        for i in range(len(batch)):
            mark = (int(us[i]), int(ties[i]))
            late = len(held) >= self.length and mark < held[0][:2]
            if not late:
                at = bisect_right(held, mark, key=lambda r: r[:2])
                held.insert(at, (*mark, *x[i].tolist()))
                known.insert(at, float(y[i]))
                del held[: -self.length], known[: -self.length]
            full = len(held) >= self.length and not late
            answer = (batch[self.ts].iloc[i], mark[1], float(y[i]) if full else None, OK if full else TOO_SHORT)
            if self.resamples:
                answer += self._interval(known, key, mark) if full else (None, None, None)
            out.append(answer)
        names = [self.ts, self.tie, "prediction", "status", *(["mean_prediction", "low", "high"] if self.resamples else [])]
        table = pd.DataFrame(out, columns=names)
        table.insert(0, self.key, key)
        return table

    def _interval(self, known: list[float], key, mark: tuple[int, int]) -> tuple[float, float, float]:
        """Mean and interval over resamples of the buffered predictions; one index is drawn per resample."""
        rng = np.random.default_rng([self.seed, xxhash.xxh3_64_intdigest(f"{key}:{mark[0]}:{mark[1]}")])
        draws = np.array(known)[rng.integers(0, len(known), self.resamples)]
        low, high = np.percentile(draws, [2.5, 97.5])
        return float(draws.mean()), float(low), float(high)

    def close(self) -> None:
        pass


def stream_buffer(
    stream: DataFrame, model: LatestRowModel, *, key: str, ts: str = "ts", tie: str = "event_id", length: int = 60, resamples: int = 0
) -> DataFrame:
    """Streaming prediction; needs the RocksDB state store."""
    kind = lambda c: stream.schema[c].dataType.simpleString()
    schema = f"{key} {kind(key)}, {ts} {kind(ts)}, {tie} bigint, prediction double, status string"
    if resamples:
        schema += ", mean_prediction double, low double, high double"
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=BufferPredictor(model, key, ts, tie, length, resamples),
        outputStructType=schema, outputMode="Append", timeMode="None",
    )
