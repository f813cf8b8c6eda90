"""Documents packed into blocks: the unit that matches of repeated text are sent back to.

A block is a run of whole documents of one input split, some megabytes of text, compressed
into one row.  Blocks are written once to the shared folder, in buckets of their id, so
later joins on the block shuffle only what joins them, and every later step sees the same
blocks even when a lost executor's tasks run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bucketed_table, shuffle_partitions, text_of

BLOCK_BYTES = 8 << 20
_LAST = np.iinfo(np.int64).max
SCHEMA = "block long, n_docs long, n_bytes long, ids binary, sizes binary, data binary"


def pack(array: np.ndarray) -> bytes:
    """Compress an array plane by plane of its bytes: sorted or small values leave planes of equal bytes."""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(len(array), array.itemsize).T) if len(array) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


@dataclass
class Block:
    """Documents by ascending id (null last; equal ids in input order); ``ids`` holds _LAST for null."""

    ids: np.ndarray
    null: np.ndarray
    sizes: np.ndarray
    data: bytes

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def texts(self) -> Iterator[bytes]:
        starts = self.starts.tolist()
        for a, b in zip(starts, starts[1:]):
            yield self.data[a:b]

    @classmethod
    def of(cls, row: dict) -> Block:
        meta = unpack(row["ids"], np.int64)
        n = len(meta) // 2
        return cls(meta[:n], meta[n:].astype(bool), unpack(row["sizes"], np.int64), zstandard.ZstdDecompressor().decompress(row["data"]))


def _row(number: int, docs: list[tuple[int | None, bytes]]) -> dict:
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    ids = np.array([_LAST if d is None else d for d, _ in docs] + [int(d is None) for d, _ in docs], np.int64)
    data = b"".join(t for _, t in docs)
    return {"block": number, "n_docs": len(docs), "n_bytes": len(data), "ids": pack(ids), "sizes": pack(np.array([len(t) for _, t in docs], np.int64)), "data": zstandard.ZstdCompressor(level=3).compress(data)}


def make(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Blocks of (doc_id, text as UTF-8; null is empty), written in buckets of ``block``."""
    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs[text]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        schema = pa.schema([("block", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                t = t.as_py().encode()
                if held and size + len(t) > BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([_row(number, held)], schema)
                    number, held, size = number + 1, [], 0
                held.append((d, t))
                size += len(t)
        if held:
            yield pa.RecordBatch.from_pylist([_row(number, held)], schema)

    packed = slim.mapInArrow(run, SCHEMA)
    return bucketed_table(packed, max(shuffle_partitions(docs.sparkSession), 8), "block")


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def with_payloads(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Each block with the list of the payloads found for it (null if there are none); blocks stay where they are."""
    return blocks.join(found.groupBy("block").agg(F.collect_list("payload").alias("payloads")), "block", "left")
