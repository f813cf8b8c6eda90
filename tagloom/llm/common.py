"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import materialize, shared_dir

#: Word separators of every operator here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
_MAX_WORDS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def chars_in_words(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def table(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends at files that outlive executors."""
    return materialize(df)


def bucketed_table(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """Like ``table``, laid out in buckets of ``key`` so that joins on it need no shuffle of these rows."""
    spark, name = df.sparkSession, f"tagloom_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", shared_dir(spark)).saveAsTable(name)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hash of each word (bytes), computed once per word and worker; memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def windows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + n]
    return mix(out)


SPANS = "array<struct<rank: int, kind: string, start: int, end: int, base: boolean>>"


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then by the order of kinds, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["kind"].alias("k"), s["end"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["e"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
