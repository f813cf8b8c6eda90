"""Registered queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import codes, decontaminate, language, lines, mixing, near, phrases, pii, quality, repair, secret_scan, suffixes, warc
from tagloom.llm.common import base_spans, count_of, joined_spans, read
from tagloom.llm.oracles import ORACLES
from tagloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Rows of texts that go to a Python worker at once.
BATCH_ROWS = 2000
#: and bytes of them, from which a batch takes no further row.
BATCH_BYTES = 64 << 20


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_decontaminate(spark, sf_dir):
    """Every document that contains a benchmark item within the error budget, with the item and the place."""
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_near_duplicates(spark, sf_dir):
    """Class of near duplicates of every document."""
    return near.classes(read(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark, sf_dir):
    """Lines per document, lines removed as cross-site boilerplate, digest of what stays."""
    return lines.drop_boilerplate(read(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), F.col("l_lines").alias("n_lines"), F.col("l_removed").alias("n_removed"),
        F.sha2(F.coalesce("l_text", F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op4_secrets(spark, sf_dir):
    """Secrets in every document: counts and digest of the base spans, all spans."""
    spans = F.col("spans")
    return secret_scan.scan(read(spark, sf_dir, "documents")).select(
        "doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined_spans(base_spans(spans)), 256).alias("base_sha256"), joined_spans(spans).alias("spans"),
    )


@query
def op5_suffix_dedup(spark, sf_dir):
    """Bytes of every document under strings of 100 bytes that start earlier."""
    return suffixes.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_phrase_dedup(spark, sf_dir):
    """Words of every document under windows of 13 words that start in an earlier document."""
    return phrases.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_warc_archive(spark, sf_dir):
    """Pages written as archives, read back and restored."""
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_quality_rules(spark, sf_dir):
    """Quality metrics and verdict of every document."""
    base = F.arrays_overlap("failed", F.array(*map(F.lit, quality.BASE_RULES)))
    counts = [f"metrics.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", *counts, base.alias("base_failed"), "kept")


@query
def op9_personal_data(spark, sf_dir):
    """Personal data in every document: counts and digest of the base spans, all spans."""
    spans = F.col("spans")
    return pii.scan(read(spark, sf_dir, "documents")).select(
        "doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in pii.KINDS[: pii.BASE]],
        F.sha2(joined_spans(base_spans(spans)), 256).alias("base_sha256"), joined_spans(spans).alias("spans"),
    )


@query
def op10_mix_sources(spark, sf_dir):
    """Words that a mix of all sources by target weights takes from every document."""
    return mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


@query
def op11_vector_codes(spark, sf_dir):
    """Codes of all usable vectors, their errors, and the digest of the codebooks."""
    return codes.encode(read(spark, sf_dir, "embeddings")).select(
        F.col("v_id").alias("vec_id"), "code", "error", "label_error",
        F.sha2(F.array_join(F.col("codebooks").cast("array<string>"), ","), 256).alias("codebooks_sha256"),
    )


@query
def op12_conversation_repair(spark, sf_dir):
    """Faults and lightest repair of every damaged conversation."""
    return repair.repair(read(spark, sf_dir, "conversations"))


@query
def op13_language_id(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    return language.identify(read(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES", "prepare"]
