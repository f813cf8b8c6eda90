"""A training-data pipeline: stages over documents, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, lines, mixing, near, quality
from tagloom.llm.common import read, table
from tagloom.llm.queries import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of many sites; n_chars follows the text."""
    cleaned = lines.drop_boilerplate(docs)
    fields = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("l_text")}
    if "n_chars" in fields:
        kind = docs.schema["n_chars"].dataType
        fields["n_chars"] = F.when(F.col("l_removed") > 0, F.length("l_text").cast(kind)).otherwise(fields["n_chars"])
    return cleaned.select(*[value.alias(c) for c, value in fields.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken."""
    mixed = mixing.mix(docs).where("taken > 0")
    own = ("size", "source_size", "target", "taken")
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Consistent weighted sampling and edit matching are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages rows are written to the shared folder."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs)
    return docs
