"""Mix sources to target weights by exponential keys (Efraimidis and Spirakis) and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import table, text_of

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Key ranges per source. Only the range that the budget ends in is sorted; more ranges make it smaller.
RANGES = 65536
#: Bytes of the table of sources up to which it is broadcast, and tasks over which a source's rows are dealt beyond.
BROADCAST_BYTES, SALTS = 32 << 20, 64


def quality_weight(text: Column) -> Column:
    """Between 0.5 and 1: the share of a text's characters that are no symbols."""
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    return F.lit(1.0) - F.lit(0.5) * symbols / F.greatest(F.length(text), F.lit(1))


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight with u drawn from the id: small keys come first, reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**48))) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row (m_none, m_source, m_total) per source -> with m_target: shares by weight, capped, the excess dealt out again.

    Capped sources are those with the smallest cap per weight, so one ordered pass over the
    sources finds the level at which dealing out again ends.  One row per source passes
    through one task; documents do not.
    """
    order = Window.orderBy("m_none", "m_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.expr(f"CAST(pmod(m_rank - 1, {len(WEIGHTS)}) + 1 AS INT)"))
    df = sizes.withColumn("m_rank", F.row_number().over(order)).withColumn("m_weight", weight)
    df = df.withColumn("m_cap", F.lit(float(CAP)) * F.col("m_total")).withColumn("m_ratio", F.col("m_cap") / F.col("m_weight"))
    everything = Window.partitionBy()
    below = Window.orderBy("m_ratio", "m_rank").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "m_capped": F.coalesce(F.sum("m_cap").over(below), F.lit(0.0)),
        "m_left": F.sum("m_weight").over(everything) - F.coalesce(F.sum("m_weight").over(below), F.lit(0.0)),
        "m_all": F.lit(SHARE) * F.sum("m_total").over(everything),
    })
    df = df.withColumn("m_level", (F.col("m_all") - F.col("m_capped")) / F.col("m_left"))
    level = F.min(F.when(F.col("m_level") <= F.col("m_ratio"), F.struct("m_ratio", "m_rank", "m_level"))).over(everything)["m_level"]
    target = F.least(F.col("m_cap"), F.coalesce(level * F.col("m_weight"), F.col("m_cap")))
    return df.select("m_none", "m_source", "m_total", F.round(target, 6).alias("m_target"))


def with_budgets(rows: DataFrame, ends: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows with what is known of their source, one row of ``ends`` each.

    Counted to be short, ``ends`` is broadcast.  Otherwise rows of a source are dealt over SALTS tasks, to each of which
    the source's row is sent, so that no source is the work of one task.
    """
    names = [c for c in ends.columns if c not in ("m_none", "m_name")]
    size = ends.agg(F.coalesce(F.sum(4 * F.length("m_name") + 100), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(ends), ["m_none", "m_name"])
    salted = rows.withColumn("m_salt", F.pmod(F.xxhash64("m_key", "m_tie"), F.lit(SALTS)).cast("int"))
    copies = ends.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["m_none", "m_name", "m_salt"]).select(*rows.columns, *names)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (of the columns ``keep``, all by default) as the struct ``row`` with size, source_size, target and taken.

    Words are counted once; sizes and keys are written to the shared folder with the kept columns.

    Each source gets a word budget: complete epochs of all its rows first, then rows in key
    order until the budget is used up; the row in which it ends gives the words that are left.
    Budgets end in one key range per source, found from sums per range, and only that
    range is sorted; all other rows are decided where they are read.

    Null texts have size 0 and take 0, null sources are one source, last in order.  Rows that
    repeat are separate rows; with equal ids the smaller size comes first.  An empty table gives an empty one.
    """
    body = text_of(docs[text])
    df = docs.select(
        F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        docs[source].alias("m_source"), exponential_key(docs[doc_id], quality_weight(body)).alias("m_key"), F.xxhash64(body).alias("m_tie"),
    )
    df = table(df).withColumns({
        "m_none": F.col("m_source").isNull(), "m_name": F.coalesce("m_source", F.lit("")),
        "m_range": F.least(F.lit(RANGES - 1), F.floor((1 - F.exp(-F.col("m_key"))) * RANGES)).cast("int"),
    })
    sums = df.groupBy("m_none", "m_name", "m_range").agg(F.sum("size").alias("m_sum"))
    sizes = sums.groupBy("m_none", F.col("m_name").alias("m_source")).agg(F.sum("m_sum").alias("m_total"))
    targets = source_targets(sizes).withColumns({
        "m_epochs": F.when(F.col("m_total") > 0, F.least(F.lit(CAP), F.floor(F.col("m_target") / F.col("m_total")))).otherwise(0).cast("long"),
    }).withColumn("m_rest", F.round(F.col("m_target") - F.col("m_epochs") * F.col("m_total")).cast("long")).withColumnRenamed("m_source", "m_name")
    running = Window.partitionBy("m_none", "m_name").orderBy("m_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        sums.withColumn("m_upto", F.sum("m_sum").over(running)).join(targets, ["m_none", "m_name"])
        .groupBy("m_none", "m_name", "m_total", "m_target", "m_epochs", "m_rest")
        .agg(F.min(F.when(F.col("m_upto") >= F.col("m_rest"), F.struct("m_range", (F.col("m_upto") - F.col("m_sum")).alias("m_before")))).alias("m_end"))
        .select("m_none", "m_name", "m_total", "m_target", "m_epochs", "m_rest", F.coalesce("m_end.m_range", F.lit(RANGES)).alias("m_last"), F.coalesce("m_end.m_before", F.lit(0)).alias("m_before"))
    )
    joined = with_budgets(df, table(ends))
    inside = F.col("m_range") == F.col("m_last")
    decided = joined.where(~inside).withColumn("m_extra", F.when(F.col("m_range") < F.col("m_last"), F.col("size")).otherwise(F.lit(0).cast("long")))
    ahead = Window.partitionBy("m_none", "m_name").orderBy("m_key", "size", "m_tie").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("m_rest") - F.col("m_before") - F.coalesce(F.sum("size").over(ahead), F.lit(0))
    at_end = joined.where(inside).withColumn("m_extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    return decided.unionByName(at_end).select(
        "row", "size", F.col("m_total").alias("source_size"), F.col("m_target").alias("target"),
        (F.col("m_epochs") * F.col("size") + F.col("m_extra")).alias("taken"),
    )
