"""Cross-site boilerplate lines: distinct-site spread from sketches, exact near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SPACES, table, text_of

#: A line on this many distinct sites is boilerplate ...
SITES = 10
#: ... if at least this share of its occurrences has a neighbourhood of its own. Copies of a whole
#: document spread over many sites repeat the same neighbourhoods, so their lines stay.
CONTEXTS = 0.5
#: Within this relative distance of a threshold the sketches do not decide. At 2**12 registers the
#: standard error is 1.6 %, so the band is six of them wide.
BAND, LG_K = 0.1, 12


def _numbered_lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(l_k1, l_k2: text key; l_site; l_h1, l_h2: line key; l_context) per line that has a word."""
    body = text_of(text)
    df = docs.select(F.xxhash64(body).alias("l_k1"), F.xxhash64(body, F.lit(1)).alias("l_k2"), F.xxhash64(F.coalesce(F.col(site), F.lit(""))).alias("l_site"), F.split(body, "\n").alias("l_lines"))
    df = df.withColumn("l_lines", F.transform("l_lines", lambda x: F.btrim(x, F.lit(SPACES))))
    df = df.withColumn("l_hashes", F.transform("l_lines", lambda x: F.xxhash64(x)))
    item = lambda i: F.coalesce(F.get("l_hashes", i), F.lit(0).cast("long"))
    rows = F.transform("l_lines", lambda x, i: F.struct(
        (x != "").alias("l_full"), F.xxhash64(x).alias("l_h1"), F.hash(x).alias("l_h2"), F.xxhash64(item(i - 1), item(i + 1)).alias("l_context")))
    return df.select("l_k1", "l_k2", "l_site", F.inline(rows)).where("l_full").drop("l_full")


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES, contexts: float = CONTEXTS) -> DataFrame:
    """Keys (l_h1, l_h2) of the boilerplate lines of ``docs``.

    Sketches of sites and neighbourhoods merge per line in the aggregation, so a line that a
    third of the corpus holds costs each task one row.  Null sites are one site.
    """
    key = ["l_h1", "l_h2"]
    lines = _numbered_lines(docs, text, site)
    spread = lines.groupBy(key).agg(
        F.count("*").alias("n"), F.hll_sketch_agg("l_site", LG_K).alias("s"), F.hll_sketch_agg("l_context", LG_K).alias("c"),
    ).where(F.col("n") >= sites).select(*key, "n", F.hll_sketch_estimate("s").alias("s"), F.hll_sketch_estimate("c").alias("c"))
    low, high = 1 - BAND, 1 + BAND
    spread = table(spread.where((F.col("s") >= sites * low) & (F.col("c") >= contexts * low * F.col("n"))))
    clear = (F.col("s") >= sites * high) & (F.col("c") >= contexts * high * F.col("n"))
    near = spread.where(~clear).select(*key, "n")
    again = lines.join(near, key)
    exact_sites = again.groupBy(*key, "l_site").agg(F.lit(1)).groupBy(key).agg(F.count("*").alias("s"))
    exact_contexts = again.groupBy(*key, "l_context", "n").agg(F.lit(1)).groupBy(*key, "n").agg(F.count("*").alias("c"))
    exact = exact_sites.join(exact_contexts, key).where((F.col("s") >= sites) & (F.col("c") >= contexts * F.col("n")))
    return table(spread.where(clear).select(key).unionByName(exact.select(key)))


def drop_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES, contexts: float = CONTEXTS) -> DataFrame:
    """Rows of ``docs`` as the struct ``row`` with l_text (boilerplate lines removed), l_lines and l_removed.

    A line without a word always stays.  Null texts count as empty and stay null if nothing
    was removed.  Rows may repeat: texts are joined by their digest, which copies share.
    """
    if not docs.columns:
        raise ValueError("documents need columns")
    found = boilerplate(docs, text, site, sites, contexts)
    hits = _numbered_lines(docs, text, site).join(found, ["l_h1", "l_h2"]).groupBy("l_k1", "l_k2").agg(F.collect_set(F.struct("l_h1", "l_h2")).alias("l_hits"))
    body = text_of(F.col("row")[text])
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.withColumns({"l_k1": F.xxhash64(body), "l_k2": F.xxhash64(body, F.lit(1))}).join(hits, ["l_k1", "l_k2"], "left")
    lines = F.split(body, "\n")
    trimmed = lambda x: F.btrim(x, F.lit(SPACES))
    stays = lambda x: ~F.array_contains(F.col("l_hits"), F.struct(F.xxhash64(trimmed(x)).alias("l_h1"), F.hash(trimmed(x)).alias("l_h2")))
    df = df.withColumn("l_kept", F.when(F.col("l_hits").isNotNull(), F.filter(lines, stays)))
    return df.select(
        "row", F.when(F.col("l_hits").isNull(), F.col("row")[text]).otherwise(F.array_join("l_kept", "\n")).alias("l_text"),
        F.size(lines).cast("long").alias("l_lines"), F.when(F.col("l_hits").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("l_kept")).cast("long").alias("l_removed"),
    )
