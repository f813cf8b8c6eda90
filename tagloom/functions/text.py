"""Contact-card text blocks to ten fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["company", "department", "position", "zip", "address", "tel", "name", "mail", "fax", "link"]

# The line label that is skipped and the wide space that separates words.
ADDRESS_LABEL = "住所"
WIDE_SPACE = "　"


def _lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def _words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, WIDE_SPACE, " ")), " ")


def _after(lines: Column, start: int) -> Column:
    return F.slice(lines, start, F.greatest(F.size(lines) - (start - 1), F.lit(0)))


def _leading(lines: Column, matches) -> Column:
    """Number of leading lines that match."""
    step = lambda acc, x: F.struct(
        F.when(acc["lead"] & matches(x), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
        (acc["lead"] & matches(x)).alias("lead"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("lead"))
    return F.aggregate(lines, start, step, lambda acc: acc["n"])


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def parse_cards(df: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """Replace column ``text`` by the ten fields; missing fields become ''.

    The tolerant form skips blank lines anywhere; the strict one only before the phone
    and the postal code.  The first three lines are company, position/department and
    name; a line without @ after the phone is the fax.  Steps are separate projections,
    so each is computed once per row.
    """
    lines = _lines(F.col(text))
    staged = df.withColumn("__lines", lines if strict else F.filter(lines, lambda x: ~_blank(x)))
    rest = _after(F.col("__lines"), 4)
    staged = staged.withColumn("__rest", rest)
    if strict:
        lead = _leading(F.col("__rest"), _blank)
        staged = staged.withColumn("__n", lead)
        size = F.greatest(F.size("__rest") - F.col("__n"), F.lit(0))
        staged = staged.withColumn("__rest", F.slice(F.col("__rest"), F.col("__n") + 1, size))
    fax = ~F.get("__rest", F.lit(1)).contains("@")
    staged = staged.withColumn("__mail", F.when(fax, F.lit(2)).otherwise(F.lit(1)))
    size = F.greatest(F.size("__rest") - F.col("__mail") - 1, F.lit(0))
    staged = staged.withColumn("__tail", F.slice(F.col("__rest"), F.col("__mail") + 2, size))
    label = lambda x: _blank(x) | x.contains(ADDRESS_LABEL)
    staged = staged.withColumn("__skip", _leading(F.col("__tail"), label))
    staged = staged.withColumn("__words", _words(F.get("__lines", F.lit(1))))
    at = lambda column, i: F.coalesce(F.trim(F.get(column, i)), F.lit(""))
    fields = {
        "company": at("__lines", F.lit(0)),
        "department": at("__words", F.lit(1)),
        "position": at("__words", F.lit(0)),
        "zip": at("__tail", F.col("__skip")),
        "address": at("__tail", F.col("__skip") + 1),
        "tel": at("__rest", F.lit(0)),
        "name": at("__lines", F.lit(2)),
        "mail": at("__rest", F.col("__mail")),
        "fax": F.when(F.col("__mail") == 2, at("__rest", F.lit(1))).otherwise(F.lit("")),
        "link": at("__tail", F.col("__skip") + 2),
    }
    keep = [c for c in df.columns if c != text]
    return staged.select(*keep, *[fields[f].alias(f) for f in FIELDS])
