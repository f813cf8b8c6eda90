"""Column typing, coercion and small scalar expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def existing(df: DataFrame, columns: Iterable[str]) -> tuple[list[str], list[str]]:
    """Requested columns split into present and missing ones, order kept."""
    present, missing = [], []
    for c in columns:
        (present if c in df.columns else missing).append(c)
    return present, missing


def to_number(text: str) -> Column:
    """Number, or NULL where the text is none."""
    return F.col(text).try_cast("double")


def to_number_grouped(text: str) -> Column:
    """Number written with thousands separators."""
    return F.regexp_replace(F.col(text), ",", "").try_cast("double")


def numeric_text_columns(df: DataFrame) -> list[str]:
    """String columns in which every value is a number."""
    texts = text_columns(df)
    if not texts:
        return []
    bad = lambda c: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
    row = df.agg(*[F.struct(bad(c).alias("bad"), F.count(c).alias("n")).alias(c) for c in texts]).first()
    return [c for c in texts if row[c]["n"] > 0 and row[c]["bad"] == 0]


def downcast(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """DOUBLE to FLOAT."""
    doubles = columns or [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in doubles})


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = (T.DoubleType, T.FloatType)
    floats = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def status_label(value: Column, low: float = 83.0, high: float = 87.0) -> Column:
    """高 above ``high``, 低 below ``low``, otherwise (also when missing) 正常."""
    return F.when(value > high, "高").when(value < low, "低").otherwise("正常")


def category_codes(df: DataFrame, column: str, limit: int = 10_000, rows_per_chunk: int | None = None) -> DataFrame:
    """Add ``<column>_code``: the 0-based rank of the value among the sorted categories; NULL for a missing value.

    Up to ``limit`` categories the dictionary is broadcast.  A longer one is ranked by ranges of its values and joined by
    shuffle, where rows of a frequent value are split by size.
    """
    from tagloom.operators.order import row_index

    code = f"{column}_code"
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    if values.limit(limit + 1).count() <= limit:
        listed = values.agg(F.array_sort(F.collect_list(column)).alias("v"))
        codes = F.broadcast(listed.select(F.posexplode("v").alias(code, column)))
    else:
        codes = row_index(values, code, order_by=[column], rows_per_chunk=rows_per_chunk).withColumn(code, F.col(code).cast("int"))
    return df.join(codes, column, "left").select(*df.columns, code)
