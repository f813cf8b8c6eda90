"""Correlation, lagged correlation and autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.scalars import numeric_columns
from tagloom.operators import order
from tagloom.operators.gram import pair_sums, pearson
from tagloom.session import ROWS_PER_CHUNK, setting


def _pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r of each pair in one aggregate; rows where either value is missing are left out."""
    exprs = [
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)
    ]
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.nanvl(F.col(f"r{i}"), F.lit(None)).alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return df.agg(*exprs).select(F.inline(rows))


#: Pairs up to which one aggregate with an expression each is used; more go through products of column tiles.
FEW_PAIRS = 40


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``var1, var2, r`` for every pair in column order (diagonal and mirror are implied)."""
    columns = list(columns or numeric_columns(df))
    if len(columns) * (len(columns) - 1) // 2 <= FEW_PAIRS:
        return _pairs(df, list(combinations(columns, 2)))
    return _tiled(df, columns)


def _tiled(df: DataFrame, columns: Sequence[str], others: Sequence[str] | None = None) -> DataFrame:
    """All pairs through products; pairs without a common row are there with NULL."""
    every = [*columns, *(others or [])]
    spark, n = df.sparkSession, len(columns)
    names = F.array(*map(F.lit, every))
    ids = spark.range(n).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(n) if others else F.col("id").cast("int") + 1, F.lit(len(every) - 1))).alias("j"))
    pairs = ids.where((F.col("i") < F.col("j")) & (F.col("j") < len(every)))  # a sequence from the last column on runs backwards
    r = pearson(pair_sums(df, columns, others))
    return pairs.join(r, ["i", "j"], "left").select(F.get(names, "i").alias("var1"), F.get(names, "j").alias("var2"), "r")


def high_corr_pairs(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.7) -> DataFrame:
    return corr_matrix(df, columns).where(F.abs("r") > limit).orderBy(F.desc(F.abs("r")), "var1", "var2")


def corr_with_target(df: DataFrame, target: str, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    pairs = _pairs(df, [(c, target) for c in columns]) if len(columns) <= FEW_PAIRS else _tiled(df, columns, [target])
    ranked = pairs.select(F.col("var1").alias("column"), F.abs("r").alias("abs_r"))
    return ranked.orderBy(F.desc_nulls_last("abs_r"), "column").limit(top)


@dataclass(frozen=True)
class _Series:
    """Long table (series, n, order columns, a, b): the complete rows of each pair of columns, less their means."""

    df: DataFrame
    sizes: list[int]
    order_by: list[str]

    @classmethod
    def of(cls, df: DataFrame, pairs: Sequence[tuple[str, str]], order_by: Sequence[str], least: int = 1) -> _Series:
        """``least``: pairs with fewer complete rows are left out."""
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        both = lambda a, b, e: F.when(number(a).isNotNull() & number(b).isNotNull(), e)
        stats = df.agg(*[e for a, b in pairs for e in (F.count(both(a, b, F.lit(1))), F.avg(both(a, b, number(a))), F.avg(both(a, b, number(b))))]).first()
        rows, sizes = [], []
        for i, (a, b) in enumerate(pairs):
            n, mean_a, mean_b = stats[3 * i : 3 * i + 3]
            sizes.append(n)
            if n >= least:
                known = F.struct(F.lit(i).alias("series"), F.lit(n).alias("n"), (number(a) - mean_a).alias("a"), (number(b) - mean_b).alias("b"))
                rows.append(both(a, b, known))
        keys = {c: F.col(c).alias(f"o{k}") for k, c in enumerate(order_by)}
        long = df.select(*keys.values(), F.inline(F.array_compact(F.array(*rows)))) if rows else None
        return cls(long, sizes, [f"o{k}" for k in range(len(order_by))])


def _lag_products(series: _Series, reach: int, rows_per_chunk: int | None, ends: bool = True):
    """Per series and ``k = 0..reach``: ``sum(a(i) b(i+k))`` and ``sum(b(i) a(i+k))``; sums of a, b and their squares; the first and last ``reach`` rows.

    Blocks of consecutive rows, each with the ``reach`` rows that follow, become one dot product per lag; only
    ``series x lags`` sums per block leave the tasks.  All series share one sort.
    """
    df, total = series.df, sum(series.sizes)
    size = rows_per_chunk or setting(df.sparkSession, ROWS_PER_CHUNK)
    block = min(max(size, 4 * reach), max(series.sizes, default=1))
    indexed = order.row_index(df, "__i", order_by=series.order_by, partition_by=["series"], n_rows=total, rows_per_chunk=rows_per_chunk)
    indexed = order.settle(indexed.select("series", "n", "__i", "a", "b"), total, rows_per_chunk)
    here, offset = F.floor(F.col("__i") / block), F.col("__i") % block
    targets = F.array_compact(F.array(here, F.when((offset < reach) & (here > 0), here - 1)))
    spread = indexed.select("series", "__i", "a", "b", F.explode(targets).alias("__block"))

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros(block + reach), np.zeros(block + reach)
        at = pdf["__i"].to_numpy() - int(key[1]) * block
        a[at], b[at] = pdf["a"].to_numpy(dtype=float), pdf["b"].to_numpy(dtype=float)
        rows = [(key[0], k, float(a[:block] @ b[k : k + block]), float(b[:block] @ a[k : k + block])) for k in range(reach + 1)]
        rows += [(key[0], -p, float((a[:block] ** p).sum()), float((b[:block] ** p).sum())) for p in (1, 2)]
        return pd.DataFrame(rows, columns=["series", "lag", "ab", "ba"])

    sums = spread.groupBy("series", "__block").applyInPandas(products, "series int, lag int, ab double, ba double")
    found = {(r["series"], r["lag"]): (r["ab"], r["ba"]) for r in sums.groupBy("series", "lag").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba")).collect()}
    edge = {}
    if ends:
        for r in indexed.where((F.col("__i") < reach) | (F.col("__i") >= F.col("n") - reach)).collect():
            edge[r["series"], r["__i"]] = (r["a"], r["b"])
    return found, edge


def _pearson(series: _Series, lags_of, rows_per_chunk: int | None) -> dict[int, list[tuple[int, float | None]]]:
    """Per series: r of ``a(i)`` and ``b(i + k)`` over the rows where both exist, for every k of ``lags_of(n)``.

    The cross products come from one pass; the sums over a shortened series are the total minus the first or last few rows.
    """
    chosen = {s: list(lags_of(n)) for s, n in enumerate(series.sizes)}
    reach = max((abs(k) for ks in chosen.values() for k in ks), default=0)
    if series.df is None or not any(chosen.values()):
        return {}
    found, edge = _lag_products(series, reach, rows_per_chunk)
    out = {}
    for s, lags in chosen.items():
        n = series.sizes[s]
        if (s, 0) not in found or not lags:
            continue
        total = [found[s, -1][0], found[s, -2][0], found[s, -1][1], found[s, -2][1]]
        cut = lambda rows, column, power: sum(edge[s, i][column] ** power for i in rows)
        out[s] = []
        for k in lags:
            m = abs(k)
            head, tail = range(m), range(n - m, n)
            first, last = (tail, head) if k >= 0 else (head, tail)  # rows that a, and b, lose
            sa, saa = total[0] - cut(first, 0, 1), total[1] - cut(first, 0, 2)
            sb, sbb = total[2] - cut(last, 1, 1), total[3] - cut(last, 1, 2)
            sab, size = found[s, m][0 if k >= 0 else 1], n - m
            spread = (saa - sa * sa / size) * (sbb - sb * sb / size)
            out[s].append((k, (sab - sa * sb / size) / spread**0.5 if spread > 0 else None))
    return out


def cross_corr(
    df: DataFrame, columns: Sequence[str], *, order_by: Sequence[str], max_lag: int = 20, rows_per_chunk: int | None = None
) -> DataFrame:
    """r at every lag of ``+-min(max_lag, n/4)`` for each column pair over its complete rows; pairs with under 20 of them are left out."""
    pairs = list(combinations(columns, 2))
    found = _pearson(_Series.of(df, pairs, order_by, least=20), lambda n: range(-min(max_lag, n // 4), min(max_lag, n // 4) + 1) if n >= 20 else (), rows_per_chunk)
    rows = [(*pairs[s], k, r) for s, values in found.items() for k, r in values]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, lag bigint, r double")


def best_lags(table: DataFrame) -> DataFrame:
    """Lag with the largest |r| per pair (the earliest lag on ties)."""
    rank = F.struct(F.abs("r"), -F.col("lag"))
    return table.where("r IS NOT NULL").groupBy("var1", "var2").agg(
        F.max_by("lag", rank).alias("best_lag"), F.max_by("r", rank).alias("best_r")
    )


def autocorr(
    df: DataFrame, column: str, *, order_by: Sequence[str], max_lag: int = 100, rows_per_chunk: int | None = None
) -> DataFrame:
    """Pearson r of the series and itself ``lag`` rows later, lags 1 to ``min(max_lag, n/2) - 1``."""
    found = _pearson(_Series.of(df, [(column, column)], order_by, least=50), lambda n: range(1, min(max_lag, n // 2)) if n >= 50 else (), rows_per_chunk)
    return df.sparkSession.createDataFrame(found.get(0, []), "lag bigint, r double")


def autocorr_many(
    df: DataFrame, columns: Sequence[str], *, order_by: Sequence[str], max_lag: int = 100, rows_per_chunk: int | None = None
) -> DataFrame:
    """``column, lag, r``: :func:`autocorr` of several columns in one pass."""
    found = _pearson(_Series.of(df, [(c, c) for c in columns], order_by, least=50), lambda n: range(1, min(max_lag, n // 2)) if n >= 50 else (), rows_per_chunk)
    rows = [(columns[s], k, r) for s, values in found.items() for k, r in values]
    return df.sparkSession.createDataFrame(rows, "column string, lag bigint, r double")


def acf(
    df: DataFrame, column: str, *, order_by: Sequence[str], max_lag: int = 50, rows_per_chunk: int | None = None
) -> DataFrame:
    """Biased autocorrelation (global mean, divided by n), lags 0 to ``min(max_lag, n/4) - 1``."""
    series = _Series.of(df, [(column, column)], order_by)
    lags = range(min(max_lag, series.sizes[0] // 4))
    rows = []
    if lags:
        found, _ = _lag_products(series, lags[-1], rows_per_chunk, ends=False)
        rows = [(k, found[0, k][0] / found[0, 0][0] if found[0, 0][0] else None) for k in lags]
    return df.sparkSession.createDataFrame(rows, "lag bigint, r double")
