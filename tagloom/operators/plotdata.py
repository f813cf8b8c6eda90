"""The aggregated table behind each chart."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import temporal
from tagloom.operators.aggregates import sample_rows
from tagloom.operators.quantiles import quartiles
from tagloom.session import BROADCAST_ROWS, setting


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint, only when counted to be small."""
    limit = setting(df.sparkSession, BROADCAST_ROWS)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def histogram(df: DataFrame, column: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, bin, low, high, n, density)``; the last bin includes its upper edge."""
    values = df.select(*by, F.col(column).cast("double").alias("v")).where("v IS NOT NULL").dropna(subset=list(by) or None)
    span = values.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("total"))
    span = span.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    spine = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    if by:
        placed = values.join(_small(span), list(by))
    else:
        edges = span.first()
        placed = values.select("v", F.lit(edges["lo"]).alias("lo"), F.lit(edges["width"]).alias("width"))
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), "width")), F.lit(0)), F.lit(bins - 1))
    counts = placed.groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = spine.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    low = F.col("lo") + F.col("bin") * F.col("width")
    return out.select(
        *by, F.col("bin").cast("bigint").alias("bin"), low.alias("low"), (low + F.col("width")).alias("high"), "n",
        F.try_divide(F.col("n"), F.col("total") * F.col("width")).alias("density"),
    )


def _terms(reach: float, error: float) -> int:
    """Terms of the series of a kernel around a bin's middle, ``reach`` bandwidths away at most, for this error.

    Derivative k of exp(-z*z/2) is below 1.09 sqrt(k!), so term k is below 1.09 reach^k / sqrt(k!), and with it all later ones together
    are below twice that.
    """
    k = 1
    while 2.2 * reach**k / math.sqrt(math.factorial(k)) > error:
        k += 1
    return k


def density(df: DataFrame, column: str, points: int = 512, error: float = 1e-10) -> DataFrame:
    """Gaussian kernel density on an even grid over the range widened by half on each side.

    The bandwidth is std * n^(-1/5).  Values are reduced to bins of half a bandwidth, each with the sums of the powers of
    the distance from its middle; the kernel's series around the middle then gives the sum over *all* values
    of a bin, off by at most ``error`` of the kernel's peak per value.  A bin reaches only the grid points within nine bandwidths.
    Values without spread (none, one, or all equal) have no curve: the result is empty.
    """
    v = df.select(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("v")).where("v IS NOT NULL")
    lo, hi, n, std = v.agg(F.min("v"), F.max("v"), F.count("v"), F.stddev_samp("v")).first()
    if not std:
        return df.sparkSession.createDataFrame([], "i bigint, x double, density double")
    band = std * n**-0.2
    half, reach = band / 2, 0.25
    terms = _terms(reach, error)
    bin_ = F.floor((F.col("v") - lo) / half)
    off = (F.col("v") - (F.lit(lo) + (F.col("b") + 0.5) * half)) / band
    sums = v.withColumn("b", bin_).withColumn("u", off).groupBy("b").agg(*[F.sum(F.pow("u", F.lit(k))).alias(f"m{k}") for k in range(terms)])
    start, step = lo - 0.5 * (hi - lo), 2 * (hi - lo) / (points - 1)

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, grid = np.zeros(points), start + step * np.arange(points)
        for batch in batches:
            middle = lo + (batch.column("b").to_numpy(zero_copy_only=False) + 0.5) * half
            moments = [batch.column(f"m{k}").to_numpy(zero_copy_only=False) for k in range(terms)]
            first, last = np.searchsorted(grid, middle - 9 * band), np.searchsorted(grid, middle + 9 * band)
            for at in range(int((last - first).max(initial=0))):
                near = np.flatnonzero(first + at < last)
                i = first[near] + at
                z = (grid[i] - middle[near]) / band
                # derivative k is Hermite polynomial k times the kernel
                before, here, value = np.zeros(len(z)), np.ones(len(z)), np.zeros(len(z))
                for k in range(terms):
                    value += moments[k][near] / math.factorial(k) * here
                    before, here = here, z * here - k * before
                np.add.at(total, i, value * np.exp(-z * z / 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points)), pa.array(total)], ["i", "s"])

    parts = sums.mapInArrow(curve, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s"))
    scale = 1 / (n * band * math.sqrt(2 * math.pi))
    return parts.select("i", (F.lit(start) + F.col("i") * F.lit(step)).alias("x"), (F.col("s") * F.lit(scale)).alias("density"))


def box_stats(df: DataFrame, column: str, by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends within the fences and the number of points beyond them."""
    kept = df.dropna(subset=[*by, column]).select(*by, F.col(column).cast("double").alias(column))
    q = quartiles(kept, [column], by).drop("column")
    iqr = F.col("q75") - F.col("q25")
    fences = q.withColumns({"__lo": F.col("q25") - factor * iqr, "__hi": F.col("q75") + factor * iqr})
    if by:
        judged = kept.join(_small(fences), list(by))
    else:
        f = fences.first()
        judged = kept.select(column, *[F.lit(f[c]).alias(c) for c in fences.columns])
    inside = F.col(column).between(F.col("__lo"), F.col("__hi"))
    return judged.groupBy(*by).agg(
        F.max("q25").alias("q25"), F.max("q50").alias("q50"), F.max("q75").alias("q75"),
        F.min(F.when(inside, F.col(column))).alias("whisker_low"),
        F.max(F.when(inside, F.col(column))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n"),
    )


def downsample(df: DataFrame, columns: Sequence[str], ts: str = "ts", seconds: int = 3600, by: Sequence[str] = ()) -> DataFrame:
    """Min, mean and max of each column per time bucket."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return df.groupBy(*by, temporal.floor_to(ts, seconds).alias("bucket")).agg(*aggs)


def scatter_matrix(df: DataFrame, columns: Sequence[str], key: Sequence[str], n: int = 5000) -> DataFrame:
    """Complete sampled rows of all given columns."""
    return sample_rows(df.dropna(subset=list(columns)), n, key).select(*key, *columns)
