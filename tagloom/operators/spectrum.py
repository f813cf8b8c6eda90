"""Power spectrum of one series of any length, on one path.

The four-step scheme lays values out as an n1 x n2 matrix, both sides about the root of n: strips of columns and
then strips of rows are small numpy FFTs, and Spark shuffles between the two.  Lengths without such factors go through
Bluestein's convolution, whose padded length is a power of two, so the spectrum is exact for every n.  A length too long for
two sides is cut into more: the rows of the matrix are then transformed by the same scheme.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import order

#: Longest transform of one task, and values of a strip of shorter ones.
GROUP_ROWS, STRIP_VALUES = 1 << 20, 1 << 18
_SCHEMA = "k bigint, re double, im double"


def _factors(n: int, limit: int) -> tuple[int, int] | None:
    """``n = n1 * n2`` with both at most ``limit``, as square as possible."""
    for a in range(int(n**0.5), 0, -1):
        if n // a > limit:
            return None
        if n % a == 0:
            return a, n // a
    return None


def _strip(long: int, across: int) -> int:
    """Transforms of length ``long`` that one group takes: a sixteenth of all ``across``, as far as a strip holds STRIP_VALUES."""
    return max(1, min(-(-across // 16), STRIP_VALUES // max(long, 1)))


def _parts(n: int, limit: int) -> tuple[int, ...] | None:
    """``n`` as a product of as few factors as possible, each at most ``limit`` and not far from the others."""
    count = 2
    while limit**count < n:
        count += 1
    while 1 << count <= n:
        out, rest = [], n
        for left in range(count, 1, -1):
            near = min(limit, round(rest ** (1 / left)))
            side = next((d for d in range(near, 0, -1) if rest % d == 0), 1)
            out.append(side)
            rest //= side
        if rest <= min(limit, max(64, 8 * int(n ** (1 / count)))):
            return (*out, rest)
        if count > 3 and limit**count > n * n:
            return None
        count += 1
    return None


def _powers(m: int, limit: int) -> tuple[int, ...]:
    """The power of two ``m`` as a product of as few powers of two as possible, none above ``limit``."""
    bits = m.bit_length() - 1
    count = -(-bits // (max(limit, 2).bit_length() - 1))
    return tuple(1 << (bits // count + (i < bits % count)) for i in range(count))


def _four_step(signal: DataFrame, n: int, *sides: int, inverse: bool = False) -> DataFrame:
    """FFT of ``(k, re, im)`` rows, ``n`` the product of the sides; ``k`` missing from the input means zero."""
    out = _transform(signal.select(F.lit(0).cast("bigint").alias("g"), "k", "re", "im"), n, sides, inverse).select("k", "re", "im")
    return out.select("k", *[(F.col(c) / F.lit(float(n))).alias(c) for c in ("re", "im")]) if inverse else out


def _transform(signal: DataFrame, n: int, sides: Sequence[int], inverse: bool) -> DataFrame:
    """Transforms of length ``n`` of every series ``g`` of ``(g, k, re, im)`` rows, not scaled."""
    sign, n1, n2 = 1.0 if inverse else -1.0, sides[0], n // sides[0]
    wide, high = _strip(n1, n2), _strip(n2, n1)

    def columns(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * wide
        width = min(wide, n2 - first)
        x = np.zeros((n1, width), dtype=complex)
        x[(pdf["k"] // n2).to_numpy(), (pdf["k"] % n2).to_numpy() - first] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.ifft(x, axis=0) * n1 if inverse else np.fft.fft(x, axis=0)
        c, b = np.arange(n1, dtype=np.int64)[:, None], first + np.arange(width, dtype=np.int64)[None, :]
        y = (y * np.exp(sign * 2j * np.pi * ((b * c) % n) / n)).reshape(-1)
        c, b = np.broadcast_to(c, (n1, width)).reshape(-1), np.broadcast_to(b, (n1, width)).reshape(-1)
        return pd.DataFrame({"g": int(key[0]), "c": c, "b": b, "re": y.real, "im": y.imag})

    def rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * high
        height = min(high, n1 - first)
        x = np.zeros((height, n2), dtype=complex)
        x[pdf["c"].to_numpy() - first, pdf["b"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.ifft(x, axis=1) * n2 if inverse else np.fft.fft(x, axis=1)
        k = first + np.arange(height, dtype=np.int64)[:, None] + n1 * np.arange(n2, dtype=np.int64)[None, :]
        return pd.DataFrame({"g": int(key[0]), "k": k.reshape(-1), "re": y.real.reshape(-1), "im": y.imag.reshape(-1)})

    first = signal.groupBy("g", F.floor(F.col("k") % n2 / wide).alias("strip")).applyInPandas(
        columns, "g bigint, c bigint, b bigint, re double, im double"
    )
    if len(sides) == 2:
        return first.groupBy("g", F.floor(F.col("c") / high).alias("strip")).applyInPandas(rows, f"g bigint, {_SCHEMA}")
    # every row c of the matrix is a series of its own
    inner = _transform(first.select((F.col("g") * n1 + F.col("c")).alias("g"), F.col("b").alias("k"), "re", "im"), n2, sides[1:], inverse)
    g = F.col("g")
    return inner.select(F.floor(g / n1).alias("g"), (g % n1 + F.col("k") * n1).alias("k"), "re", "im")


def _chirp(i, n: int, sign: float):
    """exp(sign * i * pi * k^2 / n) with the exponent reduced exactly: k^2 mod 2n."""
    angle = F.lit(np.pi) * F.pmod(i * i, F.lit(2 * n)) / F.lit(float(n))
    return F.cos(angle), F.sin(angle) * sign


def _times(re, im, cr, ci):
    return [(re * cr - im * ci).alias("re"), (re * ci + im * cr).alias("im")]


def _bluestein(signal: DataFrame, n: int, group_rows: int) -> DataFrame:
    m = 1 << (2 * n - 1).bit_length()
    m1 = 1 << (m.bit_length() // 2)
    sides = (m1, m // m1) if max(m1, m // m1) <= group_rows else _powers(m, group_rows)
    k, re, im = F.col("k"), F.col("re"), F.col("im")
    a = signal.select("k", *_times(re, im, *_chirp(k, n, -1.0)))
    index = signal.sparkSession.range(n).withColumnRenamed("id", "k")
    cr, ci = _chirp(k, n, 1.0)
    kernel = index.select("k", cr.alias("re"), ci.alias("im"))
    kernel = kernel.unionByName(kernel.where("k > 0").withColumn("k", F.lit(m) - F.col("k")))
    fa = _four_step(a, m, *sides)
    fb = _four_step(kernel, m, *sides).withColumnsRenamed({"re": "br", "im": "bi"})
    product = fa.join(fb, "k").select("k", *_times(re, im, F.col("br"), F.col("bi")))
    back = _four_step(product, m, *sides, inverse=True).where(k < n)
    return back.select("k", *_times(re, im, *_chirp(k, n, -1.0)))


def fft(signal: DataFrame, n: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Discrete Fourier transform of ``(k, re, im)`` rows, k = 0..n-1."""
    split = _factors(n, min(group_rows, max(64, 8 * int(n**0.5))))
    if not split and n > group_rows * group_rows:
        split = _parts(n, group_rows)
    return _four_step(signal, n, *split) if split else _bluestein(signal, n, group_rows)


def periodogram(
    df: DataFrame,
    column: str,
    *,
    order_by: Sequence[str],
    group_rows: int = GROUP_ROWS,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``frequency, period, power`` of the normalised known values, positive frequencies only."""
    series = df.select(*order_by, F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n, mean, std = series.agg(F.count("x"), F.avg("x"), F.stddev_samp("x")).first()
    indexed = order.row_index(series, "k", order_by=order_by, n_rows=n, rows_per_chunk=rows_per_chunk)
    scaled = indexed.select("k", ((F.col("x") - F.lit(mean)) / F.lit(std)).alias("re"), F.lit(0.0).alias("im"))
    spectrum = fft(scaled, n, group_rows)
    freq = F.col("k") / F.lit(float(n))
    return spectrum.where((F.col("k") > 0) & (F.col("k") < (n + 1) // 2)).select(
        freq.alias("frequency"), (1 / freq).alias("period"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power")
    )


def main_periods(table: DataFrame, n: int, top: int = 3) -> DataFrame:
    """Strongest ``top`` frequencies whose period lies between 2 and n/4."""
    strongest = table.orderBy(F.desc("power"), "frequency").limit(top)
    return strongest.where((F.col("period") >= 2) & (F.col("period") <= n / 4))
