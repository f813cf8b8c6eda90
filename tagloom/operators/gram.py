"""Pair-wise sums of many columns as products of column tiles.

One expression per pair would grow with the square of the columns in one plan and compute every pair row by row.  Here a task turns
its rows into a matrix and a mask of what is known and multiplies tile by tile, which gives for each pair of columns
the count, sums, squares and products over the rows where both are known.  Tasks send one row per pair, added up by Spark.
Tile pairs whose sums would not fit the memory of one task together are taken in further passes over the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a tile, rows multiplied at once, and pairs of columns whose sums a task holds at once (48 bytes each).
TILE, ROWS, PAIRS = 128, 4096, 4_000_000
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_SCHEMA = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)


def pair_sums(df: DataFrame, columns: Sequence[str], others: Sequence[str] | None = None) -> DataFrame:
    """``i, j, n, sx, sy, sxx, syy, sxy`` (x: column i, y: column j, each less its mean).

    Without ``others`` for all ``i < j`` of ``columns``; else for every i of ``columns`` and j of ``others``, numbered behind them.
    """
    every = [*columns, *(others or [])]
    # positions, so that names may repeat between both lists
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(every)])
    means = numbers.agg(*[F.avg(c) for c in numbers.columns]).first()
    centre = np.array([m or 0.0 for m in means])
    tiles = lambda a, b: [range(k, min(k + TILE, b)) for k in range(a, b, TILE)]
    own = tiles(0, len(columns))
    work = [(a, b) for a in own for b in tiles(len(columns), len(every))] if others else [(a, b) for k, a in enumerate(own) for b in own[k:]]
    passes, held = [], PAIRS
    for a, b in work:
        if held + len(a) * len(b) > PAIRS:
            passes.append([])
            held = 0
        passes[-1].append((a, b))
        held += len(a) * len(b)
    parts = [_pass(numbers, tile_pairs, centre) for tile_pairs in passes]
    out = parts[0] if parts else df.sparkSession.createDataFrame([], _SCHEMA)
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def _pass(numbers: DataFrame, work: list[tuple[range, range]], centre: np.ndarray) -> DataFrame:
    used = sorted({c for a, b in work for c in (*a, *b)})
    at = {c: k for k, c in enumerate(used)}
    middle = centre[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(SUMS), len(a), len(b))) for a, b in work]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in piece.columns]) - middle
                known = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                squares = x * x
                for total, (a, b) in zip(totals, work):
                    p, q = slice(at[a[0]], at[a[-1]] + 1), slice(at[b[0]], at[b[-1]] + 1)
                    factors = ((known, known), (x, known), (known, x), (squares, known), (known, squares), (x, x))
                    for k, (left, right) in enumerate(factors):
                        total[k] += left[:, p].T @ right[:, q]
        for total, (a, b) in zip(totals, work):
            i, j = (g.reshape(-1) for g in np.meshgrid(list(a), list(b), indexing="ij"))
            keep = (i < j) & (total[0].reshape(-1) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), *[pa.array(t.reshape(-1)[keep]) for t in total]], ["i", "j", *SUMS])

    sent = numbers.select(*[f"c{c}" for c in used]).mapInArrow(run, _SCHEMA)
    return sent.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def pearson(sums: DataFrame) -> DataFrame:
    """``i, j, r``; NULL where a column does not vary over the rows that both have."""
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    # what rounding leaves of equal values is no spread
    real = lambda s, ss: spread(s, ss) > 1e-13 * F.col(ss)
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    return sums.select("i", "j", F.when(real("sx", "sxx") & real("sy", "syy"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
