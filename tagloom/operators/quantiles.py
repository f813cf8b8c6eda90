"""Exact quantiles with linear interpolation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators import order
from tagloom.session import ROWS_PER_CHUNK, materialize, setting


COLUMNS_PER_SCAN = 16
_BUILT_IN_ROWS = 100_000
_ACCURACY = 10_000


def per_column(df: DataFrame, columns: Sequence[str], metrics: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One row ``(column, *metrics)`` per column, aggregated wide.

    Each metric maps a column name to an aggregate of one type for all columns.  Wide
    tables are read in groups of columns: every group scans only its own columns, and the
    generated aggregation code stays small.
    """
    out = None
    for start in range(0, len(columns), COLUMNS_PER_SCAN):
        part = columns[start : start + COLUMNS_PER_SCAN]
        packed = [F.struct(*[f(c).alias(m) for m, f in metrics.items()]).alias(f"c{i}") for i, c in enumerate(part)]
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("m")) for i, c in enumerate(part)])
        table = df.agg(*packed).select(F.inline(rows)).select("column", "m.*")
        out = table if out is None else out.unionByName(table)
    return out


#: Rows that one task groups; what it holds then does not depend on how large files or the table are.
ROWS_PER_GROUPING = 100_000


def in_parts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with equal ``keys`` together, in as many parts as their number asks for."""
    parts = -(-df.count() // ROWS_PER_GROUPING)
    return df.repartition(min(parts, order.MAX_CHUNKS), *keys) if parts > 1 else df


def distinct_counts(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """``column, n_distinct`` exactly, one column after the other: rows are never multiplied, and no task holds all values.

    Rows are cut by ``key`` first, so that frequent values are combined within small parts before they are sent.
    """
    out, parts = None, min(-(-df.count() // ROWS_PER_GROUPING), order.MAX_CHUNKS)
    for c in columns:
        values = df.select(F.col(c).alias("v"), F.xxhash64(*key).alias("k")).where("v IS NOT NULL")
        values = (values.repartition(parts, "k") if parts > 1 else values).select("v").distinct()
        one = values.agg(F.count(F.lit(1)).alias("n_distinct")).select(F.lit(c).alias("column"), "n_distinct")
        out = one if out is None else out.unionByName(one)
    return out


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): ``column``, ``value``."""
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(keep), list(columns), "column", "value")


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Rows ``(*by, column, p, value)``.  ``n_rows`` skips the count when the size is known.

    Small inputs use the built-in exact aggregate, which holds every distinct value of a
    group.  Larger ones never do: ungrouped quantiles are bracketed by a sketch and picked
    by rank among the few values inside the bracket; grouped ones are picked by rank among
    the counted values.  Either way repeats are combined before the shuffle and no group,
    however large, has to fit into one task.
    """
    size = rows_per_chunk or setting(df.sparkSession, ROWS_PER_CHUNK)
    n = df.count() if n_rows is None else n_rows
    if not by and n > min(size, _BUILT_IN_ROWS):
        return _bracketed(df, columns, probs, size)
    if by and n > size:
        return _by_rank(df, columns, probs, by, size)
    points = F.array(*[F.lit(float(p)) for p in probs])
    values = [F.percentile(F.col(c).cast("double"), points).alias(c) for c in columns]
    table = df.groupBy(*by).agg(*values) if by else df.agg(*values)
    long = table.unpivot(list(by), list(columns), "column", "q")
    zipped = F.explode(F.arrays_zip(points.alias("p"), F.col("q").alias("q"))).alias("z")
    return long.select(*by, "column", zipped).select(
        *by, "column", F.col("z.p").alias("p"), F.col("z.q").alias("value")
    )


def _by_rank(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], size: int) -> DataFrame:
    """Count the values, order the counts in chunks, pick the two neighbours of each rank."""
    points = F.array(*[F.lit(float(p)) for p in probs])
    keys = [*by, "column"]
    values = long_form(df, columns, by).where(F.col("value").isNotNull())
    tally = materialize(values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c")))
    counted = order.running_sum(
        tally, F.col("c"), "upto", order_by=["value"], partition_by=keys, rows_per_chunk=size
    )
    totals = tally.groupBy(*keys).agg(F.sum("c").alias("n"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = counted.alias("l").join(totals.alias("r"), condition).select("l.*", "r.n")
    ranked = joined.withColumn("p", F.explode(points))
    rank = F.col("p") * (F.col("n") - 1)
    low, high = F.floor(rank), F.ceil(rank)
    first = F.col("upto") - F.col("c")
    hit = lambda r: (r >= first) & (r < F.col("upto"))
    picked = ranked.where(hit(low) | hit(high)).groupBy(*keys, "p").agg(
        F.max(F.when(hit(low), F.col("value"))).alias("lo"),
        F.max(F.when(hit(high), F.col("value"))).alias("hi"),
        F.max(rank - low).alias("w"),
    )
    return picked.select(*keys, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("value"))


def _bracketed(df: DataFrame, columns: Sequence[str], probs: Sequence[float], size: int) -> DataFrame:
    """Exact ungrouped quantiles from three scans and a shuffle of a small share of the values.

    A sketch whose rank error is at most ``1 / _ACCURACY`` gives a bracket around every
    rank, a second scan counts the values below and inside it (which proves the bracket),
    a third one counts the distinct values inside.  A bracket of one value needs no third.
    """
    margin = 2.0 / _ACCURACY
    ends = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    num = lambda c: F.col(c).cast("double")
    sketched = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.min(num(c)).alias("lo"), F.max(num(c)).alias("hi"),
                F.percentile_approx(num(c), [float(e) for e in ends], _ACCURACY).alias("q"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    slots, empty = [], []
    for i, c in enumerate(columns):
        s = sketched[f"c{i}"]
        for j, p in enumerate(probs):
            if s["n"] == 0:
                empty.append((c, float(p), None))
                continue
            low = s["lo"] if p - margin <= 0 else s["q"][j]
            high = s["hi"] if p + margin >= 1 else s["q"][len(probs) + j]
            slots.append((c, float(p), s["n"], low, high))
    counted = {}
    for start in range(0, len(slots), COLUMNS_PER_SCAN):
        part = slots[start : start + COLUMNS_PER_SCAN]
        cells = [
            F.struct(F.count_if(num(c) < lo).alias("below"), F.count_if(num(c).between(lo, hi)).alias("inside")).alias(f"s{start + k}")
            for k, (c, _, _, lo, hi) in enumerate(part)
        ]
        counted.update(df.agg(*cells).first().asDict()) if cells else None
    rows, proved = list(empty), []
    for k, (c, p, n, lo, hi) in enumerate(slots):
        below, inside = counted[f"s{k}"]
        rank = p * (n - 1)
        ok = below <= math.floor(rank) and math.ceil(rank) < below + inside
        proved.append(ok)
        if ok and lo == hi:
            rows.append((c, p, lo))
        elif not ok:
            rows += [tuple(r) for r in _by_rank(df, [c], [p], (), size).collect()]
    kept = [(k, *slots[k]) for k in range(len(slots)) if proved[k] and slots[k][3] < slots[k][4]]
    if kept:
        inside = F.array_compact(
            F.array(*[F.when(num(c).between(lo, hi), F.struct(F.lit(k).alias("slot"), num(c).alias("value"))) for k, c, _, _, lo, hi in kept])
        )
        tally = df.select(F.inline(inside)).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("c"))
        total = sum(counted[f"s{k[0]}"]["inside"] for k in kept)
        tally = materialize(tally) if total > size else tally
        upto = order.running_sum(
            tally, F.col("c"), "upto", order_by=["value"], partition_by=["slot"], rows_per_chunk=size, n_rows=total
        )
        ranks = [(k, math.floor(p * (n - 1)) - counted[f"s{k}"]["below"], math.ceil(p * (n - 1)) - counted[f"s{k}"]["below"]) for k, _, p, n, _, _ in kept]
        wanted = F.broadcast(df.sparkSession.createDataFrame(ranks, "slot int, low bigint, high bigint"))
        first = F.col("upto") - F.col("c")
        hit = lambda r: (F.col(r) >= first) & (F.col(r) < F.col("upto"))
        picked = upto.join(wanted, "slot").groupBy("slot").agg(
            F.max(F.when(hit("low"), F.col("value"))).alias("lo"), F.max(F.when(hit("high"), F.col("value"))).alias("hi")
        )
        found = {r["slot"]: r for r in picked.collect()}
        for k, c, p, n, _, _ in kept:
            share = p * (n - 1) - math.floor(p * (n - 1))
            rows.append((c, p, found[k]["lo"] + (found[k]["hi"] - found[k]["lo"]) * share))
    return df.sparkSession.createDataFrame(rows, "column string, p double, value double")


def quantile_values(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], rows_per_chunk: int | None = None, n_rows: int | None = None
) -> dict[str, list[float | None]]:
    """Ungrouped quantiles on the driver: ``len(columns) * len(probs)`` numbers."""
    rows = quantiles(df, columns, probs, rows_per_chunk=rows_per_chunk, n_rows=n_rows).collect()
    found = {(r["column"], r["p"]): r["value"] for r in rows}
    return {c: [found.get((c, float(p))) for p in probs] for c in columns}


def quartiles(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), rows_per_chunk: int | None = None) -> DataFrame:
    """Rows ``(*by, column, q25, q50, q75)``."""
    rows = quantiles(df, columns, [0.25, 0.5, 0.75], by=by, rows_per_chunk=rows_per_chunk)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    return rows.groupBy(*by, "column").agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], factor: float = 1.5, n_rows: int | None = None
) -> dict[str, tuple[float, float] | None]:
    """Lower and upper fence per column."""
    out = {}
    for c, (q1, q3) in quantile_values(df, columns, [0.25, 0.75], n_rows=n_rows).items():
        out[c] = None if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    """NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))
