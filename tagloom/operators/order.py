"""Ordered computations that stay parallel on one long series.

A window without ``PARTITION BY`` is one task, and a window partitioned by equipment
is as slow as the busiest equipment.  Here the total order ``(partition_by, order_by)``
is cut into chunks of about ``rows_per_chunk`` rows.  Cut points come from a
hash-chosen sample of the sort keys, so a re-run task sees the same chunks, and they
are cut points of the *whole* key: neither a hot equipment, a hot day nor a hot
instant can grow a chunk.  What a chunk needs from its neighbours arrives in one of
two ways:

* halo: the neighbouring rows are copied into the chunk (``over_rows``, ``over_time``);
* carry: one small row per chunk is aggregated, prefix-combined and broadcast back
  (``running_sum``, ``row_index``, ``fill``).

A table counted to be no larger than one chunk, or with no key larger than a few chunks,
skips all this and runs a plain window.

Cut points, carries and rows are three readings of the same input.  Operators that chain
several ordered steps therefore ``settle`` the rows between two steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tagloom.session import ROWS_PER_CHUNK, materialize, setting

MAX_CHUNKS = 1 << 15
_SAMPLES_PER_CHUNK = 16
_HASH_RANGE = 1 << 40
_KEY_CHUNKS = 4

CHUNK = "__chunk"
OWN = "__own"


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def _key(partition_by: Sequence[str], order: Sequence[Column]) -> Column:
    fields = [F.col(c).alias(f"p{i}") for i, c in enumerate(partition_by)]
    fields += [c.alias(f"o{i}") for i, c in enumerate(order)]
    return F.struct(*fields)


def _partition_key(partition_by: Sequence[str]) -> Column:
    return F.struct(F.lit(0).alias("z"), *[F.col(c) for c in partition_by])


def _located(df: DataFrame, cuts: DataFrame, steps: Sequence[int], key: Column, name: str) -> DataFrame:
    """Add ``name``: the number of cut points at or below ``key`` (binary search, JVM side).

    The cut points are a scalar subquery used once per projection, so they stay one
    shared value and are never copied into the rows.
    """
    return df.withColumn("__cuts", cuts.scalar()).withColumn(name, _position(F.col("__cuts"), key, steps)).drop("__cuts")


def _position(cuts: Column, key: Column, steps: Sequence[int]) -> Column:
    return F.aggregate(
        F.lit(list(steps)),
        F.lit(0),
        lambda low, step: F.when(F.get(cuts, low + step - 1) <= key, low + step).otherwise(low),
    )


@dataclass(frozen=True)
class Chunked:
    """A DataFrame with a ``__chunk`` column that is monotone in the total order."""

    df: DataFrame
    partition_by: tuple[str, ...]
    order_by: tuple[str, ...]
    single: bool
    cuts: DataFrame | None = None
    steps: tuple[int, ...] = ()

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(CHUNK, *self.partition_by).orderBy(*self.order_by)

    @property
    def reversed_window(self) -> WindowSpec:
        """The same rows backwards: a growing frame is linear, a shrinking one is not."""
        backwards = [F.col(c).desc_nulls_last() for c in self.order_by]
        return Window.partitionBy(CHUNK, *self.partition_by).orderBy(*backwards)


def fits_plain_window(df: DataFrame, partition_by: Sequence[str], n_rows: int, size: int) -> bool:
    """Whether a plain window is bounded work: the table, or else every key, is counted small."""
    if n_rows <= size:
        return True
    if not partition_by:
        return False
    largest = df.groupBy(*partition_by).count().agg(F.max("count")).first()[0]
    return largest <= _KEY_CHUNKS * size


def chunk(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
    n_rows: int | None = None,
    order_columns: Sequence[Column] | None = None,
) -> Chunked:
    """Assign every row its chunk.  ``n_rows`` skips the count when the size is known."""
    size = rows_per_chunk or setting(df.sparkSession, ROWS_PER_CHUNK)
    n = df.count() if n_rows is None else n_rows
    spec = dict(partition_by=tuple(partition_by), order_by=tuple(order_by))
    if fits_plain_window(df, partition_by, n, size):
        return Chunked(df.withColumn(CHUNK, F.lit(0)), single=True, **spec)
    key = _key(partition_by, order_columns or [F.col(c) for c in order_by])
    cuts, steps = cut_points(df, key, n, size)
    return Chunked(_located(df, cuts, steps, key, CHUNK), single=False, cuts=cuts, steps=steps, **spec)


def cut_points(df: DataFrame, key: Column, n: int, size: int) -> tuple[DataFrame, tuple[int, ...]]:
    """Keys that cut ``n`` rows into chunks of about ``size`` (one row, an array), and the steps of a search among them."""
    n_chunks = min(MAX_CHUNKS, -(-n // size))
    share = min(1.0, n_chunks * _SAMPLES_PER_CHUNK / n)
    picked = F.pmod(F.xxhash64("k"), F.lit(_HASH_RANGE)) < int(share * _HASH_RANGE)
    sample = df.select(key.alias("k")).where(picked).distinct()
    every = max(1, _SAMPLES_PER_CHUNK if share < 1 else n // n_chunks)
    cuts = sample.agg(F.array_sort(F.collect_list("k")).alias("a")).select(
        F.filter("a", lambda _, i: i % every == every - 1).alias("cuts")
    )
    return cuts, tuple(1 << i for i in reversed(range((2 * n_chunks).bit_length())))


def settle(df: DataFrame, n_rows: int, rows_per_chunk: int | None = None) -> DataFrame:
    """Materialise ``df`` if it is larger than one chunk."""
    size = rows_per_chunk or setting(df.sparkSession, ROWS_PER_CHUNK)
    return df if n_rows <= size else materialize(df)


def _carried_sum(ch: Chunked, value: Column) -> DataFrame:
    """Per chunk: the partition key that runs into it and the sum of its earlier rows.

    One row per chunk, at most ``MAX_CHUNKS + 1``, so the table may be broadcast.
    """
    keyed = (
        ch.df.groupBy(CHUNK, *ch.partition_by)
        .agg(F.sum(value).alias("s"))
        .select(CHUNK, _partition_key(ch.partition_by).alias("k"), "s")
    )
    last = keyed.groupBy(CHUNK).agg(F.max_by(F.struct("k", "s"), "k").alias("m"))
    along = Window.partitionBy("m.k").orderBy(CHUNK)
    total = last.select(CHUNK, F.struct("m.k", F.sum("m.s").over(along).alias("s")).alias("t"))
    return total.select(CHUNK, F.lag("t").over(Window.orderBy(CHUNK)).alias("__carry"))


def running_sum(
    df: DataFrame,
    value: Column,
    name: str,
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in order, restarted per ``partition_by`` key."""
    ch = chunk(df.withColumn("__v", value), order_by, partition_by, rows_per_chunk, n_rows)
    return _running_sum(ch, name).select(*df.columns, name)


def _running_sum(ch: Chunked, name: str) -> DataFrame:
    frame = ch.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.coalesce(F.sum("__v").over(frame), F.lit(0))
    if ch.single:
        return ch.df.withColumn(name, local)
    table = _carried_sum(ch, F.col("__v"))
    own_key = _partition_key(ch.partition_by)
    # every chunk is in the table; a left join spares a second lookup in an inferred null filter
    joined = ch.df.join(F.broadcast(table), CHUNK, "left")
    before = F.when(own_key.eqNullSafe(F.col("__carry.k")), F.col("__carry.s"))
    return joined.withColumn(name, local + F.coalesce(before, F.lit(0)))


def row_index(
    df: DataFrame,
    name: str = "idx",
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Dense 0-based position in the order, restarted per ``partition_by`` key."""
    ch = chunk(df.withColumn("__v", F.lit(1)), order_by, partition_by, rows_per_chunk, n_rows)
    return _running_sum(ch, name).withColumn(name, F.col(name) - 1).select(*df.columns, name)


def over_rows(
    df: DataFrame,
    build: Callable[[WindowSpec], Sequence[Column]],
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    rows_per_chunk: int | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``before``/``after`` rows away.

    ``build`` gets the window (partitioned and ordered) and returns the new columns;
    all of them share one shuffle and one sort.
    """
    size = rows_per_chunk or setting(df.sparkSession, ROWS_PER_CHUNK)
    n = df.count() if n_rows is None else n_rows
    if fits_plain_window(df, partition_by, n, size):
        window = Window.partitionBy(*(partition_by or [F.lit(0)])).orderBy(*order_by)
        return df.select(*df.columns, *build(window))
    block = max(size, 4 * max(before, after))
    order = [*partition_by, *order_by]
    indexed = row_index(df, "__i", order_by=order, rows_per_chunk=size, n_rows=n)
    here = F.floor(F.col("__i") / block)
    offset = F.col("__i") % block
    targets = F.array_compact(
        F.array(
            here,
            F.when(offset >= block - before, here + 1),
            F.when(offset < after, here - 1),
        )
    )
    spread = indexed.withColumn(CHUNK, F.explode(targets)).withColumn(OWN, F.col(CHUNK) == here)
    window = Window.partitionBy(CHUNK, *partition_by).orderBy(*order_by)
    return spread.select(*df.columns, *build(window), OWN).where(OWN).drop(OWN)


def over_time(
    df: DataFrame,
    build: Callable[[WindowSpec], Sequence[Column]],
    *,
    ts: str,
    tie: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    before_us: int = 0,
    after_us: int = 0,
    rows_per_chunk: int | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Add window columns over RANGE frames in microseconds of ``ts``.

    Rows are copied to every chunk whose rows can see them; lags, leads and rolling
    windows of any length within the two reaches share one shuffle and one sort.
    """
    timed = df.withColumn("__us", micros(ts))
    ties = [F.col(c) for c in tie]
    ch = chunk(
        timed, ["__us", *tie], partition_by, rows_per_chunk, n_rows, [F.col("__us"), *ties]
    )
    window = Window.partitionBy(CHUNK, *partition_by).orderBy("__us")
    if ch.single:
        return ch.df.select(*df.columns, *build(window))
    nothing = [F.lit(None).cast(timed.schema[c].dataType) for c in tie]
    low = _key(partition_by, [F.col("__us") - after_us, *nothing])
    high = _key(partition_by, [F.col("__us") + (before_us + 1), *nothing])
    placed = _located(ch.df.withColumnRenamed(CHUNK, "__home"), ch.cuts, ch.steps, low, "__low")
    placed = _located(placed, ch.cuts, ch.steps, high, "__high")
    spread = placed.withColumn(CHUNK, F.explode(F.sequence("__low", "__high")))
    spread = spread.withColumn(OWN, F.col(CHUNK) == F.col("__home"))
    return spread.select(*df.columns, *build(window), OWN).where(OWN).drop(OWN)


def fill(
    df: DataFrame,
    columns: Sequence[str],
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    direction: str = "forward",
    rows_per_chunk: int | None = None,
    n_rows: int | None = None,
    suffix: str = "",
) -> DataFrame:
    """Last (``forward``), next (``backward``) or either known value of each column.

    ``both`` is a forward fill followed by a backward fill.
    """
    ch = chunk(df, order_by, partition_by, rows_per_chunk, n_rows)
    filled = _fill(ch, {c: F.col(c) for c in columns}, direction)
    return filled.select(
        *[c for c in df.columns if suffix or c not in columns],
        *[F.col(f"__f_{c}").alias(c + suffix) for c in columns],
    ).select(*df.columns, *[c + suffix for c in columns if suffix])


def _fill(ch: Chunked, values: dict[str, Column], direction: str) -> DataFrame:
    """Add ``__f_<name>`` with the nearest known value in the given direction."""
    forward = direction in ("forward", "both")
    backward = direction in ("backward", "both")
    df = ch.df.select("*", *[v.alias(f"__x_{n}") for n, v in values.items()])
    own_key = _partition_key(ch.partition_by)
    if not ch.single:
        aggs = []
        order = F.struct(own_key, *ch.order_by)
        for n in values:
            pair = F.struct(own_key.alias("k"), F.col(f"__x_{n}").alias("v"))
            at = F.when(F.col(f"__x_{n}").isNotNull(), order)
            aggs.append(F.max_by(pair, at).alias(f"__l_{n}"))
            aggs.append(F.min_by(pair, at).alias(f"__n_{n}"))
        table = df.groupBy(CHUNK).agg(*aggs)
        past = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        ahead = Window.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
        table = table.select(
            CHUNK,
            *[F.last(f"__l_{n}", ignorenulls=True).over(past).alias(f"__p_{n}") for n in values],
            *[F.last(f"__n_{n}", ignorenulls=True).over(ahead).alias(f"__a_{n}") for n in values],
        )
        df = df.join(F.broadcast(table), CHUNK, "left")
    past = ch.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = ch.reversed_window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = []
    for n in values:
        choices = []
        if forward:
            choices.append(F.last(f"__x_{n}", ignorenulls=True).over(past))
            if not ch.single:
                same = own_key.eqNullSafe(F.col(f"__p_{n}.k"))
                choices.append(F.when(same, F.col(f"__p_{n}.v")))
        if backward:
            choices.append(F.last(f"__x_{n}", ignorenulls=True).over(ahead))
            if not ch.single:
                same = own_key.eqNullSafe(F.col(f"__a_{n}.k"))
                choices.append(F.when(same, F.col(f"__a_{n}.v")))
        out.append(F.coalesce(*choices).alias(f"__f_{n}"))
    return df.select("*", *out)
