"""Equi, as-of and interval joins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import order
from tagloom.operators.order import micros
from tagloom.session import BROADCAST_ROWS, ROWS_PER_CHUNK, setting

HOUR = 3_600_000_000


def merge(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffixes=("_x", "_y")
) -> DataFrame:
    """Equi-join; other columns that both sides own get a suffix.

    An outer merge is a left join plus the right rows whose key the left side lacks:
    both parts can be split by adaptive execution when a key is hot, which a full
    outer join cannot.
    """
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    if how != "outer":
        return left.join(right, list(on), how)
    unmatched = right.join(left.select(*on).distinct(), list(on), "left_anti")
    return left.join(right, list(on), "left").unionByName(unmatched, allowMissingColumns=True)


def asof(
    left: DataFrame,
    right: DataFrame,
    on: str,
    *,
    by: Sequence[str] = (),
    left_tie: Sequence[str] = (),
    right_tie: Sequence[str] = (),
    suffixes=("_x", "_y"),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Each left row with the last right row at or before its time (and of its ``by`` key).

    Both sides are stacked and sorted once; the latest right row is filled forward, with
    a carry between chunks, so neither a long series nor a hot key becomes one task.
    """
    shared = [c for c in left.columns if c in right.columns and c not in (on, *by)]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    renamed = lambda names, i: [c + suffixes[i] if c in shared else c for c in names]
    ties_l = {f"__lt{i}": F.col(c) for i, c in enumerate(renamed(left_tie, 0))}
    ties_r = {f"__rt{i}": F.col(c) for i, c in enumerate(renamed(right_tie, 1))}
    keep = [c for c in left.columns if c not in (on, *by)]
    payload = [c for c in right.columns if c not in (on, *by)]
    pack = lambda columns: F.struct(F.lit(0).alias("z"), *columns)
    rows_l = left.withColumns(ties_l).select(*by, on, F.lit(1).alias("__side"), pack(keep).alias("__left"), *ties_l)
    rows_r = right.withColumns(ties_r).select(*by, on, F.lit(0).alias("__side"), pack(payload).alias("__right"), *ties_r)
    stacked = rows_l.unionByName(rows_r, allowMissingColumns=True)
    filled = order.fill(
        stacked, ["__right"], order_by=[on, "__side", *ties_r, *ties_l], partition_by=by,
        rows_per_chunk=rows_per_chunk,
    )
    return filled.where("__side = 1").select(
        *by, on, *[F.col(f"__left.{c}").alias(c) for c in keep], *[F.col(f"__right.{c}").alias(c) for c in payload]
    )


#: Each level's buckets are so many times as long as those of the level below; no width passes 64 bits.
STEP, TOP = 4, 15


def _width(level: int, base: int) -> int:
    return base * STEP**level


def run_pieces(runs: DataFrame, start: str, end: str, base: int) -> DataFrame:
    """Runs with ``__level`` and ``__b``: at most two rows each, however long a run is.

    A run belongs to the lowest level whose buckets are as long as it is.
    """
    length = F.greatest(micros(end) - micros(start), F.lit(1))
    level = F.least(F.greatest(F.ceil(F.log(float(STEP), length / base)), F.lit(0)), F.lit(TOP)).cast("int")
    width = F.element_at(F.array(*[F.lit(min(_width(k, base), (1 << 63) - 1)) for k in range(TOP + 1)]), F.col("__level") + 1)
    placed = runs.where(F.col(start) <= F.col(end)).withColumn("__level", level)
    return placed.withColumn("__b", F.explode(F.sequence(F.floor(micros(start) / width), F.floor(micros(end) / width))))


def levels_of(pieces: DataFrame) -> list[int]:
    """Levels that hold runs, at most TOP + 1."""
    return sorted(r[0] for r in pieces.select("__level").distinct().collect())


def row_places(rows: DataFrame, ts: str, levels: Sequence[int], base: int) -> DataFrame:
    """Rows once per level, with the bucket of their time there."""
    at = [F.struct(F.lit(k).alias("level"), F.floor(micros(ts) / min(_width(k, base), (1 << 63) - 1)).alias("b")) for k in levels]
    if not at:
        return rows.withColumns({"__level": F.lit(None).cast("int"), "__b": F.lit(None).cast("long")})
    return rows.withColumn("__at", F.explode(F.array(*at))).withColumns({"__level": F.col("__at.level"), "__b": F.col("__at.b")}).drop("__at")


def interval_join(
    rows: DataFrame,
    runs: DataFrame,
    *,
    ts: str = "ts",
    start: str = "run_start",
    end: str = "run_end",
    on: Sequence[str] = (),
    bucket: timedelta = timedelta(hours=1),
    broadcast_rows: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Rows inside a run, both ends included; a row inside two runs appears twice.

    Runs lie in an index of time buckets of several lengths, each on the level of its own length, so a run that never
    ends takes two rows as a short one does.  A row has one bucket per level, so it meets a run once; the range
    predicate becomes an equi-join plus a residual filter.  Counted small, the index is
    broadcast.  Otherwise the join is shuffled, and (key, bucket) groups with more than ``hot_rows`` rows are salted.
    """
    spark = rows.sparkSession
    width = int(bucket.total_seconds() * 1e6)
    limit = setting(spark, BROADCAST_ROWS) if broadcast_rows is None else broadcast_rows
    pieces = run_pieces(runs, start, end, width)
    placed = row_places(rows, ts, levels_of(pieces), width)
    keys = [*on, "__level", "__b"]
    inside = F.col(ts).between(F.col(start), F.col(end))
    if pieces.limit(limit + 1).count() <= limit:
        return placed.join(F.broadcast(pieces), keys).where(inside).drop("__level", "__b")
    hot = hot_rows or setting(spark, ROWS_PER_CHUNK)
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    sizes = sizes.select(*keys, F.ceil(F.col("n") / hot).cast("int").alias("__salts"))
    salted_rows = _with_salts(placed, sizes, keys, limit).withColumn(
        "__salt", F.pmod(F.xxhash64(*placed.columns), F.col("__salts")).cast("int")
    )
    salted_runs = _with_salts(pieces, sizes, keys, limit).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))
    )
    joined = salted_rows.drop("__salts").join(salted_runs.drop("__salts"), [*keys, "__salt"])
    return joined.where(inside).drop("__level", "__b", "__salt")


def _with_salts(df: DataFrame, sizes: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Attach the salt count of hot groups (1 elsewhere).

    Every hot group holds at least ``hot_rows`` rows, so the table is short; it is still
    only broadcast when counted to be.
    """
    small = sizes.limit(limit + 1).count() <= limit
    table = F.broadcast(sizes) if small else sizes
    return df.join(table, list(keys), "left").withColumn("__salts", F.coalesce("__salts", F.lit(1)))


def enrich_by_schedule(rows: DataFrame, runs: DataFrame, *, ts: str = "ts", **options) -> DataFrame:
    """Tag rows with product, equipment, run_start, run_end and run_date of the runs they fall in."""
    columns = ["product", "equipment", "run_start", "run_end", "run_date"]
    return interval_join(rows, runs.select(*columns), ts=ts, **options).select(*rows.columns, *columns)


def empty_runs(rows: DataFrame, runs: DataFrame, *, ts: str = "ts", bucket: timedelta = timedelta(hours=1)) -> DataFrame:
    """Runs in whose period there is no row."""
    ident = runs.columns
    hits = interval_join(rows.select(ts), runs, ts=ts, bucket=bucket).select(*ident).distinct()
    condition = None
    for c in ident:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        condition = same if condition is None else condition & same
    return runs.alias("a").join(hits.alias("b"), condition, "left_anti")
