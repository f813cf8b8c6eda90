"""Statistics over time windows and values at exact time offsets, at a cost that does not depend on density.

The order ``(keys, time)`` is cut into chunks of bounded size.  However many rows a window spans, a row goes to at most two
chunks for it: its own, and the one that holds the instant at which the row leaves the window.  There it meets the
rows whose windows begin near it.  What lies between, chunks that windows span as a whole, is needed only as one
total per chunk: rows are counted into cells (own chunk, chunk of leaving), at most two per chunk, and the
cells between a chunk's ends are added up.  In a chunk, sums are differences of running sums, minima and maxima come from a sparse
table, and lookups are binary searches, all on arrays.

A chunk whose rows share few instants may be larger than its share (a third of all rows may fall on one instant).  Such
chunks are counted, and their rows are first aggregated per instant, map side, so that only instants travel;
the answers of their instants are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators import order
from tagloom.operators.order import CHUNK, micros
from tagloom.session import ROWS_PER_CHUNK, materialize, setting

#: A chunk of more than this many times the wanted rows is aggregated per instant before it travels.
CROWDED = 4
#: Time of rows without a time: before all others, and no member of any window.
_NO_TIME = -(1 << 62)
_HOME = -1
#: What a statistic is made of: count, sum, sum and squares around a centre, least, highest.
_PARTS = {"mean": "ns", "sum": "ns", "std": "ndq", "min": "nl", "max": "nh", "count": "n"}
_FOLD = {"n": F.sum, "s": F.sum, "d": F.sum, "q": F.sum, "l": F.min, "h": F.max}


@dataclass(frozen=True)
class Rolling:
    """``stat`` of ``column`` over ``(t - span_us, t]``; NULL with fewer than ``min_count`` values."""

    column: str
    span_us: int
    stat: str
    name: str
    min_count: int = 1

    @property
    def leaves(self) -> int:
        return self.span_us


@dataclass(frozen=True)
class At:
    """``column`` of the last row (by time and tie) at exactly ``t + shift_us``; NULL without such a row."""

    column: str
    shift_us: int
    name: str

    @property
    def leaves(self) -> int:
        return -self.shift_us


Spec = Rolling | At


def over_spans(
    df: DataFrame,
    specs: Sequence[Spec],
    *,
    ts: str = "ts",
    tie: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Add a column per spec.  All specs share one shuffle; rows without a time get NULL (count: NULL)."""
    plan = _Plan(df, list(specs), ts, list(tie), list(partition_by), rows_per_chunk)
    return plan.run(df.count() if n_rows is None else n_rows)


class _Plan:
    def __init__(self, df: DataFrame, specs: list[Spec], ts: str, tie: list[str], keys: list[str], rows_per_chunk: int | None):
        self.df, self.specs, self.tie, self.keys = df, specs, tie, keys
        self.size = rows_per_chunk or setting(df.sparkSession, ROWS_PER_CHUNK)
        self.reaches = list(dict.fromkeys(s.leaves for s in specs))
        self.spans = sorted({s.span_us for s in specs if isinstance(s, Rolling)})
        self.values = list(dict.fromkeys(s.column for s in specs if isinstance(s, Rolling)))
        self.looked_up = list(dict.fromkeys(s.column for s in specs if isinstance(s, At)))
        self.parts = {c: "".join(p for p in _FOLD if any(p in _PARTS[s.stat] for s in specs if isinstance(s, Rolling) and s.column == c)) for c in self.values}
        us = F.coalesce(micros(ts), F.lit(_NO_TIME))
        number = lambda c: F.when(F.col(ts).isNotNull(), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
        self.rows = df.select(
            us.alias("__us"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"__t{i}") for i, c in enumerate(tie)],
            *[number(c).alias(f"__x{i}") for i, c in enumerate(self.values)], *[F.col(c).alias(f"__v{i}") for i, c in enumerate(self.looked_up)],
            F.struct(*df.columns).alias("__row"),
        )
        self.key_names = [f"__k{i}" for i in range(len(keys))]

    # Spark ---------------------------------------------------------------------------------------------------------

    def run(self, n: int) -> DataFrame:
        names = [s.name for s in self.specs]
        if n <= self.size:
            members = self._with_moments(self.rows.withColumn(CHUNK, F.lit(0)), [0.0] * len(self.values), centred=False)
            members = members.withColumn("__to", F.lit(_HOME))
            return self._answers(members, centres=None).select("__row.*", *names)
        located = lambda name, key: order._located(df, cuts, steps, key, name)
        key = order._key(self.key_names, [F.col("__us")])
        cuts, steps = order.cut_points(self.rows, key, n, self.size)
        df = self.rows
        placed = located(CHUNK, key)
        centres, crowded = self._measured(placed)
        cold = self._with_moments(placed.where(~F.col(CHUNK).isin(crowded)) if crowded else placed, centres)
        members = cold
        if crowded:
            hot = placed.where(F.col(CHUNK).isin(crowded))
            members = cold.unionByName(self._instants(hot, centres), allowMissingColumns=True)
        for i, reach in enumerate(self.reaches):
            df = members
            members = located(f"__to{i}", order._key(self.key_names, [F.col("__us") + reach]))
        totals = self._totals(members)
        spread = self._spread(members)
        if totals is not None:
            spread = spread.unionByName(totals, allowMissingColumns=True)
        answers = self._answers(spread, centres)
        if not crowded:
            return answers.select("__row.*", *names)
        answers = materialize(answers)  # read twice
        same = F.lit(True)
        for c in ["__us", *self.key_names]:
            same &= F.col(f"h.{c}").eqNullSafe(F.col(f"a.{c}"))
        instants = answers.where("__row IS NULL").alias("a")
        joined = hot.select("__us", *self.key_names, "__row").alias("h").join(instants, same, "left")
        back = joined.select("h.__row.*", *[F.col(f"a.{c}").alias(c) for c in names])
        return answers.where("__row IS NOT NULL").select("__row.*", *names).unionAll(back)

    def _measured(self, placed: DataFrame) -> tuple[list[float], list[int]]:
        """Mean of each value column, and the chunks that hold too many rows; one row per chunk is collected."""
        sums = [e for i in range(len(self.values)) for e in (F.sum(f"__x{i}"), F.count(f"__x{i}"))]
        found = placed.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("rows"), *[e.alias(f"e{j}") for j, e in enumerate(sums)]).collect()
        total = lambda j: sum(r[f"e{j}"] or 0 for r in found)
        centres = [total(2 * i) / total(2 * i + 1) if total(2 * i + 1) else 0.0 for i in range(len(self.values))]
        return centres, [r[CHUNK] for r in found if r["rows"] > CROWDED * self.size]

    def _moment_columns(self, centres: Sequence[float]) -> dict[str, Column]:
        out = {}
        for i, c in enumerate(self.values):
            x = F.col(f"__x{i}")
            d = x - F.lit(centres[i])
            forms = {"n": F.when(x.isNotNull(), F.lit(1.0)), "s": x, "d": d, "q": d * d, "l": x, "h": x}
            out |= {f"__{p}{i}": forms[p] for p in self.parts[c]}
        return out

    def _with_moments(self, rows: DataFrame, centres: Sequence[float], centred: bool = True) -> DataFrame:
        """Rows as members of windows.  In one chunk alone values are centred where they are added up."""
        if not centred:
            return rows
        return rows.withColumns(self._moment_columns(centres)).drop(*[f"__x{i}" for i in range(len(self.values))])

    def _instants(self, rows: DataFrame, centres: Sequence[float]) -> DataFrame:
        """One member per instant, combined before the shuffle."""
        moments = self._moment_columns(centres)
        aggs = [_FOLD[name[2]](e).alias(name) for name, e in moments.items()]
        if self.looked_up:
            last = F.max_by(F.struct(*[f"__v{i}" for i in range(len(self.looked_up))]), F.struct(F.lit(0), *[f"__t{i}" for i in range(len(self.tie))]))
            aggs.append(last.alias("__last"))
        out = rows.groupBy(CHUNK, "__us", *self.key_names).agg(F.count(F.lit(1)).alias("__rows"), *aggs)
        return out.select("*", *[F.col(f"__last.__v{i}").alias(f"__v{i}") for i in range(len(self.looked_up))]).drop("__last", "__rows")

    def _spread(self, members: DataFrame) -> DataFrame:
        """Every member at home, and once per reach in the chunk where it leaves, if that is another one."""
        ways = [F.struct(F.col(CHUNK).alias("c"), F.lit(_HOME).alias("to"))]
        ways += [F.when(F.col(f"__to{i}") != F.col(CHUNK), F.struct(F.col(f"__to{i}").alias("c"), F.lit(i).alias("to"))) for i in range(len(self.reaches))]
        away = [f"__to{i}" for i in range(len(self.reaches))]
        out = members.withColumn("__way", F.explode(F.array_compact(F.array(*ways)))).withColumns({CHUNK: F.col("__way.c"), "__to": F.col("__way.to")})
        return out.withColumn("__row", F.when(F.col("__to") == _HOME, F.col("__row"))).drop("__way", *away)

    def _totals(self, members: DataFrame) -> DataFrame | None:
        """Per chunk and span: the sum of all members that entered before the chunk and leave behind it."""
        names = [f"__{p}{i}" for i, c in enumerate(self.values) for p in self.parts[c]]
        tables = []
        for span in self.spans:
            to = self.reaches.index(span)
            through = members.where(F.col(f"__to{to}") > F.col(CHUNK) + 1)
            cells = through.groupBy(F.col(CHUNK).alias("home"), F.col(f"__to{to}").alias("to")).agg(*[_FOLD[c[2]](c).alias(c) for c in names])
            cells = cells.orderBy("home", "to").toPandas()
            if len(cells):
                tables.append(_between(cells, names).assign(__to=to))
        if not tables:
            return None
        pdf = pd.concat(tables)
        schema = f"{CHUNK} int, {', '.join(f'{c} double' for c in names)}, __to int"
        return self.df.sparkSession.createDataFrame(pdf[[CHUNK, *names, "__to"]].astype({CHUNK: "int32", "__to": "int32"}), schema).withColumn("__us", F.lit(None).cast("long"))

    def _answers(self, members: DataFrame, centres: list[float] | None) -> DataFrame:
        kind = lambda c: members.schema[c].dataType  # with what it says of nulls inside
        at = {c: i for i, c in enumerate(self.looked_up)}
        types = {s.name: kind(f"__v{at[s.column]}") if isinstance(s, At) else T.LongType() if s.stat == "count" else T.DoubleType() for s in self.specs}
        schema = T.StructType([T.StructField(c, k) for c, k in [*((c, kind(c)) for c in ("__row", "__us", *self.key_names)), *types.items()]])
        work = _Work(self.specs, self.reaches, self.values, self.looked_up, self.parts, len(self.keys), len(self.tie), centres)
        return members.groupBy(CHUNK).applyInArrow(lambda table: work.answer(table), schema)


def _between(cells: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Sums over the cells with ``home < c < to`` for every chunk c that has such cells.

    Cells are in order of time, so these are neighbours: differences of running sums in extended precision, and ranges of a sparse table.
    """
    chunks = np.arange(cells["home"].min() + 1, cells["to"].max())
    first, last = np.searchsorted(cells["to"], chunks, "right"), np.searchsorted(cells["home"], chunks, "left")
    chunks, first, last = (a[first < last] for a in (chunks, first, last))
    out = {CHUNK: chunks}
    for name in names:
        column = cells[name].to_numpy(float)
        if name[2] in "lh":
            out[name] = _Extreme(column, name[2] == "l").of(first, last)
        else:
            running = np.concatenate([[0], np.cumsum(np.nan_to_num(column).astype(np.longdouble))])
            out[name] = (running[last] - running[first]).astype(float)
    return pd.DataFrame(out)


class _Extreme:
    """Minimum or maximum over ranges: a table of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray, least: bool):
        self.empty = np.inf if least else -np.inf
        self.fold = np.minimum if least else np.maximum
        self.levels = [np.where(np.isnan(values), self.empty, values)]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(self.fold(last[:-step], last[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over ``[first, last)``; infinite where that is empty or has no value."""
        out = np.full(len(first), self.empty)
        length = np.maximum(last - first, 0)
        level = np.frexp(length.astype(float))[1] - 1
        for k, table in enumerate(self.levels):
            at = np.flatnonzero((level == k) & (length > 0))
            out[at] = self.fold(table[first[at]], table[last[at] - (1 << k)])
        return out


@dataclass
class _Work:
    """All answers of one chunk, from its own members, the copies that leave in it and the totals through it."""

    specs: list[Spec]
    reaches: list[int]
    values: list[str]
    looked_up: list[str]
    parts: dict[str, str]
    n_keys: int
    n_ties: int
    centres: list[float] | None

    def answer(self, table: pa.Table) -> pa.Table:
        total = table.filter(pc.is_null(table["__us"])) if table["__us"].null_count else table.slice(0, 0)
        table = table.filter(pc.is_valid(table["__us"])) if table["__us"].null_count else table
        table = table.append_column("__code", pa.array(self._codes(table)))
        ties = [(f"__t{i}", "ascending") for i in range(self.n_ties)] if any(isinstance(s, At) for s in self.specs) else []
        table = table.take(pc.sort_indices(table, sort_keys=[("__code", "ascending"), ("__us", "ascending"), *ties], null_placement="at_start"))
        us, code, to = (table[c].to_numpy() for c in ("__us", "__code", "__to"))
        self.instants, rank = np.unique(us, return_inverse=True)
        self.width = len(self.instants) + 1
        place = code * self.width + rank
        home = np.flatnonzero(to == _HOME)
        self.us, self.code, self.place, self.home = us[home], code[home], place[home], home
        through = {t: i for i, t in enumerate(total["__to"].to_pylist())}
        moments = self._moments(table)
        rolled: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        columns = []
        for spec in self.specs:
            reach = self.reaches.index(spec.leaves)
            chosen = np.flatnonzero((to == _HOME) | (to == reach))
            if isinstance(spec, At):
                columns.append(self._lookup(spec, table, chosen, place[chosen]))
                continue
            at = (self.values.index(spec.column), reach)
            if at not in rolled:
                rest = total.slice(through[reach], 1) if reach in through else None
                rolled[at] = self._window(spec.span_us, at[0], moments, chosen, place[chosen], rest)
            columns.append(self._statistic(spec, rolled[at]))
        own = table.take(pa.array(home))
        kept = [c for c in ("__row", "__us", *[f"__k{i}" for i in range(self.n_keys)])]
        rows = [own[c] for c in kept[1:]]
        row = own["__row"] if "__row" in own.column_names else pa.nulls(len(home))
        return pa.Table.from_arrays([row, *rows, *columns], [*kept, *[s.name for s in self.specs]])

    def _codes(self, table: pa.Table) -> np.ndarray:
        """A number per distinct key."""
        code = np.zeros(len(table), np.int64)
        for i in range(self.n_keys):
            column = table[f"__k{i}"].combine_chunks()
            indices = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.unique(code * (indices.max(initial=0) + 1) + indices, return_inverse=True)[1]
        return code

    def _moments(self, table: pa.Table) -> dict[str, np.ndarray]:
        number = lambda c: table[c].to_numpy().astype(float)
        if self.centres is not None:
            self.centre = self.centres
            return {f"{p}{i}": number(f"__{p}{i}") for i, c in enumerate(self.values) for p in self.parts[c]}
        out, self.centre = {}, []
        for i, c in enumerate(self.values):
            x = number(f"__x{i}")
            known = ~np.isnan(x)
            self.centre.append(float(x[known].mean()) if known.any() else 0.0)
            d = x - self.centre[-1]
            out |= {f"{p}{i}": {"n": known.astype(float), "s": x, "d": d, "q": d * d, "l": x, "h": x}[p] for p in self.parts[c]}
        return out

    def _window(self, span: int, i: int, moments: dict[str, np.ndarray], chosen: np.ndarray, place: np.ndarray, rest: pa.Table | None) -> dict[str, np.ndarray]:
        first = np.searchsorted(place, self.code * self.width + np.searchsorted(self.instants, self.us - span, "right"), "left")
        last = np.searchsorted(place, self.place, "right")
        out = {}
        for part in self.parts[self.values[i]]:
            column = moments[f"{part}{i}"][chosen]
            more = rest[f"__{part}{i}"][0].as_py() if rest is not None else None
            if part in "lh":
                extreme = _Extreme(column, part == "l")
                out[part] = extreme.of(first, last) if more is None else extreme.fold(extreme.of(first, last), more)
            else:
                running = np.concatenate([[0], np.cumsum(np.nan_to_num(column).astype(np.longdouble))])
                out[part] = (running[last] - running[first] + (more or 0)).astype(float)
        return out

    def _statistic(self, spec: Rolling, m: dict[str, np.ndarray]) -> pa.Array:
        n, known = m["n"], self.us != _NO_TIME
        enough = (n >= spec.min_count) & known
        if spec.stat == "count":
            return pa.array(n.astype(np.int64), mask=~enough)
        with np.errstate(invalid="ignore", divide="ignore"):
            if spec.stat == "mean":
                value = m["s"] / n
            elif spec.stat == "sum":
                value = m["s"]
            elif spec.stat == "std":
                spread = m["q"] - m["d"] ** 2 / n
                # what rounding leaves of equal values is no spread
                value = np.sqrt(np.where(spread > 1e-14 * m["q"] * n, spread, 0) / (n - 1))
                enough &= n > 1
            else:
                value = m["l" if spec.stat == "min" else "h"]
        return pa.array(value, pa.float64(), mask=~(enough & (n > 0)))

    def _lookup(self, spec: At, table: pa.Table, chosen: np.ndarray, place: np.ndarray) -> pa.ChunkedArray:
        wanted = self.us + spec.shift_us
        rank = np.searchsorted(self.instants, wanted)
        exists = (rank < len(self.instants)) & (self.instants[np.minimum(rank, len(self.instants) - 1)] == wanted) & (self.us != _NO_TIME)
        target = self.code * self.width + rank
        at = np.searchsorted(place, target, "right") - 1
        exists &= (at >= 0) & (place[np.maximum(at, 0)] == target)
        rows = chosen[np.maximum(at, 0)]
        return table[f"__v{self.looked_up.index(spec.column)}"].take(pa.array(rows, mask=~exists))
