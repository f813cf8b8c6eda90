"""Feature construction for the moisture and ridge models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import temporal
from tagloom.functions.scalars import category_codes, existing
from tagloom.operators import order
from tagloom.operators.quantiles import quantile_values
from tagloom.operators.spans import over_spans
from tagloom.operators.windows import at_offset, diff, lag, rolling, rolling_time

# Equipment columns tried in turn for one-hot encoding.
LINE_COLUMNS = ["設備タグ", "equipment", "line_id"]


def pv_sv_differences(columns: Sequence[str]) -> list[Column]:
    """``<tag>_PV_SV_diff`` for every ``<tag>_PV`` that has a ``<tag>_SV``."""
    tags = [c.replace("_PV", "") for c in columns if "PV" in c and f"{c.replace('_PV', '')}_SV" in columns]
    return [(F.col(f"{t}_PV") - F.col(f"{t}_SV")).alias(f"{t}_PV_SV_diff") for t in tags]


def interactions(pairs: Sequence[tuple[str, str]]) -> list[Column]:
    return [(F.col(a) * F.col(b)).alias(f"{a}__x__{b}") for a, b in pairs]


def ratios(pairs: Sequence[tuple[str, str]], eps: float = 1e-6) -> list[Column]:
    """``a / (b + eps)``, NULL where ``b`` is zero."""
    return [F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)) + eps).alias(f"{a}__div__{b}") for a, b in pairs]


def ratios_and_differences(pairs: Sequence[tuple[str, str]], eps: float = 1e-8) -> list[Column]:
    """``a / (b + eps)`` and ``a - b`` per pair."""
    out = []
    for a, b in pairs:
        out.append(F.try_divide(F.col(a), F.col(b) + eps).alias(f"{a}_{b}_ratio"))
        out.append((F.col(a) - F.col(b)).alias(f"{a}_{b}_diff"))
    return out


def hinge(column: str, knot: float) -> Column:
    """``max(0, x - knot)``, NULL stays NULL."""
    x = F.col(column) - F.lit(float(knot))
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def auto_knots(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Distinct quartiles per column."""
    found = quantile_values(df, columns, [0.25, 0.5, 0.75])
    return {c: sorted({v for v in found[c] if v is not None}) for c in columns}


def hinges(df: DataFrame, columns: Sequence[str], knots: Mapping[str, Sequence[float]] | None = None) -> list[Column]:
    """``<c>__hinge_<i>`` for every knot, numbered in rising order."""
    missing = [c for c in columns if not (knots or {}).get(c)]
    table = {**(auto_knots(df, missing) if missing else {}), **{c: list(k) for c, k in (knots or {}).items() if k}}
    return [hinge(c, k).alias(f"{c}__hinge_{i}") for c in columns for i, k in enumerate(sorted(table[c]))]


def line_dummies(df: DataFrame, candidates: Sequence[str] = LINE_COLUMNS, limit: int = 1000) -> list[Column]:
    """0/1 column per category of the first candidate present; a missing value is all 0."""
    present, _ = existing(df, candidates)
    if not present:
        return []
    c = present[0]
    values = df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(limit + 1).collect()
    if len(values) > limit:
        raise ValueError(f"{c} has more than {limit} categories, too many for columns: use line_dummies_long")
    return [F.coalesce((F.col(c) == F.lit(v[0])).cast("int"), F.lit(0)).alias(f"{c}_{v[0]}") for v in values]


def line_dummies_long(df: DataFrame, keys: Sequence[str], candidates: Sequence[str] = LINE_COLUMNS, limit: int = 10_000) -> DataFrame:
    """``keys, feature, code, value``: the ones of the dummy columns, for any number of categories.

    ``code`` is the feature's place among the sorted categories.  A missing value has no row, as all its dummies are 0.
    """
    present, _ = existing(df, candidates)
    if not present:
        return df.select(*keys, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("int").alias("code"), F.lit(1).alias("value")).where("1 = 0")
    c = present[0]
    coded = category_codes(df.select(*dict.fromkeys([*keys, c])), c, limit).where(F.col(c).isNotNull())
    return coded.select(*keys, F.concat_ws("_", F.lit(c), F.col(c).cast("string")).alias("feature"), F.col(f"{c}_code").alias("code"), F.lit(1).alias("value"))


def create_features(
    df: DataFrame,
    columns: Sequence[str],
    *,
    ts: str = "ts",
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    lag_rows: int = 30,
    windows: Sequence[int] = (5, 15, 30, 60),
    std_windows: Sequence[int] = (15, 30),
    diffs: Sequence[int] = (1, 5),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Lag, partial-window rolling, difference, PV-SV and calendar features; incomplete rows go.

    Every window column comes from one shuffle and one sort.
    """

    def build(w):
        out = [lag(c, lag_rows, w, f"{c}_lag{lag_rows}m") for c in columns]
        out += [rolling(c, k, "mean", w, f"{c}_ma{k}m", 1) for k in windows for c in columns]
        out += [rolling(c, k, "std", w, f"{c}_std{k}m", 1) for k in std_windows for c in columns]
        out += [diff(c, k, w, f"{c}_diff{k}") for c in columns for k in diffs]
        return out

    reach = max([lag_rows, *windows, *std_windows, *diffs])
    wide = order.over_rows(
        df, build, order_by=order_by, partition_by=partition_by, before=reach, rows_per_chunk=rows_per_chunk
    )
    hour, weekday, _, _ = temporal.calendar(ts)
    full = wide.select("*", *pv_sv_differences(df.columns), hour, weekday, temporal.is_weekend(ts).alias("is_weekend"))
    return full.dropna()


def create_features_extended(
    df: DataFrame,
    columns: Sequence[str],
    *,
    ts: str = "ts",
    target: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    lags: Sequence[int] = (6, 12, 24),
    windows: Sequence[int] = (5, 10, 20),
    lead_rows: int = 6,
    pairs: Sequence[tuple[str, str]] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Several lags, full-window statistics, percent change, calendar flags, ratios and the
    label some rows ahead; features and label are dropped together where either is missing."""

    def build(w):
        out = [lag(c, k, w, f"{c}_lag_{k}") for c in columns for k in lags]
        out += [rolling(c, k, s, w, f"{c}_{s}_{k}") for c in columns for k in windows for s in ("mean", "std")]
        out += [diff(c, 1, w, f"{c}_diff") for c in columns]
        out += [(F.try_divide(F.col(c), F.lag(c, 1).over(w)) - 1).alias(f"{c}_pct") for c in columns]
        out += [rolling(c, 20, s, w, f"{c}_{s}_20") for c in columns for s in ("min", "max")]
        out.append(F.lead(target, lead_rows).over(w).alias("label"))
        return out

    wide = order.over_rows(
        df, build, order_by=order_by, partition_by=partition_by,
        before=max(*lags, *windows, 20), after=lead_rows, rows_per_chunk=rows_per_chunk,
    )
    flags = [temporal.is_weekend(ts).alias("is_weekend"), temporal.is_night(ts).alias("is_night")]
    return wide.select("*", *temporal.calendar(ts), *flags, *ratios_and_differences(pairs)).dropna()


def ridge_matrix(
    df: DataFrame,
    target: str,
    *,
    mapping: Mapping[str, str] | None = None,
    ts: str = "ts",
    tie: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    horizon: int = 30,
    lags: Sequence[int] = (0, 3, 10),
    windows: Sequence[int] = (3,),
    knots: Mapping[str, Sequence[float]] | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Feature rows with ``label = target(t + horizon)``, complete rows only.

    ``mapping`` names the columns behind the roles spray_flow, spray_temp,
    preheat_out_temp, feed_temp, air_flow, SV, PV and MV.  Input rows must already be
    on distinct minutes per key (``normalize_minutes``).
    """
    role = {"spray_flow": "flow_rate", "spray_temp": "temperature", **(mapping or {})}
    role = {k: v for k, v in role.items() if v in df.columns}
    base = list(dict.fromkeys(role[k] for k in role))
    derived = []
    has = lambda *keys: all(k in role for k in keys)
    if has("SV", "PV"):
        derived.append((F.col(role["SV"]) - F.col(role["PV"])).alias("control_error"))
    if has("spray_flow", "air_flow"):
        derived += ratios([(role["spray_flow"], role["air_flow"])])
    if has("preheat_out_temp", "feed_temp", "air_flow"):
        derived += ratios([(role["preheat_out_temp"], role["feed_temp"])])
    if has("spray_temp", "spray_flow"):
        derived += interactions([(role["spray_temp"], role["spray_flow"])])
    if has("preheat_out_temp", "feed_temp"):
        derived += interactions([(role["preheat_out_temp"], role["feed_temp"])])
    hinge_columns = [role[k] for k in ("spray_temp", "spray_flow") if k in role]
    derived += hinges(df, hinge_columns, knots) + line_dummies(df)
    wide = df.select("*", *derived)
    n = df.count()
    stepped = [role[k] for k in ("MV", "spray_flow") if k in role]
    if stepped:
        wide = order.over_rows(
            wide, lambda w: [diff(c, 1, w, f"{c}__diff1") for c in stepped],
            order_by=[ts, *tie], partition_by=partition_by, before=1, rows_per_chunk=rows_per_chunk, n_rows=n,
        )
        wide = order.settle(wide, n, rows_per_chunk)
    lagged = base + (["control_error"] if has("SV", "PV") else [])

    specs = [at_offset(c, -m, f"{c}_lag{m}m") for m in lags for c in lagged]
    specs += [rolling_time(c, m, s, f"{c}_{s}_{m}m") for m in windows for s in ("mean", "std") for c in base]
    specs.append(at_offset(target, horizon, "label"))
    full = over_spans(wide, specs, ts=ts, tie=tie, partition_by=partition_by, rows_per_chunk=rows_per_chunk, n_rows=n)
    features = [c for c in full.columns if c not in df.columns and c != "label"]
    return full.select(*partition_by, ts, *features, "label").dropna()
