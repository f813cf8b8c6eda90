"""Ordered queries: lags, rolling statistics, fills, gaps, segments, positions, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalogue.base import EXTRACTED, MINUTES, TAGS, R, query, r, rounded
from tagloom.operators import joins, order, periods, windows
from tagloom.operators.spans import over_spans

ORDER = ["ts", "event_id"]
BY_TIME = "OVER (ORDER BY ts, event_id)"


def W(frame: str = "", keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"OVER ({part}ORDER BY ts, event_id {frame})"


LAGS = f"""WITH {TAGS} SELECT event_id, lag("temp_PV", 30) {BY_TIME} AS "temp_PV_lag30m", lag(pressure, 6) {BY_TIME} AS pressure_lag6m FROM tags"""


def _lags(t, rows_per_chunk=None):
    df = t.tags.select("event_id", "ts", "temp_PV", "pressure")
    build = lambda w: [windows.lag("temp_PV", 30, w, "temp_PV_lag30m"), windows.lag("pressure", 6, w, "pressure_lag6m")]
    out = order.over_rows(df, build, order_by=ORDER, before=30, rows_per_chunk=rows_per_chunk)
    return out.select("event_id", "temp_PV_lag30m", "pressure_lag6m")


@query("lag_features", LAGS)
def lag_features(t):
    return _lags(t)


@query("lag_features_chunked", LAGS)
def lag_features_chunked(t):
    """The halo form used beyond one chunk of rows."""
    return _lags(t, rows_per_chunk=900)


@query("lead_label", f"WITH {TAGS} SELECT event_id, lead(moisture, 6) {W(keys='unit')} AS label FROM tags")
def lead_label(t):
    df = t.tags.select("event_id", "ts", "unit", "moisture")
    out = order.over_rows(df, lambda w: [windows.lead("moisture", 6, w, "label")], order_by=ORDER, partition_by=["unit"], after=6)
    return out.select("event_id", "label")


@query(
    "diff_features",
    f"""WITH {TAGS} SELECT event_id, "temp_PV" - lag("temp_PV", 1) {BY_TIME} AS diff1, "temp_PV" - lag("temp_PV", 5) {BY_TIME} AS diff5 FROM tags""",
)
def diff_features(t):
    df = t.tags.select("event_id", "ts", "temp_PV")
    build = lambda w: [windows.diff("temp_PV", 1, w, "diff1"), windows.diff("temp_PV", 5, w, "diff5")]
    return order.over_rows(df, build, order_by=ORDER, before=5).select("event_id", "diff1", "diff5")


@query(
    "pct_change",
    f"""WITH {TAGS} SELECT event_id, "temp_PV" / nullif(lag("temp_PV") {W(keys='unit')}, 0) - 1 AS pct FROM tags""",
)
def pct_change(t):
    df = t.tags.select("event_id", "ts", "unit", "temp_PV")
    out = order.over_rows(df, lambda w: [windows.pct_change("temp_PV", w, "pct")], order_by=ORDER, partition_by=["unit"], before=1)
    return out.select("event_id", "pct")


def _partial(t, stat, sizes):
    df = t.tags.select("event_id", "ts", "flow_rate")
    build = lambda w: [windows.rolling("flow_rate", k, stat, w, f"w{k}", 1) for k in sizes]
    out = order.over_rows(df, build, order_by=ORDER, before=max(sizes))
    return rounded(out.select("event_id", *[f"w{k}" for k in sizes]), *[f"w{k}" for k in sizes])


def _partial_sql(f, sizes):
    cols = ", ".join(f"{r(f'{f}(flow_rate) ' + W(f'ROWS {k - 1} PRECEDING'))} AS w{k}" for k in sizes)
    return f"WITH {TAGS} SELECT event_id, {cols} FROM tags"


@query("rolling_mean_partial", _partial_sql("avg", [5, 15, 30, 60]))
def rolling_mean_partial(t):
    return _partial(t, "mean", [5, 15, 30, 60])


@query("rolling_std_partial", _partial_sql("stddev_samp", [15, 30]))
def rolling_std_partial(t):
    return _partial(t, "std", [15, 30])


_F5 = W("ROWS 4 PRECEDING")
FULL = f"""WITH {TAGS} SELECT event_id, CASE WHEN count(flow_rate) {_F5} >= 5 THEN {r('avg(flow_rate) ' + _F5)} END AS mean5,
  CASE WHEN count(flow_rate) {_F5} >= 5 THEN {r('stddev_samp(flow_rate) ' + _F5)} END AS std5,
  CASE WHEN count(flow_rate) {_F5} >= 5 THEN min(flow_rate) {_F5} END AS min5,
  CASE WHEN count(flow_rate) {_F5} >= 5 THEN max(flow_rate) {_F5} END AS max5 FROM tags"""


def _full(t, rows_per_chunk=None):
    df = t.tags.select("event_id", "ts", "flow_rate")
    build = lambda w: [windows.rolling("flow_rate", 5, s, w, f"{s}5") for s in ("mean", "std", "min", "max")]
    out = order.over_rows(df, build, order_by=ORDER, before=5, rows_per_chunk=rows_per_chunk).drop("ts", "flow_rate")
    return rounded(out, "mean5", "std5")


@query("rolling_full_stats", FULL)
def rolling_full_stats(t):
    return _full(t)


@query("rolling_full_stats_chunked", FULL)
def rolling_full_stats_chunked(t):
    return _full(t, rows_per_chunk=1500)


def _time_rolling_sql(keys=""):
    part = f"PARTITION BY {keys} " if keys else ""
    w = f"OVER ({part}ORDER BY ts RANGE BETWEEN INTERVAL '1799.999999' SECOND PRECEDING AND CURRENT ROW)"
    return f"""WITH {TAGS} SELECT event_id, CASE WHEN count(flow_rate) {w} >= 15 THEN {r('avg(flow_rate) ' + w)} END AS mean_30m,
      CASE WHEN count(pressure) {w} >= 1 THEN {r('sum(pressure) ' + w)} END AS sum_30m FROM tags"""


def _time_rolling(t, rows_per_chunk=None):
    df = t.tags.select("event_id", "ts", "flow_rate", "pressure")
    specs = [windows.rolling_time("flow_rate", 30, "mean", "mean_30m"), windows.rolling_time("pressure", 30, "sum", "sum_30m", 1)]
    out = over_spans(df, specs, ts="ts", tie=["event_id"], rows_per_chunk=rows_per_chunk)
    return rounded(out.select("event_id", "mean_30m", "sum_30m"), "mean_30m", "sum_30m")


@query("time_rolling", _time_rolling_sql())
def time_rolling(t):
    return _time_rolling(t)


@query("time_rolling_chunked", _time_rolling_sql())
def time_rolling_chunked(t):
    return _time_rolling(t, rows_per_chunk=1200)


_PAST = W("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
_AHEAD = W("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
FFILL = f"WITH {TAGS} SELECT event_id, last_value(flow_rate IGNORE NULLS) {_PAST} AS flow_rate FROM tags"


def _fill(t, direction, rows_per_chunk=None, keys=()):
    df = t.tags.select("event_id", "ts", *keys, "flow_rate")
    out = order.fill(df, ["flow_rate"], order_by=ORDER, partition_by=list(keys), direction=direction, rows_per_chunk=rows_per_chunk)
    return out.select("event_id", "flow_rate")


@query("ffill", FFILL)
def ffill(t):
    return _fill(t, "forward")


@query("ffill_chunked", FFILL)
def ffill_chunked(t):
    """The carry form used beyond one chunk of rows."""
    return _fill(t, "forward", rows_per_chunk=800)


@query(
    "ffill_by_unit",
    f"WITH {TAGS} SELECT event_id, last_value(flow_rate IGNORE NULLS) {W('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW', 'unit')} AS flow_rate FROM tags",
)
def ffill_by_unit(t):
    return _fill(t, "forward", keys=("unit",))


@query(
    "ffill_bfill",
    f"""WITH {TAGS} SELECT event_id, coalesce(last_value(flow_rate IGNORE NULLS) {_PAST}, first_value(flow_rate IGNORE NULLS) {_AHEAD}) AS flow_rate FROM tags""",
)
def ffill_bfill(t):
    return _fill(t, "both")


_PTS = f"""WITH {TAGS}, i AS (SELECT event_id, ts, flow_rate, row_number() {BY_TIME} - 1 AS i FROM tags),
  p AS (SELECT *, last_value(CASE WHEN flow_rate IS NOT NULL THEN i END IGNORE NULLS) {_PAST} AS pi, last_value(flow_rate IGNORE NULLS) {_PAST} AS pv,
    first_value(CASE WHEN flow_rate IS NOT NULL THEN i END IGNORE NULLS) {_AHEAD} AS ni, first_value(flow_rate IGNORE NULLS) {_AHEAD} AS nv FROM i)
  SELECT event_id, {r('CASE WHEN flow_rate IS NOT NULL THEN flow_rate WHEN pi IS NULL THEN NULL WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END')} AS flow_rate FROM p"""


@query("interpolate_linear", _PTS)
def interpolate_linear(t):
    out = windows.interpolate(t.tags.select("event_id", "ts", "flow_rate"), ["flow_rate"], order_by=ORDER)
    return rounded(out.select("event_id", "flow_rate"), "flow_rate")


@query("interpolate_linear_chunked", _PTS)
def interpolate_linear_chunked(t):
    df = t.tags.select("event_id", "ts", "flow_rate")
    out = windows.interpolate(df, ["flow_rate"], order_by=ORDER, rows_per_chunk=900)
    return rounded(out.select("event_id", "flow_rate"), "flow_rate")


_GAP = "(epoch_us(ts) - lag(epoch_us(ts)) {o}) / 1e6"


def _sampling_sql(source, o):
    return f"""WITH g AS (SELECT ts, {_GAP.format(o=o)} AS g FROM {source})
      SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, {r('avg(g)', 4)} AS mean_gap_s, {r('min(g)', 4)} AS min_gap_s,
        {r('max(g)', 4)} AS max_gap_s, {r('stddev_samp(g)', 3)} AS std_gap_s, count(ts) - count(DISTINCT ts) AS dup_timestamps,
        stddev_samp(g) / avg(g) > 0.1 AS irregular, min(g) <= 0 AS non_monotonic FROM g"""


def _sampling(df, order_by):
    out = windows.sampling_stats(df, "ts", order_by=order_by)
    return rounded(rounded(out, "mean_gap_s", "min_gap_s", "max_gap_s", digits=4), "std_gap_s", digits=3)


@query("time_gap_stats", _sampling_sql("events", BY_TIME))
def time_gap_stats(t):
    return _sampling(t.events, ORDER)


@query(
    "non_monotonic",
    _sampling_sql("(SELECT o_orderdate AS ts, o_orderkey FROM orders)", "OVER (ORDER BY o_orderkey)").replace(
        "stddev_samp(g) / avg(g) > 0.1 AS irregular", "coalesce(stddev_samp(g) / nullif(avg(g), 0) > 0.1, false) AS irregular"
    ),
)
def non_monotonic(t):
    """Orders in file (key) order: their dates jump back."""
    return _sampling(t.orders.select(F.col("o_orderdate").alias("ts"), "o_orderkey"), ["o_orderkey"])


@query(
    "nominal_step",
    f"SELECT {r('quantile_cont(g, 0.5) / 60')} AS step_minutes FROM (SELECT {_GAP.format(o=BY_TIME)} AS g FROM events)",
)
def nominal_step(t):
    return rounded(windows.nominal_step_minutes(t.events, "ts", order_by=ORDER), "step_minutes")


def _segments_sql(keys=""):
    part = f"PARTITION BY {keys} " if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""WITH {TAGS}, f AS (SELECT *, CASE WHEN product <> lag(product) OVER ({part}ORDER BY ts, event_id) THEN 1 ELSE 0 END AS f FROM tags),
      s AS (SELECT *, sum(f) OVER ({part}ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM f)
      SELECT {head}CAST(s AS BIGINT) AS segment_id, product AS variety, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM s GROUP BY ALL"""


def _segments(t, keys=(), rows_per_chunk=None):
    df = t.tags.select("event_id", "ts", "unit", "product")
    return periods.segments(df, "product", order_by=ORDER, partition_by=list(keys), rows_per_chunk=rows_per_chunk)


@query("segments", _segments_sql())
def segments(t):
    return _segments(t)


@query("segments_chunked", _segments_sql())
def segments_chunked(t):
    return _segments(t, rows_per_chunk=900)


@query("segments_by_equipment", _segments_sql("unit"))
def segments_by_equipment(t):
    return _segments(t, ["unit"])


@query(
    "segment_positions",
    _segments_sql().replace("SELECT CAST(s AS BIGINT)", "SELECT segment_id, n, CAST(u - n AS BIGINT) AS first_pos, CAST(u - 1 AS BIGINT) AS last_pos, CAST(u - n + n // 2 AS BIGINT) AS label_pos FROM (SELECT *, sum(n) OVER (ORDER BY segment_id ROWS UNBOUNDED PRECEDING) AS u FROM (SELECT CAST(s AS BIGINT)") + "))",
)
def segment_positions(t):
    return periods.segment_positions(_segments(t)).select("segment_id", "n", "first_pos", "last_pos", "label_pos")


@query(
    "continuous_position",
    f"WITH {EXTRACTED} SELECT event_id, run_start, row_number() OVER (ORDER BY run_start, equipment, ts, event_id) - 1 AS position FROM extracted",
)
def continuous_position(t):
    rows = joins.enrich_by_schedule(t.events.select("event_id", "ts"), t.runs)
    out = periods.continuous_position(rows, period=["run_start", "equipment"], order_by=ORDER)
    return out.select("event_id", "run_start", "position")


@query(
    "position_by_equipment",
    f"""WITH {TAGS} SELECT event_id, unit, row_number() OVER (ORDER BY unit, ts, event_id) - 1 + 10 * (dense_rank() OVER (ORDER BY unit) - 1) AS position FROM tags""",
)
def position_by_equipment(t):
    df = t.tags.select("event_id", "ts", "unit")
    out = periods.position_by_equipment(df, equipment="unit", order_by=ORDER, rows_per_chunk=3000)
    return out.select("event_id", "unit", "position")


@query(
    "period_boundaries",
    f"""WITH {EXTRACTED}, p AS (SELECT run_start, row_number() OVER (ORDER BY run_start, equipment, ts, event_id) - 1 AS position FROM extracted)
      SELECT run_start, min(position) AS first_pos, max(position) AS last_pos, count(*) AS n, min(position) + count(*) // 2 AS label_pos FROM p GROUP BY 1""",
)
def period_boundaries(t):
    rows = joins.enrich_by_schedule(t.events.select("event_id", "ts"), t.runs)
    placed = periods.continuous_position(rows, period=["run_start", "equipment"], order_by=ORDER)
    return periods.position_bounds(placed, ["run_start"])


_SEQ = W("ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING")


@query(
    "sequence_windows",
    f"""WITH {TAGS} SELECT event_id, label, first_value, last_value, {r('total', 4)} AS total FROM (SELECT event_id, count(*) {_SEQ} AS n, moisture AS label,
      first_value("temp_PV") {_SEQ} AS first_value, last_value("temp_PV") {_SEQ} AS last_value, sum(pressure) {_SEQ} AS total FROM tags) WHERE n = 60""",
)
def sequence_windows(t):
    df = t.tags.select("event_id", "ts", "temp_PV", "pressure", "moisture")
    out = windows.sequences(df, ["temp_PV", "pressure"], "moisture", length=60, order_by=ORDER)
    s = F.col("sequence")
    return out.select(
        "event_id", "label", s[0][0].alias("first_value"), s[59][0].alias("last_value"),
        R(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x[1]), 4).alias("total"),
    )


@query(
    "resample_hourly",
    f"""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS bin, avg(value) AS m FROM events GROUP BY 1, 2),
      s AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM h GROUP BY 1)
      SELECT user_id, bin, {r('m')} AS mean_value FROM s LEFT JOIN h USING (user_id, bin)""",
)
def resample_hourly(t):
    return windows.resample(t.events, [R(F.avg("value")).alias("mean_value")], seconds=3600, partition_by=["user_id"])


@query(
    "resample_daily",
    f"""WITH h AS (SELECT date_trunc('day', ts) AS bin, {r('avg(value)')} AS mean_value, min(value) AS min_value, max(value) AS max_value, {r('stddev_samp(value)')} AS std_value FROM events GROUP BY 1)
      SELECT * FROM (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 DAY)) AS bin FROM h) LEFT JOIN h USING (bin)""",
)
def resample_daily(t):
    aggs = [R(F.avg("value")).alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), R(F.stddev_samp("value")).alias("std_value")]
    return windows.resample(t.events, aggs, seconds=86400)
