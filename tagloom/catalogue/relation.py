"""Correlation and time-series analysis queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tagloom.catalogue.base import TAGS, R, query, r, rounded
from tagloom.catalogue.quality import TAG_COLUMNS
from tagloom.operators import relate, series, spectrum
from tagloom.operators.order import row_index

ORDER = ["ts", "event_id"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(columns, source):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS var1, '{b}' AS var2, {r(f'corr("{a}", "{b}")')} AS r FROM {source}""" for a, b in combinations(columns, 2)
    )


@query("corr_matrix", _corr_sql(LINE, "lineitem"))
def corr_matrix(t):
    return rounded(relate.corr_matrix(t.lineitem, LINE), "r")


MOIST = ["temp_PV", "temp_SV", "flow_rate", "pressure", "moisture"]


def _wide(i: int) -> str:
    """Column i of a wide table over events, in SQL that both engines read: its own mix and gaps of every column."""
    return f"CASE WHEN event_id % {i + 5} <> {i % 3} THEN value * {i + 1} + (event_id * {2 * i + 3}) % {97 + i} END AS w{i}"


WIDE = [f"w{i}" for i in range(45)]
_WIDE_ROWS = f"(SELECT value, {', '.join(map(_wide, range(45)))} FROM events)"


_WIDE_PAIRS = ", ".join(f"""struct_pack(var1 := '{a}', var2 := '{b}', r := {r(f'corr({a}, {b})')})""" for a, b in combinations(WIDE[:30], 2))


@query("corr_matrix_wide", f"SELECT u.var1, u.var2, u.r FROM (SELECT unnest([{_WIDE_PAIRS}]) AS u FROM {_WIDE_ROWS})")
def corr_matrix_wide(t):
    """All pairs of 30 columns, each with gaps of its own: more than one expression per pair is good for."""
    return rounded(relate.corr_matrix(t.events.selectExpr(*map(_wide, range(30))), WIDE[:30]), "r")


@query(
    "corr_with_target_wide",
    "SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {r(f'abs(corr({c}, value))')} AS abs_r FROM {_WIDE_ROWS}""" for c in WIDE)
    + """) ORDER BY abs_r DESC, "column" LIMIT 10""",
)
def corr_with_target_wide(t):
    """The ten of 45 columns that go most with the target."""
    wide = t.events.selectExpr("value", *map(_wide, range(45)))
    return rounded(relate.corr_with_target(wide, "value", WIDE), "abs_r")


@query("high_corr_pairs", f"WITH {TAGS} SELECT * FROM ({_corr_sql(MOIST, 'tags')}) WHERE abs(r) > 0.7")
def high_corr_pairs(t):
    return rounded(relate.high_corr_pairs(t.tags, MOIST), "r")


@query(
    "corr_with_target",
    f"WITH {TAGS} SELECT var1 AS \"column\", abs(r) AS abs_r FROM ("
    + " UNION ALL ".join(f"""SELECT '{c}' AS var1, {r(f'corr("{c}", moisture)')} AS r FROM tags""" for c in MOIST[:4])
    + ") ORDER BY abs_r DESC LIMIT 10",
)
def corr_with_target(t):
    return rounded(relate.corr_with_target(t.tags, "moisture", MOIST), "abs_r")


def _cross_sql(a, b):
    lags = "".join(f", lead({b}, {k}) OVER w AS l{k + 20}" if k >= 0 else f", lag({b}, {-k}) OVER w AS l{k + 20}" for k in range(-20, 21))
    rows = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag, corr({a}, l{k + 20}) AS r FROM s" for k in range(-20, 21))
    return f"""WITH {TAGS}, p AS (SELECT * FROM tags WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
      s AS MATERIALIZED (SELECT {a}{lags} FROM p WINDOW w AS (ORDER BY ts, event_id))
      SELECT '{a.strip('"')}' AS var1, '{b}' AS var2, lag, {r('r')} AS r FROM ({rows})"""


CROSS = _cross_sql('"temp_PV"', "flow_rate")


@query("cross_corr", CROSS)
def cross_corr(t):
    return rounded(relate.cross_corr(t.tags, ["temp_PV", "flow_rate"], order_by=ORDER), "r")


@query("cross_corr_chunked", CROSS)
def cross_corr_chunked(t):
    return rounded(relate.cross_corr(t.tags, ["temp_PV", "flow_rate"], order_by=ORDER, rows_per_chunk=2500), "r")


@query(
    "best_lag",
    f"SELECT var1, var2, arg_max(lag, abs(r)) AS best_lag, arg_max(r, abs(r)) AS best_r FROM ({CROSS}) GROUP BY 1, 2",
)
def best_lag(t):
    table = relate.cross_corr(t.tags, ["temp_PV", "flow_rate"], order_by=ORDER)
    return rounded(relate.best_lags(table), "best_r")


def _auto_sql(column, lags):
    cols = ", ".join(f"lead({column}, {k}) OVER w AS l{k}" for k in lags)
    rows = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag, {r(f'corr({column}, l{k})')} AS r FROM s" for k in lags)
    return f"""WITH {TAGS}, s AS MATERIALIZED (SELECT {column}, {cols} FROM tags WHERE {column} IS NOT NULL WINDOW w AS (ORDER BY ts, event_id)) {rows}"""


@query("autocorr", _auto_sql("pressure", range(1, 100)))
def autocorr(t):
    return rounded(relate.autocorr(t.tags, "pressure", order_by=ORDER), "r")


_ACF = range(50)


@query(
    "acf",
    f"""WITH {TAGS}, c AS (SELECT ts, event_id, moisture - (SELECT avg(moisture) FROM tags) AS c FROM tags),
      s AS MATERIALIZED (SELECT {", ".join(f"c * lead(c, {k}) OVER w AS p{k}" for k in _ACF)} FROM c WINDOW w AS (ORDER BY ts, event_id)),
      a AS MATERIALIZED (SELECT {", ".join(f"sum(p{k}) AS p{k}" for k in _ACF)} FROM s) """
    + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag, {r(f'p{k} / p0')} AS r FROM a" for k in _ACF),
)
def acf(t):
    return rounded(relate.acf(t.tags, "moisture", order_by=ORDER), "r")


@query(
    "operating_pattern",
    f"""WITH p AS (SELECT 'hour' AS part, extract(hour FROM ts) AS key, value FROM events
        UNION ALL SELECT 'weekday', extract(isodow FROM ts) - 1, value FROM events UNION ALL SELECT 'month', extract(month FROM ts), value FROM events)
      SELECT part, key, count(*) AS n, {r('avg(value)')} AS mean_value FROM p GROUP BY 1, 2""",
)
def operating_pattern(t):
    return rounded(series.operating_pattern(t.events, ["value"]), "mean_value")


@query("weekend_share", f"SELECT {r('avg(CAST(extract(isodow FROM ts) >= 6 AS INTEGER))')} AS weekend_share FROM events")
def weekend_share(t):
    return rounded(series.weekend_share(t.events), "weekend_share")


def _root_flow(t):
    """A gappy column without repeated differences, so that thresholds meet no ties."""
    return t.tags.select("ts", "event_id", F.sqrt("flow_rate").alias("root_flow"))


def _change_sql():
    now = "OVER (ORDER BY ts, event_id ROWS 9 PRECEDING)"
    return f"""WITH {TAGS}, v AS (SELECT ts, event_id, sqrt(flow_rate) AS x FROM tags WHERE flow_rate IS NOT NULL),
      m AS (SELECT ts, event_id, CASE WHEN count(x) {now} = 10 THEN avg(x) {now} END AS m, CASE WHEN count(x) {now} = 10 THEN stddev_samp(x) {now} END AS s FROM v),
      d AS (SELECT ts, event_id, abs(m - lag(m) OVER (ORDER BY ts, event_id)) AS dm, abs(s - lag(s) OVER (ORDER BY ts, event_id)) AS ds FROM m),
      q AS (SELECT quantile_cont(dm, 0.95) AS qm, quantile_cont(ds, 0.95) AS qs FROM d)
      SELECT ts, event_id, 'root_flow' AS "column", 'mean' AS kind, {r('dm')} AS change FROM d, q WHERE dm > qm
      UNION ALL SELECT ts, event_id, 'root_flow', 'std', {r('ds')} FROM d, q WHERE ds > qs"""


@query("change_points", _change_sql())
def change_points(t):
    return rounded(series.change_points(_root_flow(t), ["root_flow"], order_by=ORDER), "change")


def _decompose_sql(period: int) -> str:
    h = period // 2
    if period % 2:
        ma = f"avg(x) OVER (ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    else:
        ma = f"""(sum(x) OVER (ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h - 1} FOLLOWING)
          + sum(x) OVER (ORDER BY i ROWS BETWEEN {h - 1} PRECEDING AND {h} FOLLOWING)) / {2 * period}"""
    return f"""WITH {TAGS},
      f AS (SELECT ts, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, coalesce(
          last_value(sqrt(flow_rate) IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
          first_value(sqrt(flow_rate) IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM tags),
      n AS (SELECT count(*) AS n FROM f),
      m AS (SELECT f.*, n, CASE WHEN i BETWEEN {h} AND n - 1 - {h} THEN {ma} END AS raw FROM f, n),
      a AS (SELECT regr_slope(raw, i) AS k, regr_intercept(raw, i) AS c FROM m WHERE i BETWEEN {h} AND {h + period - 1}),
      b AS (SELECT regr_slope(raw, i) AS k, regr_intercept(raw, i) AS c FROM m WHERE i BETWEEN n - 1 - {h} - {period} AND n - 2 - {h}),
      t AS (SELECT m.*, CASE WHEN i < {h} THEN i * a.k + a.c WHEN i > n - 1 - {h} THEN i * b.k + b.c ELSE raw END AS trend FROM m, a, b),
      s AS (SELECT i % {period} AS phase, avg(x - trend) AS s FROM t GROUP BY 1)
      SELECT t.ts, t.event_id, t.i AS idx, t.x, {r('trend', 5)} AS trend, {r('s - (SELECT avg(s) FROM s)', 5)} AS seasonal,
        {r('x - trend - s + (SELECT avg(s) FROM s)', 5)} AS resid FROM t JOIN s ON s.phase = t.i % {period}"""


def _decompose(t, period, rows_per_chunk=None):
    out = series.decompose(_root_flow(t), "root_flow", order_by=ORDER, ts="ts", period=period, rows_per_chunk=rows_per_chunk)
    return rounded(out, "trend", "seasonal", "resid", digits=5)


@query("decompose", _decompose_sql(7))
def decompose(t):
    """The span is four weeks, so the period is 7 rows."""
    return _decompose(t, None)


@query("decompose_even", _decompose_sql(24))
def decompose_even(t):
    return _decompose(t, 24)


@query("decompose_long_period", _decompose_sql(1000))
def decompose_long_period(t):
    """A period too long for a halo: running sums looked up by index."""
    return _decompose(t, 1000, rows_per_chunk=1900)


@query(
    "decomposition_strength",
    f"""WITH d AS ({_decompose_sql(7)}), v AS (SELECT var_samp(trend) AS t, var_samp(seasonal) AS s, var_samp(resid) AS e FROM d)
      SELECT {r('t / (t + s + e)', 5)} AS trend_share, {r('s / (t + s + e)', 5)} AS seasonal_share, t / (t + s + e) > 0.3 AS strong_trend, s / (t + s + e) > 0.1 AS clear_season FROM v""",
)
def decomposition_strength(t):
    return rounded(series.decomposition_strength(_decompose(t, 7)), "trend_share", "seasonal_share", digits=5)


@query(
    "custom_variable",
    f"""SELECT {r('avg(value)')} AS mean, {r('quantile_cont(value, 0.5)')} AS median, {r('stddev_samp(value)')} AS std, min(value) AS min, max(value) AS max,
      {r('sum(pow(value - mu, 3)) / count(*) / pow(max(sd), 3)')} AS skew, {r('sum(pow(value - mu, 4)) / count(*) / pow(max(sd), 4) - 3')} AS kurtosis
      FROM events, (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events)""",
)
def custom_variable(t):
    return rounded(series.custom_variable(t.events, "value"), "mean", "median", "std", "skew", "kurtosis")


_IN = "ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'"


@query(
    "period_vs_overall",
    f"WITH {TAGS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r('p')} AS period_mean, {r('o')} AS overall_mean, {r('p - o')} AS diff, {r('(p - o) / o * 100')} AS diff_pct
          FROM (SELECT avg("{c}") FILTER ({_IN}) AS p, avg("{c}") AS o FROM tags)"""
        for c in TAG_COLUMNS
    ),
)
def period_vs_overall(t):
    out = series.period_vs_overall(t.tags, TAG_COLUMNS, "2024-01-10", "2024-01-12")
    return rounded(out, "period_mean", "overall_mean", "diff", "diff_pct")


@query("qq_table")
def qq_table(t):
    return series.qq_table(t.events, "value", ["event_id"])


@query(
    "qq_positions",
    f"""WITH o AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS i, count(*) OVER () AS n FROM events)
      SELECT i - 1 AS idx, value, {r('CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END', 9)} AS position FROM o""",
)
def qq_positions(t):
    return rounded(series.qq_table(t.events, "value", ["event_id"]).drop("quantile"), "position", digits=9)


@query("qq_fit")
def qq_fit(t):
    return series.qq_fit(series.qq_table(t.events, "value", ["event_id"]))


# The definition of the transform, one term per (frequency, value): quadratic, for the oracle only.
DFT = f"""WITH {TAGS}, v AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS j, moisture AS x FROM tags),
  s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM v), z AS (SELECT j, (x - m) / sd AS z, n FROM v, s),
  k AS (SELECT unnest(range(1, CAST((SELECT (n + 1) // 2 FROM s) AS BIGINT))) AS k)
  SELECT {r('k / CAST(max(n) AS DOUBLE)', 9)} AS frequency, {r('max(n) / CAST(k AS DOUBLE)')} AS period,
    {r('pow(sum(z * cos(2 * pi() * ((k * j) % n) / n)), 2) + pow(sum(z * sin(2 * pi() * ((k * j) % n) / n)), 2)', 2)} AS power FROM z, k GROUP BY k"""


def _periodogram(t, **options):
    table = spectrum.periodogram(t.tags, "moisture", order_by=ORDER, **options)
    return rounded(rounded(rounded(table, "frequency", digits=9), "period"), "power", digits=2)


@query("periodogram", DFT)
def periodogram(t):
    return _periodogram(t)


@query("periodogram_four_step", DFT)
def periodogram_four_step(t):
    """The form used for a series too long for one group."""
    return _periodogram(t, group_rows=2048)


@query(
    "periodogram_power",
    f"""WITH {TAGS}, v AS (SELECT moisture AS x FROM tags WHERE moisture IS NOT NULL), s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM v)
      SELECT n AS n_values, {r('(n * sum(pow((x - m) / sd, 2)) - pow(sum((x - m) / sd), 2)) / n / n', 5)} AS mean_power FROM v, s GROUP BY n, m, sd""",
)
def periodogram_power(t):
    """Parseval check: both halves of the spectrum plus the middle term carry n times the squared signal."""
    df = t.tags
    n = df.where("moisture IS NOT NULL").count()
    table = spectrum.periodogram(df, "moisture", order_by=ORDER, group_rows=2048)
    mean, std = df.agg(F.avg("moisture"), F.stddev_samp("moisture")).first()
    sign = F.when(F.col("i") % 2 == 0, 1.0).otherwise(-1.0)
    indexed = row_index(df.select("ts", "event_id", "moisture"), "i", order_by=ORDER)
    middle = indexed.agg(F.pow(F.sum(sign * (F.col("moisture") - mean) / std), F.lit(2)).alias("m"))
    nyquist = middle.scalar() if n % 2 == 0 else F.lit(0.0)
    total = table.agg((2 * F.sum("power")).alias("p")).withColumn("m", nyquist)
    return total.select(F.lit(n).cast("bigint").alias("n_values"), R((F.col("p") + F.col("m")) / n / n, 5).alias("mean_power"))


@query(
    "main_periods",
    f"SELECT * FROM (SELECT * FROM ({DFT}) ORDER BY power DESC LIMIT 3) WHERE period >= 2 AND period <= (SELECT count(*) / 4.0 FROM events)",
)
def main_periods(t):
    n = t.tags.where("moisture IS NOT NULL").count()
    return spectrum.main_periods(_periodogram(t), n)
