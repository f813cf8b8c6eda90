"""Feature-construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalogue.base import MINUTES, TAGS, query, r, rounded
from tagloom.operators import features, models, scaling
from tagloom.operators.windows import time_lags

ORDER = ["ts", "event_id"]


@query("pv_sv_diff", f"""WITH {TAGS} SELECT event_id, "temp_PV" - "temp_SV" AS "temp_PV_SV_diff" FROM tags""")
def pv_sv_diff(t):
    return t.tags.select("event_id", *features.pv_sv_differences(t.tags.columns))


@query("interactions", f"""WITH {TAGS} SELECT event_id, "temp_PV" * flow_rate AS "temp_PV__x__flow_rate" FROM tags""")
def interactions(t):
    return t.tags.select("event_id", *features.interactions([("temp_PV", "flow_rate")]))


@query(
    "ratios",
    f"""WITH {TAGS} SELECT event_id, "temp_PV" / (nullif("temp_SV", 0) + 1e-6) AS "temp_PV__div__temp_SV",
      flow_rate / (pressure + 1e-8) AS flow_rate_pressure_ratio, flow_rate - pressure AS flow_rate_pressure_diff FROM tags""",
)
def ratios(t):
    return t.tags.select(
        "event_id", *features.ratios([("temp_PV", "temp_SV")]), *features.ratios_and_differences([("flow_rate", "pressure")])
    )


@query(
    "hinges",
    f"""WITH {TAGS}, q AS (SELECT quantile_cont(flow_rate, [0.25, 0.5, 0.75]) AS q FROM tags)
      SELECT event_id, {", ".join(f"{r(f'CASE WHEN flow_rate IS NOT NULL THEN greatest(flow_rate - q[{i + 1}], 0) END')} AS flow_rate__hinge_{i}" for i in range(3))} FROM tags, q""",
)
def hinges(t):
    out = t.tags.select("event_id", *features.hinges(t.tags, ["flow_rate"]))
    return rounded(out, *[f"flow_rate__hinge_{i}" for i in range(3)])


@query(
    "line_dummies",
    "SELECT event_id, "
    + ", ".join(f"CAST(event_type = '{c}' AS INTEGER) AS line_id_{c}" for c in ("click", "error", "purchase", "signup", "view"))
    + " FROM events",
)
def line_dummies(t):
    df = t.events.select("event_id", F.col("event_type").alias("line_id"))
    return df.select("event_id", *features.line_dummies(df))


@query(
    "line_dummies_long",
    """SELECT event_id, concat('line_id_', user_id) AS feature, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INTEGER) AS code, 1 AS value
      FROM events WHERE event_id % 5 > 0""",
)
def line_dummies_long(t):
    """The ones of the dummies of any number of categories; a fifth of the rows has none."""
    df = t.events.select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("user_id")).alias("line_id"))
    return features.line_dummies_long(df, ["event_id"], limit=10)


def _w(frame=""):
    return f"OVER (PARTITION BY unit ORDER BY ts, event_id {frame})"


def _feature_sql():
    c = '"temp_PV"'
    cols = [f'lag({c}, 30) {_w()} AS "temp_PV_lag30m"']
    cols += [f'{r(f"avg({c}) " + _w(f"ROWS {k - 1} PRECEDING"), 7)} AS "temp_PV_ma{k}m"' for k in (5, 15, 30, 60)]
    cols += [f'{r(f"stddev_samp({c}) " + _w(f"ROWS {k - 1} PRECEDING"), 7)} AS "temp_PV_std{k}m"' for k in (15, 30)]
    cols += [f'{c} - lag({c}, {k}) {_w()} AS "temp_PV_diff{k}"' for k in (1, 5)]
    return f"""WITH {TAGS} SELECT * FROM (SELECT event_id, unit, ts, {c}, "temp_SV", {", ".join(cols)}, {c} - "temp_SV" AS "temp_PV_SV_diff",
      extract(hour FROM ts) AS hour, extract(isodow FROM ts) - 1 AS day_of_week, CAST(extract(isodow FROM ts) >= 6 AS INTEGER) AS is_weekend FROM tags)
      WHERE "temp_PV_lag30m" IS NOT NULL"""


@query("create_features", _feature_sql())
def create_features(t):
    df = t.tags.select("event_id", "unit", "ts", "temp_PV", "temp_SV")
    out = features.create_features(df, ["temp_PV"], order_by=ORDER, partition_by=["unit"])
    return rounded(out, *[f"temp_PV_ma{k}m" for k in (5, 15, 30, 60)], "temp_PV_std15m", "temp_PV_std30m", digits=7)


@query(
    "create_features_extended",
    f"""WITH {TAGS} SELECT event_id, label, l24 AS "temp_PV_lag_24", {r('m20')} AS "temp_PV_mean_20", hi AS "temp_PV_max_20", pct AS "temp_PV_pct", is_night FROM (
      SELECT event_id, lead(moisture, 6) {_w()} AS label, lag("temp_PV", 24) {_w()} AS l24, avg("temp_PV") {_w('ROWS 19 PRECEDING')} AS m20,
        max("temp_PV") {_w('ROWS 19 PRECEDING')} AS hi, "temp_PV" / nullif(lag("temp_PV") {_w()}, 0) - 1 AS pct,
        CAST(extract(hour FROM ts) >= 22 OR extract(hour FROM ts) <= 6 AS INTEGER) AS is_night FROM tags) WHERE l24 IS NOT NULL AND label IS NOT NULL""",
)
def create_features_extended(t):
    df = t.tags.select("event_id", "unit", "ts", "temp_PV", "temp_SV", "moisture")
    out = features.create_features_extended(
        df, ["temp_PV"], target="moisture", order_by=ORDER, partition_by=["unit"], pairs=[("temp_PV", "temp_SV")]
    )
    out = out.select("event_id", "label", "temp_PV_lag_24", "temp_PV_mean_20", "temp_PV_max_20", "temp_PV_pct", "is_night")
    return rounded(out, "temp_PV_mean_20")


def _ridge_sql():
    win = "OVER (ORDER BY ts RANGE BETWEEN INTERVAL '179.999999' SECOND PRECEDING AND CURRENT ROW)"
    parts = []
    for m in (0, 3, 10):
        parts.append(f"LEFT JOIN e b{m} ON b{m}.ts = a.ts - INTERVAL {m} MINUTE")
    lagged = ["pressure", "temp_PV", "temp_SV", "control_error"]
    lag_cols = ", ".join(f'b{m}."{c}" AS "{c}_lag{m}m"' for m in (0, 3, 10) for c in lagged)
    return f"""WITH {MINUTES},
      q AS (SELECT quantile_cont(pressure, [0.25, 0.5, 0.75]) AS q FROM minutes),
      e AS (SELECT *, "temp_SV" - "temp_PV" AS control_error,
        avg(pressure) {win} AS p_mean, CASE WHEN count(pressure) {win} >= 1 THEN stddev_samp(pressure) {win} END AS p_std,
        stddev_samp("temp_PV") {win} AS v_std FROM minutes),
      d AS (SELECT a.ts, a.control_error, {r('a.p_mean')} AS pressure_mean_3m, {r('a.p_std')} AS pressure_std_3m,
        {", ".join(f"{r(f'greatest(a.pressure - q[{i + 1}], 0)')} AS pressure__hinge_{i}" for i in range(3))},
        {lag_cols}, y.moisture AS label, a.v_std AS v_std FROM e a CROSS JOIN q {" ".join(parts)} LEFT JOIN e y ON y.ts = a.ts + INTERVAL 30 MINUTE)
      SELECT * EXCLUDE (v_std) FROM d WHERE label IS NOT NULL AND "pressure_lag3m" IS NOT NULL AND "pressure_lag10m" IS NOT NULL AND pressure_std_3m IS NOT NULL AND v_std IS NOT NULL"""


_RIDGE_KEEP = ["ts", "control_error", "pressure_mean_3m", "pressure_std_3m", "pressure__hinge_0", "pressure__hinge_1", "pressure__hinge_2", "label"] + [
    f"{c}_lag{m}m" for m in (0, 3, 10) for c in ("pressure", "temp_PV", "temp_SV", "control_error")
]


def _ridge(t, rows_per_chunk=None):
    df = t.minutes.select("ts", "pressure", "temp_PV", "temp_SV", "moisture")
    mapping = {"spray_flow": "pressure", "SV": "temp_SV", "PV": "temp_PV"}
    out = features.ridge_matrix(df, "moisture", mapping=mapping, rows_per_chunk=rows_per_chunk)
    return rounded(out.select(*_RIDGE_KEEP), *[c for c in _RIDGE_KEEP if "mean" in c or "std" in c or "hinge" in c])


@query("ridge_matrix", _ridge_sql())
def ridge_matrix(t):
    """Lags, rolling values, control error, hinges and label, all by time on distinct minutes."""
    return _ridge(t)


@query("ridge_matrix_chunked", _ridge_sql())
def ridge_matrix_chunked(t):
    return _ridge(t, rows_per_chunk=2500)


@query(
    "control_error_lags",
    f"""WITH {MINUTES}, e AS (SELECT ts, "temp_SV" - "temp_PV" AS ce FROM minutes)
      SELECT a.ts, a.ce AS control_error, b.ce AS control_error_lag3m FROM e a LEFT JOIN e b ON b.ts = a.ts - INTERVAL 3 MINUTE""",
)
def control_error_lags(t):
    df = t.minutes.select("ts", (F.col("temp_SV") - F.col("temp_PV")).alias("control_error"))
    return time_lags(df, ["control_error"], [3])


@query(
    "standardize",
    f"""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('(l_quantity - m) / sd')} AS l_quantity FROM lineitem, s""",
)
def standardize(t):
    """Statistics of the training years applied to all rows."""
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    out = scaling.standardize(df, ["l_quantity"], train=df.where("l_shipdate < TIMESTAMP_NTZ'2000-01-01'"))
    return rounded(out.drop("l_shipdate"), "l_quantity")


@query(
    "select_by_corr",
    "SELECT \"column\", abs_r FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f'abs(corr({c}, l_extendedprice))')} AS abs_r FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax")
    )
    + ") ORDER BY abs_r DESC LIMIT 2",
)
def select_by_corr(t):
    return rounded(models.select_by_corr(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 2), "abs_r")


def _mi_sql():
    edges = lambda c: f"len([e for e in list_distinct(q_{c}) if {c} > e])"
    quants = ", ".join(f"quantile_cont({c}, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS q_{c}" for c in ("l_quantity", "l_tax", "l_extendedprice"))
    one = """SELECT '{c}' AS feature, sum(n / t * ln(n * t / (na * nb))) AS score FROM (
      SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb
      FROM (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem, q GROUP BY 1, 2))"""
    rows = " UNION ALL ".join(one.format(c=c, a=edges(c), b=edges("l_extendedprice")) for c in ("l_quantity", "l_tax"))
    return f"WITH q AS (SELECT {quants} FROM lineitem) SELECT feature, {r('score')} AS score FROM ({rows})"


@query("select_by_mi", _mi_sql())
def select_by_mi(t):
    return rounded(models.select_by_mutual_info(t.lineitem, ["l_quantity", "l_tax"], "l_extendedprice"), "score")


@query(
    "ts_split_sizes",
    """WITH n AS (SELECT count(*) AS n FROM events)
      SELECT f AS fold, n - (6 - f) * (n // 6) AS n_train, n // 6 AS n_test FROM n, (SELECT unnest(range(1, 6)) AS f)""",
)
def ts_split_sizes(t):
    return models.split_sizes(t.events, order_by=ORDER)
