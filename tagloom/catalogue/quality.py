"""Profiling and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalogue.aggregates import LINE_COLUMNS
from tagloom.catalogue.base import TAGS, R, query, r, rounded
from tagloom.operators import quality

ORDER = ["ts", "event_id"]
TAG_COLUMNS = ["temp_PV", "temp_SV", "flow_rate", "pressure"]


def _each(columns, template: str) -> str:
    """``template`` once per column ({c}: quoted identifier, {n}: its name), united."""
    return " UNION ALL ".join(template.format(c=f'"{c}"', n=c) for c in columns)


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_TYPES = {"c_custkey": ("bigint", "numeric"), "c_name": ("string", "categorical"), "c_nationkey": ("int", "numeric"),
          "c_acctbal": ("double", "numeric"), "c_mktsegment": ("string", "categorical")}


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{_TYPES[c][0]}' AS dtype, '{_TYPES[c][1]}' AS kind, count(*) - count({c}) AS n_null,
          round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS n_distinct,
          (SELECT substr(CAST({c} AS VARCHAR), 1, 20) FROM customer ORDER BY c_custkey LIMIT 1) AS sample FROM customer"""
        for c in CUSTOMER
    ),
)
def column_profile(t):
    return quality.column_profile(t.customer, ["c_custkey"])


@query(
    "shape_stats",
    _each(
        LINE_COLUMNS,
        "SELECT '{n}' AS \"column\", " + r("skewness({c})", 4) + " AS skew, " + r("kurtosis({c})", 4) + " AS kurtosis, "
        + r("stddev_samp({c}) / avg({c})", 4) + " AS cv, count(*) FILTER ({c} = 0) AS n_zero, count(*) FILTER ({c} < 0) AS n_negative FROM lineitem",
    ),
)
def shape_stats(t):
    return rounded(quality.shape_stats(t.lineitem, LINE_COLUMNS), "skew", "kurtosis", "cv", digits=4)


@query(
    "missing_summary",
    f"""WITH {TAGS} SELECT 'flow_rate' AS "column", count(*) - count(flow_rate) AS n_null,
      round(100.0 * (count(*) - count(flow_rate)) / count(*), 2) AS null_pct FROM tags""",
)
def missing_summary(t):
    return quality.missing_summary(t.tags)


# Two columns with different gaps.
GAPPY = f"""{TAGS}, gappy AS (SELECT event_id, ts, flow_rate, CASE WHEN event_id % 5 <> 0 THEN pressure END AS pressure, "temp_PV" FROM tags)"""


def _gappy(t):
    pressure = F.when(F.col("event_id") % 5 != 0, F.col("pressure")).alias("pressure")
    return t.tags.select("event_id", "ts", "flow_rate", pressure, "temp_PV")


@query(
    "missing_patterns",
    f"""WITH {GAPPY} SELECT CAST(flow_rate IS NULL AS INTEGER) AS flow_rate, CAST(pressure IS NULL AS INTEGER) AS pressure, count(*) AS n
      FROM gappy GROUP BY 1, 2 ORDER BY n DESC LIMIT 10""",
)
def missing_patterns(t):
    return quality.missing_patterns(_gappy(t), ["flow_rate", "pressure"])


@query(
    "missing_corr",
    f"""WITH {GAPPY} SELECT 'flow_rate' AS var1, 'pressure' AS var2,
      {r('corr(CAST(flow_rate IS NULL AS INTEGER), CAST(pressure IS NULL AS INTEGER))')} AS r FROM gappy""",
)
def missing_corr(t):
    return rounded(quality.missing_corr(_gappy(t), ["flow_rate", "pressure"]), "r")


OUTLIER_COLUMNS = ["l_quantity", "l_extendedprice", "l_tax"]
OUTLIERS = _each(
    OUTLIER_COLUMNS,
    """SELECT '{n}' AS "column", count({c}) AS n, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_iqr,
      round(100.0 * count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 2) AS iqr_pct,
      count(*) FILTER (abs(({c} - mu) / sd) > 3) AS n_z, round(100.0 * count(*) FILTER (abs(({c} - mu) / sd) > 3) / count({c}), 2) AS z_pct
      FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS mu, stddev_pop({c}) AS sd FROM lineitem)""",
)
EVENT_OUTLIERS = OUTLIERS.split(" UNION ALL ")[0].replace("l_quantity", "value").replace("lineitem", "events")


@query("outliers", OUTLIERS)
def outliers(t):
    return quality.outliers(t.lineitem, OUTLIER_COLUMNS)


@query("event_outliers", EVENT_OUTLIERS)
def event_outliers(t):
    return quality.outliers(t.events, ["value"])


@query(
    "iqr_clip",
    f"""SELECT event_id, {r('least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))')} AS value
      FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""",
)
def iqr_clip(t):
    return rounded(quality.clip_outliers(t.events.select("event_id", "value"), ["value"]), "value")


_PAST = "OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "rule_fill",
    f"""WITH {TAGS}, g AS (SELECT event_id, ts, flow_rate, CASE WHEN event_id % 50 <> 7 THEN pressure END AS pressure FROM tags)
      SELECT event_id, {r('coalesce(flow_rate, (SELECT avg(flow_rate) FROM g))')} AS flow_rate, last_value(pressure IGNORE NULLS) {_PAST} AS pressure FROM g""",
)
def rule_fill(t):
    """A seventh of flow_rate is missing (mean), a fiftieth of pressure (carried forward)."""
    pressure = F.when(F.col("event_id") % 50 != 7, F.col("pressure")).alias("pressure")
    df = t.tags.select("event_id", "ts", "flow_rate", pressure)
    out = quality.fill_by_rule(df, ["flow_rate", "pressure"], order_by=ORDER)
    return rounded(out.drop("ts"), "flow_rate")


@query(
    "mean_zero_fill",
    f"""WITH {GAPPY} SELECT event_id, {r("coalesce(flow_rate, (SELECT avg(flow_rate) FROM gappy WHERE ts < TIMESTAMP '2024-01-20'))")} AS flow_rate,
      coalesce(pressure, 0) AS pressure FROM gappy""",
)
def mean_zero_fill(t):
    """Mean of the training period for one column, zero for the other."""
    df = _gappy(t)
    filled = quality.fill_mean(df, ["flow_rate"], train=df.where("ts < TIMESTAMP_NTZ'2024-01-20'"))
    return rounded(quality.fill_zero(filled, ["pressure"]).select("event_id", "flow_rate", "pressure"), "flow_rate")


@query(
    "quality_checks",
    """SELECT 'quality' AS source, 'duplicate_rows' AS kind, NULL AS "column", 'count' AS metric, CAST(sum(c - 1) AS DOUBLE) AS value
      FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) HAVING sum(c - 1) > 0
      UNION ALL SELECT 'quality', 'constant_column', 'unit_temp', 'n_distinct', 1.0
      UNION ALL SELECT 'quality', 'extreme_value', 'unit_temp', 'max', -1.0
      UNION ALL SELECT 'quality', 'negative_temperature', 'unit_temp', 'min', -1.0
      UNION ALL SELECT 'quality', 'time_reversal', 'l_shipdate', 'min_gap_s', min(g) FROM (
        SELECT epoch(l_shipdate) - lag(epoch(l_shipdate)) OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem))
      HAVING min(g) <= 0""".replace(
        "(SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)",
        "(SELECT 1 AS c FROM lineitem GROUP BY l_orderkey, l_linenumber, l_shipdate)",
    ),
)
def quality_checks(t):
    """Line keys with a constant, negative temperature column (-1 also exceeds 1000 times its
    median) and ship dates in key order."""
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").distinct().withColumn("unit_temp", F.lit(-1.0))
    return quality.quality_checks(df, ts="l_shipdate", file_order=["l_orderkey", "l_linenumber", "l_shipdate"])


@query(
    "quality_score",
    f"""WITH {GAPPY}, s AS (SELECT (count(*) - count(flow_rate) + count(*) - count(pressure)) / (count(*) * 5.0) AS m FROM gappy)
      SELECT {r('m')} AS missing_ratio, CAST(0 AS DOUBLE) AS duplicate_ratio, CAST(trunc(100 - m * 30 - 10 - 10) AS BIGINT) AS score FROM s""",
)
def quality_score(t):
    return rounded(quality.quality_score(_gappy(t), 1, 2), "missing_ratio", "duplicate_ratio")


@query(
    "confidence",
    "SELECT user_id, count(*) AS n, CASE WHEN count(*) < 100 THEN '低（データ数不足）' WHEN count(*) < 1000 THEN '中（データ・特徴量ともに限定的）' ELSE '中（発見事項少）' END AS confidence FROM events GROUP BY 1",
)
def confidence(t):
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("confidence", quality.confidence(F.col("n"), F.lit(4), F.lit(3)))


@query(
    "jarque_bera",
    _each(
        ["l_quantity", "l_extendedprice"],
        """SELECT '{n}' AS "column", """ + r("jb", 2) + " AS jb, " + r("exp(-jb / 2)", 8)
        + """ AS p_value, exp(-jb / 2) < 0.05 AS non_normal FROM (
          SELECT count(*) / 6.0 * (pow(sum(pow({c} - mu, 3)) / count(*) / pow(max(sd), 3), 2) + pow(sum(pow({c} - mu, 4)) / count(*) / pow(max(sd), 4) - 3, 2) / 4) AS jb
          FROM lineitem, (SELECT avg({c}) AS mu, stddev_pop({c}) AS sd FROM lineitem))""",
    ),
)
def jarque_bera(t):
    out = quality.jarque_bera(t.lineitem, ["l_quantity", "l_extendedprice"])
    return rounded(rounded(out, "jb", digits=2), "p_value", digits=8)
