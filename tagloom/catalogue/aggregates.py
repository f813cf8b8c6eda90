"""Aggregation, period and plot-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalogue.base import EXTRACTED, RUNS, TAGS, R, query, r, rounded
from tagloom.functions import temporal
from tagloom.operators import aggregates, joins, periods, plotdata, quantiles
from tagloom.plans import extraction

def _n():
    return F.count(F.lit(1)).alias("n")


@query("group_mean", f"SELECT event_type, {r('avg(value)')} AS mean_value FROM events GROUP BY 1")
def group_mean(t):
    return aggregates.grouped(t.events, ["event_type"], [R(F.avg("value")).alias("mean_value")])


@query(
    "group_multi_agg",
    f"""SELECT l_returnflag, l_linestatus, {r('avg(l_quantity)')} AS mean_qty, {r('stddev_samp(l_quantity)')} AS std_qty,
      {r('sum(l_extendedprice)', 2)} AS sum_price, count(l_extendedprice) AS n FROM lineitem GROUP BY 1, 2""",
)
def group_multi_agg(t):
    return aggregates.grouped(
        t.lineitem, ["l_returnflag", "l_linestatus"],
        [R(F.avg("l_quantity")).alias("mean_qty"), R(F.stddev_samp("l_quantity")).alias("std_qty"),
         R(F.sum("l_extendedprice"), 2).alias("sum_price"), F.count("l_extendedprice").alias("n")],
    )


@query(
    "group_two_keys",
    f"SELECT user_id, event_type, count(*) AS n, {r('max(value)')} AS max_value FROM events GROUP BY 1, 2",
)
def group_two_keys(t):
    return aggregates.grouped(t.events, ["user_id", "event_type"], [_n(), R(F.max("value")).alias("max_value")])


@query(
    "group_cv_range",
    f"SELECT l_suppkey, {r('stddev_samp(l_quantity) / avg(l_quantity)')} AS cv, {r('max(l_quantity) - min(l_quantity)')} AS value_range FROM lineitem GROUP BY 1",
)
def group_cv_range(t):
    return aggregates.grouped(
        t.lineitem, ["l_suppkey"],
        [R(aggregates.cv("l_quantity")).alias("cv"), R(aggregates.value_range("l_quantity")).alias("value_range")],
    )


@query(
    "group_hourly",
    f"SELECT event_type, date_trunc('hour', ts) AS bin, count(*) AS n, {r('avg(value)')} AS mean_value FROM events GROUP BY 1, 2",
)
def group_hourly(t):
    keyed = t.events.withColumn("bin", temporal.floor_to("ts", 3600))
    return aggregates.grouped(keyed, ["event_type", "bin"], [_n(), R(F.avg("value")).alias("mean_value")])


@query("filtered_group", f"SELECT user_id, {r('avg(value)')} AS mean_value FROM events WHERE value > 85 GROUP BY 1")
def filtered_group(t):
    return aggregates.grouped(t.events, ["user_id"], [R(F.avg("value")).alias("mean_value")], where="value > 85")


@query("value_counts_top", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def value_counts_top(t):
    return aggregates.value_counts(t.part, "p_type", 10)


@query(
    "categorical_summary",
    """WITH c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 2
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)
      SELECT "column", count(*) AS n_distinct, max(n) AS mode_count, first(v ORDER BY n DESC, v) AS mode,
        max(n) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS mode_share FROM c GROUP BY 1""",
)
def categorical_summary(t):
    return aggregates.categorical_summary(t.orders, ["o_orderstatus", "o_orderpriority"])


def _describe_sql(table: str, columns: list[str], digits: int = 4) -> str:
    one = """SELECT '{c}' AS "column", count({q}) AS count, {mean} AS mean, {std} AS std, {lo} AS min, {hi} AS max,
      {q1} AS q25, {q2} AS q50, {q3} AS q75 FROM {t}"""
    parts = []
    for c in columns:
        q = f'"{c}"'
        quant = lambda p: r(f"quantile_cont(CAST({q} AS DOUBLE), {p})", digits)
        parts.append(
            one.format(c=c, q=q, t=table, mean=r(f"avg({q})", digits), std=r(f"stddev_samp({q})", digits), lo=r(f"min({q})", digits),
                       hi=r(f"max({q})", digits), q1=quant(0.25), q2=quant(0.5), q3=quant(0.75))
        )
    return " UNION ALL ".join(parts)


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STATS = ["mean", "std", "min", "max", "q25", "q50", "q75"]


@query("describe", _describe_sql("lineitem", LINE_COLUMNS))
def describe(t):
    return rounded(aggregates.describe(t.lineitem, LINE_COLUMNS), *STATS, digits=4)


@query(
    "quantiles_by_group",
    f"""SELECT event_type, p, {r('CASE p WHEN 0.05 THEN q[1] WHEN 0.5 THEN q[2] ELSE q[3] END')} AS value
      FROM (SELECT event_type, quantile_cont(value, [0.05, 0.5, 0.95]) AS q FROM events GROUP BY 1), (SELECT unnest([0.05::DOUBLE, 0.5, 0.95]) AS p)""",
)
def quantiles_by_group(t):
    return rounded(quantiles.quantiles(t.events, ["value"], [0.05, 0.5, 0.95], by=["event_type"]).drop("column"), "value")


@query(
    "quantiles_by_rank",
    f"""SELECT event_type, p, {r('CASE p WHEN 0.05 THEN q[1] WHEN 0.5 THEN q[2] ELSE q[3] END')} AS value
      FROM (SELECT event_type, quantile_cont(value, [0.05, 0.5, 0.95]) AS q FROM events GROUP BY 1), (SELECT unnest([0.05::DOUBLE, 0.5, 0.95]) AS p)""",
)
def quantiles_by_rank(t):
    """The form used beyond one chunk of rows: counted values picked by rank."""
    rows = quantiles.quantiles(t.events, ["value"], [0.05, 0.5, 0.95], by=["event_type"], rows_per_chunk=300)
    return rounded(rows.drop("column"), "value")


@query(
    "dup_rows",
    "SELECT sum(c) AS n_rows, sum(c - 1) AS n_duplicates, sum(c - 1) / CAST(sum(c) AS DOUBLE) AS duplicate_ratio FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)".replace(
        "sum(c) AS n_rows, sum(c - 1)", "CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT)", 1
    ),
)
def dup_rows(t):
    return aggregates.duplicate_rows(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("dup_timestamps", "SELECT count(o_orderdate) - count(DISTINCT o_orderdate) AS n_duplicates FROM orders")
def dup_timestamps(t):
    return aggregates.duplicate_timestamps(t.orders, "o_orderdate")


@query(
    "peak_hour",
    """WITH h AS (SELECT extract(hour FROM ts) AS hour, count(*) AS n FROM events GROUP BY 1)
      SELECT (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS peak_hour, (SELECT hour FROM h ORDER BY n, hour LIMIT 1) AS min_hour""",
)
def peak_hour(t):
    return aggregates.keep_extreme_hours(t.events, "ts")


@query(
    "weighted_mean",
    f"""WITH {TAGS} SELECT event_id, {r('("temp_PV" * 0.5 + "temp_SV" * 0.3 + pressure * 0.2)')} AS blend FROM tags""",
)
def weighted_mean(t):
    blend = aggregates.weighted_mean({"temp_PV": 0.5, "temp_SV": 0.3, "pressure": 0.2})
    return t.tags.select("event_id", R(blend).alias("blend"))


@query(
    "zero_negative_counts",
    "SELECT count(*) FILTER (c_acctbal < 0) AS n_negative, count(*) FILTER (c_acctbal = 0) AS n_zero FROM customer",
)
def zero_negative_counts(t):
    return t.customer.agg(F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.count_if(F.col("c_acctbal") == 0).alias("n_zero"))


@query(
    "sort_abs_top",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 10",
)
def sort_abs_top(t):
    return aggregates.top_k_abs(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 10, ["c_custkey"])


@query("tail_rows", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def tail_rows(t):
    return t.events.select("event_id", "ts", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


@query("sample_rows")
def sample_rows(t):
    return aggregates.sample_rows(t.lineitem, 5000, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("sample_bounds", "SELECT least(count(*), 5000) AS n, least(count(*), 5000) AS n_known, true AS again FROM lineitem")
def sample_bounds(t):
    """Size of the sample, how many of its rows are rows of the table, and that another layout gives the same rows."""
    keys = t.lineitem.select(*_KEYS)
    one, other = aggregates.sample_rows(keys, 5000, _KEYS), aggregates.sample_rows(keys.repartition(5), 5000, _KEYS)
    found = one.agg(F.count(F.lit(1)).alias("n")).crossJoin(one.join(keys, _KEYS, "left_semi").agg(F.count(F.lit(1)).alias("n_known")))
    both = one.join(other, _KEYS).agg(F.count(F.lit(1)).alias("n_both"))
    return found.crossJoin(both).select("n", "n_known", (F.col("n_both") == F.col("n")).alias("again"))


@query("lowest_values", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 5")
def lowest_values(t):
    return aggregates.bottom_k(t.events, "value", 5, ["event_id"]).select("event_id", "value")


@query(
    "extraction_counts",
    f"""WITH {EXTRACTED} SELECT 'product' AS part, run_product AS key, count(*) AS n FROM extracted GROUP BY 2
      UNION ALL SELECT 'equipment', CAST(equipment AS VARCHAR), count(*) FROM extracted GROUP BY 2
      UNION ALL SELECT 'day', strftime(run_date, '%Y-%m-%d'), count(*) FROM extracted GROUP BY 2""",
)
def extraction_counts(t):
    return extraction.extraction_counts(extraction.extract(t.tags.drop("product"), t.schedule))


@query(
    "extraction_summary",
    f"WITH {EXTRACTED} " + _describe_sql("extracted", ["temp_PV", "temp_SV", "flow_rate", "pressure"]),
)
def extraction_summary(t):
    extracted = extraction.extract(t.tags.drop("product"), t.schedule)
    tables = extraction.extraction_summary(extracted, ["temp_PV", "temp_SV", "flow_rate", "pressure"])
    return rounded(tables["statistics"], *STATS, digits=4)


@query(
    "operation_periods",
    f"WITH {EXTRACTED} SELECT run_start, run_end, run_product AS product, equipment, count(*) AS data_count FROM extracted GROUP BY ALL",
)
def operation_periods(t):
    return periods.operation_periods(joins.enrich_by_schedule(t.events.select("event_id", "ts"), t.runs))


@query(
    "period_stats",
    f"""WITH {RUNS} SELECT run_start, run_end, product, equipment, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std,
      min(value) AS min, max(value) AS max, count(value) AS n FROM runs JOIN events ON ts BETWEEN run_start AND run_end GROUP BY ALL""",
)
def period_stats(t):
    return rounded(periods.period_stats(t.events, t.runs, "value"), "mean", "std")


@query(
    "gantt_rows",
    f"""WITH {EXTRACTED} SELECT equipment, run_product AS product, run_start, epoch(run_end - run_start) / 3600.0 AS hours,
      run_start + (run_end - run_start) / 2 AS midpoint FROM extracted GROUP BY ALL""",
)
def gantt_rows(t):
    found = periods.operation_periods(joins.enrich_by_schedule(t.events.select("event_id", "ts"), t.runs))
    return periods.gantt(found)


def _histogram_sql(bins: int) -> str:
    return f"""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS total FROM lineitem),
      c AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / {bins})) AS BIGINT), {bins - 1}) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
      SELECT b.bin, {r(f'lo + b.bin * ((hi - lo) / {bins})')} AS low, {r(f'lo + b.bin * ((hi - lo) / {bins}) + (hi - lo) / {bins}')} AS high,
        coalesce(n, 0) AS n, {r(f'coalesce(n, 0) / (total * ((hi - lo) / {bins}))', 12)} AS density
      FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN s LEFT JOIN c USING (bin)"""


@query("histogram", _histogram_sql(50))
def histogram(t):
    h = rounded(plotdata.histogram(t.lineitem, "l_extendedprice", 50), "low", "high")
    return rounded(h, "density", digits=12)


@query(
    "histogram_by_product",
    """WITH s AS (SELECT event_type AS product, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
      c AS (SELECT event_type AS product, least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS bin, count(*) AS n
            FROM events JOIN s ON event_type = s.product GROUP BY ALL)
      SELECT product, b.bin, coalesce(n, 0) AS n FROM s CROSS JOIN (SELECT unnest(range(20)) AS bin) b LEFT JOIN c USING (product, bin)""",
)
def histogram_by_product(t):
    df = t.events.withColumnRenamed("event_type", "product")
    return plotdata.histogram(df, "value", 20, by=["product"]).select("product", "bin", "n")


@query(
    "density_curve",
    f"""WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n, stddev_samp(l_quantity) AS sd FROM lineitem),
      g AS (SELECT i, lo - 0.5 * (hi - lo) + i * (2 * (hi - lo) / 511) AS x, n, sd * pow(n, -0.2) AS bw FROM s CROSS JOIN (SELECT unnest(range(512)) AS i))
      SELECT i, {r('any_value(x)')} AS x, {r('sum(exp(-((x - l_quantity) / bw) * ((x - l_quantity) / bw) / 2)) / any_value(n * bw * sqrt(2 * pi()))', 8)} AS density
      FROM g CROSS JOIN lineitem GROUP BY i""",
)
def density_curve(t):
    """Against the kernel summed over all values one by one."""
    return rounded(rounded(plotdata.density(t.lineitem, "l_quantity"), "x"), "density", digits=8)


@query(
    "box_stats",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
      j AS (SELECT e.value, q.*, value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM events e JOIN q USING (event_type))
      SELECT event_type, %s AS q25, %s AS q50, %s AS q75, min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high,
        count(*) FILTER (NOT inside) AS n_outliers, count(*) AS n FROM j GROUP BY 1"""
    % (r("max(q25)"), r("max(q50)"), r("max(q75)")),
)
def box_stats(t):
    return rounded(plotdata.box_stats(t.events, "value", ["event_type"]), "q25", "q50", "q75")


@query(
    "downsample",
    f"SELECT user_id, date_trunc('hour', ts) AS bucket, min(value) AS value_min, {r('avg(value)')} AS value_mean, max(value) AS value_max FROM events GROUP BY 1, 2",
)
def downsample(t):
    return rounded(plotdata.downsample(t.events, ["value"], by=["user_id"]), "value_mean")


@query("scatter_matrix")
def scatter_matrix(t):
    return plotdata.scatter_matrix(t.tags, ["temp_PV", "temp_SV", "flow_rate", "pressure"], ["event_id"])
