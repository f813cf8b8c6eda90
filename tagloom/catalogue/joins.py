"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalogue.base import EXTRACTED, MINUTES, RUNS, query
from tagloom.operators import aggregates, joins, periods, windows

# Daily order totals against daily shipped quantity: two series on one time column.
DAILY = """l AS (SELECT o_orderdate AS ts, o_custkey AS line_id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'),
  d AS (SELECT l_shipdate AS ts, l_suppkey AS line_id, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"""


def _daily(t):
    left = t.orders.where("o_orderstatus = 'F'").select(
        F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("line_id"), F.col("o_totalprice").alias("v")
    )
    right = t.lineitem.groupBy(F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("line_id")).agg(F.sum("l_quantity").alias("v"))
    return left, right


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("outer", "FULL JOIN")):

    @query(
        f"merge_{_how}",
        f"WITH {DAILY} SELECT ts, line_id, l.v AS v_x, d.v AS v_y FROM l {_join} d USING (ts, line_id)",
    )
    def _merge(t, how=_how):
        left, right = _daily(t)
        return joins.merge(left, right, ["ts", "line_id"], how)


@query(
    "join_on_index",
    """WITH a AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1),
      b AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n FROM events WHERE event_type = 'error' AND value > 150 GROUP BY 1)
      SELECT ts, a.n AS n_x, b.n AS n_y FROM a FULL JOIN b USING (ts)""",
)
def join_on_index(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")
    n = F.count(F.lit(1)).alias("n")
    a = t.events.where("event_type = 'view'").groupBy(day).agg(n)
    b = t.events.where("event_type = 'error' AND value > 150").groupBy(day).agg(n)
    return joins.merge(a, b, ["ts"], "outer")


ASOF = """SELECT l.event_id, l.ts, l.value AS value_x, r.value AS value_y
  FROM (SELECT * FROM events WHERE event_type = 'purchase') l
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON {on} l.ts >= r.ts"""


def _asof(t, by, rows_per_chunk=None):
    left = t.events.where("event_type = 'purchase'").select("event_id", "ts", "user_id", "value")
    right = t.events.where("event_type = 'view'").select("ts", "user_id", "value")
    if not by:
        left, right = left.drop("user_id"), right.drop("user_id")
    out = joins.asof(left, right, "ts", by=by, left_tie=["event_id"], right_tie=["value"], rows_per_chunk=rows_per_chunk)
    return out.select("event_id", "ts", "value_x", "value_y")


@query("asof_backward", ASOF.format(on=""))
def asof_backward(t):
    return _asof(t, [])


@query("asof_backward_by_unit", ASOF.format(on="l.user_id = r.user_id AND"))
def asof_backward_by_unit(t):
    return _asof(t, ["user_id"])


@query("asof_backward_chunked", ASOF.format(on=""))
def asof_backward_chunked(t):
    """The form used beyond one chunk of rows."""
    return _asof(t, [], rows_per_chunk=700)


@query("asof_backward_hot_unit", ASOF.format(on="l.user_id = r.user_id AND"))
def asof_backward_hot_unit(t):
    """The form used when one unit alone exceeds the bound of a task."""
    return _asof(t, ["user_id"], rows_per_chunk=10)


@query(
    "interval_enrich",
    f"""WITH {EXTRACTED} SELECT event_id, ts, "temp_PV", run_product AS product, equipment, run_start, run_end,
      strftime(run_date, '%Y-%m-%d') AS run_date FROM extracted""",
)
def interval_enrich(t):
    tags = t.tags.select("event_id", "ts", "temp_PV")
    return joins.enrich_by_schedule(tags, t.runs).withColumn("run_date", F.col("run_date").cast("string"))


UNIT_RUNS = """SELECT e.event_id, e.ts, s.event_id AS run_id FROM events e
  JOIN (SELECT * FROM events WHERE event_type = 'signup') s
  ON e.user_id = s.user_id AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 2 HOUR"""


@query("interval_enrich_by_unit", UNIT_RUNS)
def interval_enrich_by_unit(t):
    rows = t.events.select("event_id", "ts", F.col("user_id").alias("unit"))
    return joins.interval_join(rows, t.unit_runs, on=["unit"]).select("event_id", "ts", "run_id")


@query("interval_enrich_shuffled", UNIT_RUNS)
def interval_enrich_shuffled(t):
    """The salted shuffle form used when the schedule is too long to broadcast."""
    rows = t.events.select("event_id", "ts", F.col("user_id").alias("unit"))
    joined = joins.interval_join(rows, t.unit_runs, on=["unit"], broadcast_rows=100, hot_rows=2)
    return joined.select("event_id", "ts", "run_id")


OPEN_RUNS = """SELECT e.event_id, s.event_id AS run_id FROM events e
  JOIN (SELECT *, CASE WHEN event_id % 9 = 0 THEN TIMESTAMP '9999-12-31' ELSE ts + INTERVAL 2 HOUR END AS run_end FROM events WHERE event_type = 'signup') s
  ON e.user_id = s.user_id AND e.ts BETWEEN s.ts AND s.run_end"""


def _open_runs(t, **options):
    rows = t.events.select("event_id", "ts", F.col("user_id").alias("unit"))
    end = F.when(F.col("run_id") % 9 == 0, F.lit("9999-12-31").cast("timestamp_ntz")).otherwise(F.col("run_end"))
    return joins.interval_join(rows, t.unit_runs.withColumn("run_end", end), on=["unit"], **options).select("event_id", "run_id")


@query("interval_open_ended", OPEN_RUNS)
def interval_open_ended(t):
    """Short runs and runs without an end: each has at most two rows in the index."""
    return _open_runs(t)


@query("interval_open_ended_shuffled", OPEN_RUNS)
def interval_open_ended_shuffled(t):
    return _open_runs(t, broadcast_rows=10, hot_rows=20)


@query(
    "empty_runs",
    f"WITH {RUNS} SELECT product, run_start FROM runs r WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.ts BETWEEN run_start AND run_end)",
)
def empty_runs(t):
    return joins.empty_runs(t.events.select("ts"), t.runs).select("product", "run_start")


@query(
    "rows_per_period",
    f"WITH {RUNS} SELECT run_start, product, count(*) AS n FROM runs JOIN events ON ts BETWEEN run_start AND run_end GROUP BY 1, 2",
)
def rows_per_period(t):
    joined = periods.rows_by_period(t.events.select("ts"), t.runs)
    return joined.groupBy("run_start", "product").agg(F.count(F.lit(1)).alias("n"))


HORIZON = f"""WITH {MINUTES} SELECT a.ts, a.moisture, b.moisture AS label FROM minutes a
  LEFT JOIN minutes b ON b.ts = a.ts + INTERVAL 30 MINUTE"""


@query("horizon_label", HORIZON)
def horizon_label(t):
    return windows.horizon_label(t.minutes.select("ts", "moisture"), "moisture", 30)


@query("horizon_label_chunked", HORIZON)
def horizon_label_chunked(t):
    return windows.horizon_label(t.minutes.select("ts", "moisture"), "moisture", 30, rows_per_chunk=900)


@query(
    "time_lag_join",
    f"""WITH {MINUTES} SELECT a.ts, a.pressure AS pressure_lag0m, b.pressure AS pressure_lag3m, c.pressure AS pressure_lag10m
      FROM minutes a LEFT JOIN minutes b ON b.ts = a.ts - INTERVAL 3 MINUTE LEFT JOIN minutes c ON c.ts = a.ts - INTERVAL 10 MINUTE""",
)
def time_lag_join(t):
    return windows.time_lags(t.minutes.select("ts", "pressure"), ["pressure"], [0, 3, 10]).drop("pressure")


@query(
    "union_keyed",
    "SELECT 'orders' AS source, o_orderdate AS ts, o_totalprice AS v FROM orders UNION ALL SELECT 'lineitem', l_shipdate, l_extendedprice FROM lineitem",
)
def union_keyed(t):
    a = t.orders.select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    b = t.lineitem.select(F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("v"))
    return aggregates.union_keyed({"orders": a, "lineitem": b})


@query(
    "union_missing_cols",
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
)
def union_missing_cols(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return aggregates.union_rows(a, b)


@query("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def distinct_values(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query(
    "keep_first",
    """SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def keep_first(t):
    df = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return aggregates.keep_first(df, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")
