"""Scans, sinks, typing, projection and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalogue.base import EXTRACTED, MINUTES, RUNS, TAGS, query
from tagloom.functions import scalars, temporal
from tagloom.operators import windows
from tagloom.operators.joins import interval_join
from tagloom.plans.extraction import extract
from tagloom.session import shared_dir
from tagloom.sources import readers, writers

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"


@query("select_cols", "SELECT event_id, event_type, value FROM events")
def select_cols(t):
    return t.events.select("event_id", "event_type", "value")


@query("csv_round_trip", "SELECT event_id, ts, user_id, event_type, value FROM events")
def csv_round_trip(t):
    path = shared_dir(t.spark)
    writers.write_csv(t.events, path, columns=["event_id", "ts", "user_id", "event_type", "value"])
    return readers.read_csv(t.spark, path, EVENT_SCHEMA)


_LABEL = "CASE event_type WHEN 'view' THEN '表示' WHEN 'click' THEN 'クリック、' WHEN 'error' THEN '\"故障\"' ELSE '購入' END"


@query("csv_encoding", f"SELECT event_id, {_LABEL} AS label FROM events")
def csv_encoding(t):
    """Japanese text written and read in Shift_JIS."""
    path = shared_dir(t.spark)
    writers.write_csv(t.events.select("event_id", F.expr(_LABEL).alias("label")), path, encoding="Shift_JIS")
    return readers.read_csv(t.spark, path, "event_id BIGINT, label STRING", encoding="Shift_JIS")


@query(
    "reload_extracted",
    f"WITH {EXTRACTED} SELECT event_id, ts, \"temp_PV\", flow_rate, run_product AS product, equipment, run_start, run_end, strftime(run_date, '%Y-%m-%d') AS run_date FROM extracted",
)
def reload_extracted(t):
    """An extracted table written as CSV and loaded again with the types of its run columns."""
    path = shared_dir(t.spark)
    writers.write_csv(extract(t.tags.select("ts", "event_id", "temp_PV", "flow_rate"), t.schedule), path)
    out = readers.read_extracted(t.spark, path, "event_id BIGINT, temp_PV DOUBLE, flow_rate DOUBLE")
    return out.withColumn("run_date", F.col("run_date").cast("string"))


@query(
    "schedule_file",
    f"WITH {RUNS} SELECT product, equipment, run_start, run_end, strftime(run_date, '%Y-%m-%d') AS run_date FROM runs WHERE (SELECT count(*) FROM events) > 0",
)
def schedule_file(t):
    """The schedule written as a sheet with a sub-header row, read again and turned into runs."""
    path = shared_dir(t.spark)
    text = lambda c: F.col(c).cast("string").alias(c)
    cells = ["date", "product", "equipment", "start_time", "sep", "next_day", "end_time", "total", "note"]
    sheet = t.schedule.withColumns({"sep": F.lit("～"), "total": F.lit(""), "note": F.lit("")}).select(*map(text, cells))
    sub = t.spark.createDataFrame([("日付", "品種", "号機", "開始", "", "翌", "終了", "計", "備考")], sheet.schema)
    writers.write_csv(sub.unionAll(sheet).where(F.lit(t.events.limit(1).count() > 0)).coalesce(1), path)
    return readers.schedule_runs(readers.read_schedule(t.spark, path)).withColumn("run_date", F.col("run_date").cast("string"))


@query("csv_pruned_filtered", "SELECT event_id, value FROM events WHERE value > 85")
def csv_pruned_filtered(t):
    path = shared_dir(t.spark)
    writers.write_csv(t.events.drop("props"), path, where="value > 85")
    return readers.read_csv(t.spark, path, EVENT_SCHEMA, columns=["event_id", "value"])


@query("csv_inferred_tags", "SELECT ts, event_id, value FROM events")
def csv_inferred_tags(t):
    path = shared_dir(t.spark)
    writers.write_csv(t.events.select("event_id", F.col("ts").alias("measured_time"), "value"), path)
    return readers.read_tags(t.spark, path).select("ts", F.col("event_id").cast("bigint").alias("event_id"), "value")


@query("json_round_trip", "SELECT event_id, date_trunc('millisecond', ts) AS ts, user_id, event_type, value FROM events")
def json_round_trip(t):
    path = shared_dir(t.spark)
    writers.write_json(t.events.drop("props"), path)
    return readers.read_json(t.spark, path, EVENT_SCHEMA)


@query(
    "report_sink",
    "SELECT 'data' AS part, count(*) AS n FROM events UNION ALL SELECT 'statistics', count(DISTINCT event_type) FROM events",
)
def report_sink(t):
    path = shared_dir(t.spark)
    stats = t.events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    writers.write_report({"data": t.events, "statistics": stats}, path)
    parts = [
        t.spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
        for p in ("data", "statistics")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "filter_compound",
    "SELECT event_id, event_type, value FROM events WHERE value > 50 AND value < 200 AND event_type = 'view'",
)
def filter_compound(t):
    v = F.col("value")
    return t.events.where((v > 50) & (v < 200) & (F.col("event_type") == "view")).select("event_id", "event_type", "value")


@query(
    "derive_ratio",
    f"""WITH {TAGS} SELECT event_id, "temp_PV" / nullif("temp_SV", 0) AS ratio, flow_rate - pressure AS delta FROM tags""",
)
def derive_ratio(t):
    return t.tags.select(
        "event_id", scalars.ratio(F.col("temp_PV"), F.col("temp_SV")).alias("ratio"),
        (F.col("flow_rate") - F.col("pressure")).alias("delta"),
    )


@query(
    "case_status",
    f"""WITH {TAGS} SELECT event_id, CASE WHEN flow_rate > 87 THEN '高' WHEN flow_rate < 83 THEN '低' ELSE '正常' END AS status FROM tags""",
)
def case_status(t):
    return t.tags.select("event_id", scalars.status_label(F.col("flow_rate")).alias("status"))


@query(
    "between_time",
    "SELECT event_id, ts FROM events WHERE CAST(ts AS TIME) BETWEEN TIME '08:00:00' AND TIME '12:00:00'",
)
def between_time(t):
    clock = F.date_format("ts", "HH:mm:ss.SSSSSS")
    return t.events.where(clock.between("08:00:00.000000", "12:00:00.000000")).select("event_id", "ts")


@query("day_filter", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-08'")
def day_filter(t):
    return t.events.where("ts >= TIMESTAMP_NTZ'2024-01-07' AND ts < TIMESTAMP_NTZ'2024-01-08'").select("event_id", "ts")


@query("period_filter", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-08'")
def period_filter(t):
    return t.events.where("ts >= TIMESTAMP_NTZ'2024-01-03' AND ts < TIMESTAMP_NTZ'2024-01-08'").select("event_id", "ts")


@query(
    "numeric_coerce",
    """SELECT event_id, TRY_CAST(a AS DOUBLE) AS plain, TRY_CAST(replace(b, ',', '') AS DOUBLE) AS grouped FROM (
      SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS a,
        CAST(event_id // 1000 AS VARCHAR) || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '.5' AS b FROM events)""",
)
def numeric_coerce(t):
    e = F.col("event_id")
    texts = t.events.select(
        "event_id",
        F.when(e % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")).alias("a"),
        F.concat(F.floor(e / 1000).cast("string"), F.lit(","), F.lpad((e % 1000).cast("string"), 3, "0"), F.lit(".5")).alias("b"),
    )
    return texts.select("event_id", scalars.to_number("a").alias("plain"), scalars.to_number_grouped("b").alias("grouped"))


@query(
    "numeric_text_columns",
    """SELECT name AS "column" FROM (SELECT unnest(['value_text', 'event_type', 'props']) AS name,
      unnest([bool_and(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) IS NOT NULL), bool_and(TRY_CAST(event_type AS DOUBLE) IS NOT NULL),
              bool_and(TRY_CAST(props AS DOUBLE) IS NOT NULL)]) AS ok FROM events) WHERE ok""",
)
def numeric_text_columns(t):
    df = t.events.select(F.col("value").cast("string").alias("value_text"), "event_type", "props")
    return t.spark.createDataFrame([(c,) for c in scalars.numeric_text_columns(df)], "column string")


@query("detect_timestamps_leading_nulls", "SELECT event_id, CASE WHEN event_id >= 200 THEN ts END AS ts_text, event_type FROM events")
def detect_timestamps_leading_nulls(t):
    late = F.when(F.col("event_id") >= 200, F.col("ts").cast("string"))
    return temporal.detect_timestamps(t.events.select("event_id", late.alias("ts_text"), "event_type"))


@query("detect_timestamps", "SELECT event_id, ts AS ts_text, event_type FROM events")
def detect_timestamps(t):
    texts = t.events.select("event_id", F.col("ts").cast("string").alias("ts_text"), "event_type")
    return temporal.detect_timestamps(texts)


@query("datetime_combine", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def datetime_combine(t):
    parts = t.events.select("event_id", F.date_format("ts", "yyyy/M/d").alias("d"), F.date_format("ts", "H:mm:ss").alias("t"))
    return parts.select("event_id", temporal.combine_date_time(F.col("d"), F.col("t")).alias("ts"))


@query("datetime_parts", "SELECT event_id, date_trunc('minute', ts) AS ts FROM events")
def datetime_parts(t):
    parts = [f("ts") for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute)]
    return t.events.select("event_id", temporal.from_parts(*parts).alias("ts"))


@query(
    "datetime_mixed",
    "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS ts FROM events",
)
def datetime_mixed(t):
    """Every row writes its time in one of three styles; every fourth is broken."""
    style = F.col("event_id") % 4
    fmt = lambda f: F.date_format("ts", f)
    texts = t.events.select(
        "event_id",
        F.when(style == 0, fmt("yyyy-MM-dd")).when(style == 1, fmt("MM/dd/yyyy")).when(style == 2, fmt("yyyy/M/d")).otherwise("n/a").alias("d"),
        F.when(style == 0, fmt("HH:mm")).when(style == 1, fmt("h:mm a")).otherwise(fmt("HH:mm:ss")).alias("t"),
    )
    return texts.select("event_id", temporal.parse_mixed(F.col("d"), F.col("t")).alias("ts"))


@query("minute_floor_first", f"WITH {MINUTES} SELECT ts, event_id, \"temp_PV\" FROM minutes")
def minute_floor_first(t):
    return t.minutes.select("ts", "event_id", "temp_PV")


@query("second_distribution", "SELECT CAST(extract(second FROM ts) AS BIGINT) AS second, count(*) AS n FROM events GROUP BY 1")
def second_distribution(t):
    return windows.second_distribution(t.events)


@query(
    "calendar_flags",
    """SELECT event_id, extract(hour FROM ts) AS hour, extract(isodow FROM ts) - 1 AS day_of_week, extract(day FROM ts) AS day_of_month,
      extract(month FROM ts) AS month, CAST(extract(isodow FROM ts) >= 6 AS INTEGER) AS is_weekend,
      CAST(extract(hour FROM ts) >= 22 OR extract(hour FROM ts) <= 6 AS INTEGER) AS is_night FROM events""",
)
def calendar_flags(t):
    return t.events.select(
        "event_id", *temporal.calendar("ts"), temporal.is_weekend("ts").alias("is_weekend"), temporal.is_night("ts").alias("is_night")
    )


@query("round_half_even", "SELECT event_id, round_even(event_id / 8.0, 2) AS v FROM events")
def round_half_even(t):
    return t.events.select("event_id", F.bround(F.col("event_id") / 8, 2).alias("v"))


@query("downcast_float", "SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS price FROM lineitem")
def downcast_float(t):
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return scalars.downcast(li, ["price"]).withColumn("price", F.col("price").cast("double"))


@query(
    "category_codes",
    "SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type_code FROM events",
)
def category_codes(t):
    return scalars.category_codes(t.events.select("event_id", "event_type"), "event_type")


@query(
    "category_codes_many",
    """SELECT l_orderkey, l_linenumber, l_partkey, part, CAST(dense_rank() OVER (ORDER BY part) - 1 AS INTEGER) AS part_code
      FROM (SELECT *, concat('p', l_partkey, '-', l_suppkey, '-', l_orderkey % 7) AS part FROM lineitem)""",
)
def category_codes_many(t):
    """A dictionary too long to broadcast: about one category for every other row."""
    name = F.concat(F.lit("p"), "l_partkey", F.lit("-"), "l_suppkey", F.lit("-"), F.col("l_orderkey") % 7)
    return scalars.category_codes(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", name.alias("part")), "part", limit=500, rows_per_chunk=5000)


@query(
    "rename_drop_assign",
    "SELECT event_id, value AS reading, CASE WHEN value > 100 THEN 1 END AS flag FROM events",
)
def rename_drop_assign(t):
    df = t.events.withColumnsRenamed({"value": "reading"}).drop("props", "ts", "user_id", "event_type")
    return df.withColumn("flag", F.when(F.col("reading") > 100, 1))


@query("drop_incomplete", f"WITH {TAGS} SELECT event_id, flow_rate FROM tags WHERE flow_rate IS NOT NULL")
def drop_incomplete(t):
    return t.tags.select("event_id", "flow_rate").dropna()


@query("safe_columns", "SELECT event_id, value FROM events")
def safe_columns(t):
    present, _ = scalars.existing(t.events, ["event_id", "humidity", "value"])
    return t.events.select(*present)


@query("schedule_runs", f"""SELECT product, equipment, run_start, run_end, strftime(run_date, '%Y-%m-%d') AS run_date,
      (SELECT count(*) FROM events e WHERE e.ts BETWEEN run_start AND run_end) AS n
    FROM (WITH {RUNS} SELECT * FROM runs)""")
def schedule_runs(t):
    keys = ["product", "equipment", "run_start", "run_end", "run_date"]
    n = interval_join(t.events.select("ts"), t.runs).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = t.runs.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.withColumn("run_date", F.col("run_date").cast("string"))
