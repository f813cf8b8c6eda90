"""Hand-computed micro cases for the semantics that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tagloom.functions import scalars, temporal
from tagloom.functions.text import parse_cards
from tagloom.operators import aggregates, features, findings, joins, periods, quality, relate, series, windows
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def minutes(spark, *values, step=1):
    data = [(T0 + dt.timedelta(minutes=i * step), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "ts timestamp_ntz, i bigint, v double")


def test_moments_are_bias_corrected(spark):
    df = minutes(spark, 1.0, 2.0, 4.0, 9.0)
    got = quality.shape_stats(df, ["v"]).first()
    assert got["skew"] == pytest.approx(1.3309, abs=1e-4) and got["kurtosis"] == pytest.approx(1.5)
    pop = series.custom_variable(df, "v").first()
    assert pop["skew"] == pytest.approx(0.7684, abs=1e-4) and pop["kurtosis"] == pytest.approx(-1.0)


def test_interpolation_ends(spark):
    df = minutes(spark, None, 2.0, None, None, 8.0, None)
    got = [r["v"] for r in windows.interpolate(df, ["v"], order_by=["ts"]).orderBy("i").collect()]
    assert got == [None, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_horizon_looks_ahead_and_lag_back(spark):
    df = minutes(spark, 1.0, 2.0, 3.0, 4.0, step=5)
    got = [r["label"] for r in windows.horizon_label(df, "v", 10).orderBy("i").collect()]
    assert got == [3.0, 4.0, None, None]
    got = [r["v_lag5m"] for r in windows.time_lags(df, ["v"], [5]).orderBy("i").collect()]
    assert got == [None, 1.0, 2.0, 3.0]


def test_true_lag_correlation(spark):
    values = [math.sin(i * 0.7) + (i % 5) * 0.3 for i in range(60)]
    data = [(i, values[i], values[i - 3] if i >= 3 else 0.1) for i in range(60)]
    df = spark.createDataFrame(data, "i bigint, a double, b double")
    best = relate.best_lags(relate.cross_corr(df, ["a", "b"], order_by=["i"])).first()
    assert best["best_lag"] == 3 and best["best_r"] > 0.99


def test_minute_duplicates_keep_first(spark):
    data = [(T0.replace(second=s), s, float(s)) for s in (40, 5, 16)] + [(T0 + dt.timedelta(minutes=1), 99, 1.0)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, i bigint, v double")
    assert rows(windows.normalize_minutes(df, tie=["i"]), "ts", "i") == [(T0, 5), (T0 + dt.timedelta(minutes=1), 99)]


def test_schedule_flags_and_gaps(spark):
    from tagloom.sources.readers import schedule_runs

    day = dt.date(2024, 1, 1)
    data = [
        (day, "L", 2, "22:00:45", "翌", "06:00:00"), (day, "H", 1, "08:00", "", "16:00"),
        (day, "M", 3, None, "", "16:00"), (None, "M", 3, "08:00", "", "16:00"),
    ]
    df = spark.createDataFrame(data, "date date, product string, equipment int, start_time string, next_day string, end_time string")
    got = rows(schedule_runs(df), "product", "run_start", "run_end")
    assert got == [
        ("H", T0.replace(hour=8), T0.replace(hour=16)), ("L", T0.replace(hour=22), T0.replace(day=2, hour=6)),
    ]


def test_interval_ends_are_inclusive_and_overlaps_duplicate(spark):
    df = minutes(spark, *[1.0] * 10)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    runs = spark.createDataFrame([("a", at(2), at(4)), ("b", at(4), at(5)), ("c", at(60), at(90))], "product string, run_start timestamp_ntz, run_end timestamp_ntz")
    got = rows(joins.interval_join(df, runs), "product", "i")
    assert got == [("a", 2), ("a", 3), ("a", 4), ("b", 4), ("b", 5)]
    assert rows(joins.empty_runs(df, runs), "product") == [("c",)]


def test_asof_exact_match_and_miss(spark):
    left = spark.createDataFrame([(T0, 1), (T0 + dt.timedelta(minutes=7), 2), (T0 - dt.timedelta(minutes=1), 0)], "ts timestamp_ntz, i bigint")
    right = spark.createDataFrame([(T0, 10.0), (T0 + dt.timedelta(minutes=5), 11.0)], "ts timestamp_ntz, p double")
    assert rows(joins.asof(left, right, "ts"), "i", "p") == [(0, None), (1, 10.0), (2, 11.0)]


def test_rolling_periods(spark):
    from tagloom.operators import order

    df = minutes(spark, 1.0, None, 3.0, 5.0)
    build = lambda w: [windows.rolling("v", 2, "mean", w, "full"), windows.rolling("v", 2, "mean", w, "part", 1), windows.rolling("v", 2, "std", w, "std", 1)]
    got = order.over_rows(df, build, order_by=["ts"], before=2).orderBy("i").collect()
    assert [r["full"] for r in got] == [None, None, None, 4.0]
    assert [r["part"] for r in got] == [1.0, 1.0, 3.0, 4.0]
    assert got[0]["std"] is None


def test_missing_values_in_expressions(spark):
    df = minutes(spark, None, 90.0, 80.0, 85.0).withColumn("z", F.lit(0.0))
    got = df.orderBy("i").select(
        scalars.status_label(F.col("v")).alias("s"), *features.ratios([("v", "z")]), features.hinge("v", 84.0).alias("h")
    ).collect()
    assert [r["s"] for r in got] == ["正常", "高", "低", "正常"]
    assert [r["v__div__z"] for r in got] == [None] * 4
    assert [r["h"] for r in got] == [None, 6.0, 0.0, 1.0]


def test_groups_drop_missing_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 3.0)], "k string, v double")
    assert rows(aggregates.grouped(df, ["k"], [F.avg("v").alias("m")])) == [("a", 2.0)]
    assert rows(aggregates.value_counts(df, "k")) == [("a", 2)]


def test_segments_and_positions(spark):
    data = [(T0 + dt.timedelta(minutes=i), i, e, t) for i, (e, t) in enumerate([(1, "H"), (1, "H"), (1, "L"), (2, "L"), (2, "L"), (2, "H")])]
    df = spark.createDataFrame(data, "ts timestamp_ntz, i bigint, e int, type string")
    got = rows(periods.segments(df, "type", order_by=["ts"], partition_by=["e"]), "e", "segment_id", "variety", "n")
    assert got == [(1, 0, "H", 2), (1, 1, "L", 1), (2, 0, "L", 2), (2, 1, "H", 1)]
    got = periods.position_by_equipment(df, equipment="e", order_by=["ts"]).orderBy("i").collect()
    assert [r["position"] for r in got] == [0, 1, 2, 13, 14, 15]


def test_datetime_texts(spark):
    df = spark.createDataFrame(
        [("2025-06-12", "08:00"), ("06/13/2025", "2:30 PM"), ("2025/6/14", "09:15:30"), ("bad", "x")], "d string, t string"
    )
    got = [r[0] for r in df.select(temporal.parse_mixed(F.col("d"), F.col("t"))).collect()]
    assert got == [dt.datetime(2025, 6, 12, 8), dt.datetime(2025, 6, 13, 14, 30), dt.datetime(2025, 6, 14, 9, 15, 30), None]


def test_detected_columns(spark):
    df = spark.createDataFrame(
        [("2024-01-01 00:00:00", "1.5", "x"), ("2024-01-02", "2", None), (None, "3", "y")], "when_ string, num string, txt string"
    )
    assert temporal.detect_timestamp_columns(df) == ["when_"]
    assert scalars.numeric_text_columns(df) == ["num"]
    assert temporal.find_time_column(df.toDF("計測時刻", "a", "b").select("a", "計測時刻")) == "計測時刻"


def test_cards_tolerant_and_strict(spark):
    full = "ACME\n部長　営業部\n山田\n\n03-1\n03-2\na@b.c\n[住所]\n\n〒100\n東京\nhttp://x"
    bare = "\nACME\n\n部長\n山田\n03-1\n\na@b.c\n住所\n〒100\n\n東京"
    df = spark.createDataFrame([(1, full), (2, bare), (3, "only")], "k int, t string")
    got = {r["k"]: r.asDict() for r in parse_cards(df, "t").collect()}
    base = dict(company="ACME", position="部長", name="山田", tel="03-1", mail="a@b.c", zip="〒100", address="東京")
    assert got[1] == {"k": 1, **base, "department": "営業部", "fax": "03-2", "link": "http://x"}
    assert got[2] == {"k": 2, **base, "department": "", "fax": "", "link": ""}
    assert got[3]["company"] == "only" and all(got[3][c] == "" for c in ("name", "tel", "mail", "zip"))
    strict = parse_cards(df.where("k = 1"), "t", strict=True).first().asDict()
    assert strict == got[1]


def test_findings_rules(spark):
    df = spark.createDataFrame([("a: 多数の外れ値",), ("b: 高相関",), ("c: 周期 異常",), ("d",)], "message string")
    assert rows(findings.with_priority(df), "priority") == [("high",), ("high",), ("medium",), ("other",)]
    assert rows(findings.insight_categories(df), "category") == [("周期性・季節性",), ("変化点・異常",), ("相関・関連性",)]
    assert findings.interview_questions(df).count() == 9
    assert findings.interview_questions(df.where("message = 'none'")).count() == 0
    assert findings.next_steps(df.where("message = 'd'")).count() == 9


def test_outer_merge_keeps_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (2, "w"), (3, "q")], "k int, v string")
    assert rows(joins.merge(a, b, ["k"], "outer"), "k", "v_x", "v_y") == [(1, "x", None), (2, "y", "w"), (2, "y", "z"), (3, None, "q")]


def test_quality_score_is_clamped(spark):
    df = minutes(spark, 1.0, None)
    assert quality.quality_score(df, 0, 0).first()["score"] == 95
    assert quality.quality_score(df, 20, 0).first()["score"] == 0
