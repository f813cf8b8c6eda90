"""Exploration report: every analysis as a table, all findings as rows, one summary row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.scalars import numeric_columns, text_columns
from tagloom.operators import aggregates, anomaly, findings, models, order, quality, relate, series, spectrum, windows
from tagloom.operators.findings import finding
from tagloom.session import materialize


def _msg(fmt: str, *columns):
    return F.format_string(fmt, *columns)


def shape_findings(shape: DataFrame) -> DataFrame:
    skewed = shape.where(F.abs("skew") > 2)
    varied = shape.where("cv > 1")
    return finding(
        skewed, "statistics", "skew", F.col("column"), "skew", "skew", _msg("%s: 強い歪み (歪度=%.3f)", "column", "skew")
    ).unionByName(
        finding(varied, "statistics", "variation", F.col("column"), "cv", "cv", _msg("%s: 高い変動性 (変動係数=%.3f)", "column", "cv"))
    )


def missing_findings(summary: DataFrame) -> DataFrame:
    return finding(
        summary.where("null_pct > 0"), "missing", "missing", F.col("column"), "null_pct", "null_pct",
        _msg("%s: 欠損 (%.2f%%)", "column", "null_pct"),
    )


def sampling_findings(stats: DataFrame, ts: str) -> DataFrame:
    dup = finding(
        stats.where("dup_timestamps > 0"), "time", "duplicate_timestamps", ts, "count", "dup_timestamps",
        _msg(f"{ts}: 重複タイムスタンプが%d件存在", "dup_timestamps"),
    )
    irregular = finding(
        stats.where("irregular"), "time", "irregular", ts, "std/mean", F.col("std_gap_s") / F.col("mean_gap_s"),
        F.lit(f"{ts}: 不規則な時間間隔"),
    )
    return dup.unionByName(irregular)


def outlier_findings(table: DataFrame) -> DataFrame:
    share = F.col("n_iqr") / F.col("n")
    return finding(
        table.where(share > 0.05), "outliers", "outliers", F.col("column"), "share", share,
        _msg("%s: 多数の外れ値 (IQR法で%d件, %.1f%%)", "column", "n_iqr", share * 100),
    )


def correlation_findings(pairs: DataFrame) -> DataFrame:
    return finding(
        pairs, "correlation", "high_correlation", F.concat_ws(" - ", "var1", "var2"), "r", "r",
        _msg("高相関: %s - %s (r=%.3f)", "var1", "var2", "r"),
    )


def normality_findings(table: DataFrame) -> DataFrame:
    return finding(
        table.where("non_normal"), "distribution", "non_normal", F.col("column"), "p_value", "p_value",
        _msg("%s: 非正規分布 (Jarque-Bera p=%.3e)", "column", "p_value"),
    )


def category_findings(table: DataFrame) -> DataFrame:
    skewed = table.where("n_distinct > 1 AND mode_share > 0.9")
    return finding(
        skewed, "categories", "concentrated", F.col("column"), "mode_share", "mode_share",
        _msg("%s: 高度に偏った分布 (最頻値が%.1f%%)", "column", F.col("mode_share") * 100),
    )


def quality_findings(checks: DataFrame) -> DataFrame:
    text = (
        F.when(F.col("kind") == "duplicate_rows", _msg("品質問題: 重複行: %.0f件", "value"))
        .when(F.col("kind") == "constant_column", _msg("品質問題: 定数列: %s", "column"))
        .when(F.col("kind") == "extreme_value", _msg("品質問題: %s: 極端に大きな値 (最大値=%.2e)", "column", "value"))
        .when(F.col("kind") == "negative_temperature", _msg("品質問題: %s: 負の温度値", "column"))
        .otherwise(_msg("品質問題: %s: 時系列の逆転または停止", "column"))
    )
    return checks.select("source", "kind", "column", "metric", "value", text.alias("message"))


def pattern_findings(df: DataFrame, ts: str) -> DataFrame:
    hours = aggregates.keep_extreme_hours(df, ts)
    share = series.weekend_share(df, ts)
    out = finding(hours, "pattern", "peak_hour", ts, "hour", "peak_hour", _msg("ピーク稼働時間: %d時", "peak_hour"))
    out = out.unionByName(finding(hours, "pattern", "min_hour", ts, "hour", "min_hour", _msg("最低稼働時間: %d時", "min_hour")))
    quiet = share.where("weekend_share < 0.1")
    return out.unionByName(
        finding(quiet, "pattern", "weekend", ts, "share", "weekend_share", F.lit("週末の稼働は限定的（平日中心の運転）"))
    )


def period_findings(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> list[DataFrame]:
    out = []
    table = materialize(relate.autocorr_many(df, columns, order_by=order_by))
    for c in columns:
        lags = table.where((F.col("column") == c) & (F.abs("r") > 0.3))
        first = lags.agg(F.slice(F.array_sort(F.collect_list("lag")), 1, 3).alias("l")).where(F.size("l") > 0)
        text = F.concat(F.lit(f"{c}: 主要周期候補 = ["), F.array_join(F.col("l").cast("array<string>"), ", "), F.lit("]ポイント"))
        out.append(finding(first, "periodicity", "autocorrelation", c, "lag", F.col("l")[0], text))
        n = df.where(F.col(c).isNotNull()).count()
        if n >= 100:
            best = spectrum.main_periods(spectrum.periodogram(df, c, order_by=order_by), n)
            text = _msg(f"{c}: FFT主要周期 = %.1f", "period")
            out.append(finding(best.orderBy(F.desc("power")).limit(2), "periodicity", "fft", c, "period", "period", text))
    return out


def season_findings(df: DataFrame, columns: Sequence[str], ts: str, order_by: Sequence[str]) -> list[DataFrame]:
    out = []
    for c in columns:
        s = series.decomposition_strength(series.decompose(df, c, order_by=order_by, ts=ts))
        out.append(
            finding(s.where("clear_season"), "decomposition", "season", c, "share", "seasonal_share",
                    _msg(f"{c}: 明確な季節性 (寄与率%.1f%%)", F.col("seasonal_share") * 100))
        )
        out.append(
            finding(s.where("strong_trend"), "decomposition", "trend", c, "share", "trend_share",
                    _msg(f"{c}: 強いトレンド (寄与率%.1f%%)", F.col("trend_share") * 100))
        )
    return out


def change_findings(points: DataFrame) -> DataFrame:
    counts = points.groupBy("column", "kind").agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("kind") == "mean", "平均値変化点").otherwise("分散変化点")
    return finding(
        counts, "change_points", "change_points", F.col("column"), "count", "n",
        _msg("%s: %d個の%sを検出", F.col("column"), F.col("n"), label),
    )


def lag_findings(best: DataFrame) -> DataFrame:
    strong = best.where(F.abs("best_r") > 0.5)
    text = F.when(F.col("best_lag") == 0, _msg("%s-%s: 同時相関 r=%.3f", "var1", "var2", "best_r")).otherwise(
        _msg("%s-%s: ラグ%dで最大相関 r=%.3f", "var1", "var2", "best_lag", "best_r")
    )
    return finding(strong, "cross_correlation", "lag", F.concat_ws("-", "var1", "var2"), "r", "best_r", text)


def state_findings(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> list[DataFrame]:
    scored = anomaly.anomaly_scores(df, columns, key, contamination=0.05, prepare="scaled")
    summary = anomaly.anomaly_summary(scored).where("anomaly_pct > 2")
    stable = anomaly.process_stability(anomaly.process_state(df, columns, key)).where("unstable")
    return [
        finding(summary, "state", "anomalies", None, "percent", "anomaly_pct",
                _msg("多数の異常運転状態を検出 (%d件, %.1f%%)", "n_anomalies", "anomaly_pct")),
        finding(stable, "state", "unstable", "pc1", "std", "pc1_std", F.lit("プロセスの主要成分に高い変動性")),
    ]


def basic_findings(
    df: DataFrame, ts: str, order_by: Sequence[str], columns: Sequence[str], file_order: Sequence[str] = ()
) -> DataFrame:
    """Findings of the eleven basic analyses that record any.

    ``file_order`` is the order rows arrived in, if a column holds it: time that runs
    backwards can only be seen along it.
    """
    data = _read_once(df.select(*dict.fromkeys([ts, *order_by, *file_order, *columns, *text_columns(df)])))
    return _together(
        lambda: [shape_findings(quality.shape_stats(data, columns))],
        lambda: [missing_findings(quality.missing_summary(data))],
        lambda: [sampling_findings(windows.sampling_stats(data, ts, order_by=order_by), ts)],
        lambda: [outlier_findings(quality.outliers(data, columns))],
        lambda: [correlation_findings(relate.high_corr_pairs(data, columns))],
        lambda: [normality_findings(quality.jarque_bera(data, columns))],
        lambda: [category_findings(aggregates.categorical_summary(data, text_columns(data)))] if text_columns(data) else [],
        lambda: [quality_findings(quality.quality_checks(data, ts, file_order or order_by))],
        lambda: [cluster_finding(data, columns)],
        lambda: [anomaly_finding(data, columns, [c for c in order_by if c != ts] or [ts])],
    )


def _read_once(df: DataFrame) -> DataFrame:
    """The columns of a report, written if they are more than one chunk: its analyses read them dozens of times."""
    return order.settle(df, df.count())


def _together(*analyses: Callable[[], list[DataFrame]]) -> DataFrame:
    """Findings of all analyses in the order given.  Their passes over the data are made a few at a time."""
    return aggregates.union_rows(*[f for frames in models.at_once(lambda analysis: analysis(), analyses) for f in frames])


def cluster_finding(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of clusters that a fit finds rows for, if there are two or more."""
    sizes = anomaly.cluster_sizes(anomaly.kmeans_clusters(df, columns))
    found = sizes.agg(F.count(F.lit(1)).cast("int").alias("k")).where("k >= 2")
    return finding(found, "clusters", "clusters", None, "k", "k", _msg("データは%d個のクラスタに分類可能", "k"))


def anomaly_finding(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    summary = anomaly.anomaly_summary(anomaly.anomaly_scores(df, columns, key)).where("anomaly_pct > 5")
    return finding(
        summary, "anomalies", "anomalies", None, "percent", "anomaly_pct",
        _msg("多数の異常データが検出 (%d件, %.1f%%)", "n_anomalies", "anomaly_pct"),
    )


def advanced_findings(df: DataFrame, ts: str, order_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Insights of the six advanced analyses on all numeric columns."""
    key, several = [c for c in order_by if c != ts] or [ts], len(columns) > 1
    df = _read_once(df)
    return _together(
        lambda: [pattern_findings(df, ts)],
        lambda: period_findings(df, columns, order_by),
        *[lambda c=c: season_findings(df, [c], ts, order_by) for c in columns],
        lambda: [change_findings(series.change_points(df, columns, order_by=order_by))],
        lambda: [lag_findings(relate.best_lags(relate.cross_corr(df, columns, order_by=order_by)))] if several else [],
        lambda: state_findings(df, columns, key) if several else [],
    )


def integrated_report(df: DataFrame, basic: DataFrame, advanced: DataFrame) -> DataFrame:
    """One row: sizes, finding counts by priority, quality score and confidence text.

    ``basic`` and ``advanced`` are finding tables; a few hundred rows at most.
    """
    own = basic.select("message", F.lit(True).alias("own")).unionByName(advanced.select("message", F.lit(False).alias("own")))
    tagged = findings.with_priority(own)
    mine = lambda word: F.count_if(F.col("own") & F.col("message").contains(word))
    counts = tagged.agg(
        F.count(F.lit(1)).alias("n_findings"),
        *[F.count_if(F.col("priority") == p).alias(f"n_{p}") for p in ("high", "medium", "low", "other")],
        mine("品質問題").alias("quality"),
        mine("外れ値").alias("outlier"),
    ).first()
    n_numeric = len(numeric_columns(df))
    scored = quality.quality_score(df, counts["quality"], counts["outlier"]).withColumn("n_rows", df.agg(F.count(F.lit(1))).scalar())
    return scored.select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(n_numeric).cast("bigint").alias("n_numeric"),
        *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("n_findings", "n_high", "n_medium", "n_low", "n_other")],
        "score",
        quality.confidence(F.col("n_rows"), F.lit(n_numeric), F.lit(counts["n_findings"])).alias("confidence"),
    )


def explore(df: DataFrame, *, ts: str = "ts", order_by: Sequence[str], columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All report tables by name."""
    columns = list(columns or numeric_columns(df, exclude=order_by))
    # written once: six of the tables below read them
    basic = materialize(basic_findings(df, ts, order_by, columns))
    advanced = materialize(advanced_findings(df, ts, order_by, columns))
    everything = basic.unionByName(advanced)
    return {
        "profile": quality.column_profile(df, order_by),
        "describe": aggregates.describe(df, columns),
        "shape": quality.shape_stats(df, columns),
        "missing": quality.missing_summary(df),
        "sampling": windows.sampling_stats(df, ts, order_by=order_by),
        "outliers": quality.outliers(df, columns),
        "correlation": relate.corr_matrix(df, columns),
        "findings": findings.with_priority(everything),
        "categories": findings.insight_categories(advanced),
        "questions": findings.interview_questions(basic),
        "next_steps": findings.next_steps(everything),
        "summary": integrated_report(df, basic, advanced),
    }
