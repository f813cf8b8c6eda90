"""Profiling, outliers, fills, quality rules and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.scalars import numeric_columns, text_columns, time_columns
from tagloom.operators import order
from tagloom.operators.aggregates import duplicate_rows
from tagloom.operators.quantiles import clip, distinct_counts, iqr_bounds, per_column, quantile_values


def column_profile(df: DataFrame, order_by: Sequence[str], approximate: bool = False) -> DataFrame:
    """Type, missing count and rate, distinct count and first value of every column.

    ``approximate`` counts distinct values with a sketch: one pass without a shuffle of
    the values.
    """
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    numeric, text, time = numeric_columns(df), text_columns(df), time_columns(df)
    kind = (
        F.when(F.col("column").isin(numeric), "numeric")
        .when(F.col("column").isin(text), "categorical")
        .when(F.col("column").isin(time), "datetime")
        .otherwise("other")
    )
    key = F.struct(*order_by)
    prof = per_column(
        df,
        df.columns,
        {
            "n": lambda c: F.count(F.lit(1)),
            "n_null": lambda c: F.count_if(F.col(c).isNull()),
            **({"n_distinct": lambda c: F.approx_count_distinct(F.col(c))} if approximate else {}),
            "sample": lambda c: F.min_by(F.substring(F.col(c).cast("string"), 1, 20), key),
        },
    )
    if not approximate:
        prof = prof.join(F.broadcast(distinct_counts(df, df.columns, order_by)), "column")  # one row per column on both sides
    rate = F.round(F.try_divide(F.col("n_null") * 100, "n"), 2)
    return prof.select(
        "column", types[F.col("column")].alias("dtype"), kind.alias("kind"), "n_null",
        rate.alias("null_pct"), "n_distinct", "sample",
    )


def sample_skew(n: Column, g1: Column) -> Column:
    """Population skewness to the bias-corrected one (needs three values)."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Population excess kurtosis to the bias-corrected one (needs four values)."""
    return F.when(n >= 4, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def shape_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness and kurtosis, variation, zero and negative counts."""
    columns = list(columns or numeric_columns(df))
    num = lambda c: F.col(c).cast("double")
    stats = per_column(
        df, columns,
        {
            "n": lambda c: F.count(c).cast("double"),
            "g1": lambda c: F.skewness(num(c)),
            "g2": lambda c: F.kurtosis(num(c)),
            "cv": lambda c: F.try_divide(F.stddev_samp(num(c)), F.avg(num(c))),
            "n_zero": lambda c: F.count_if(num(c) == 0),
            "n_negative": lambda c: F.count_if(num(c) < 0),
        },
    )
    return stats.select(
        "column",
        sample_skew(F.col("n"), F.col("g1")).alias("skew"),
        sample_kurtosis(F.col("n"), F.col("g2")).alias("kurtosis"),
        "cv", "n_zero", "n_negative",
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with missing values, worst first."""
    prof = per_column(
        df, df.columns,
        {"n": lambda c: F.count(F.lit(1)), "n_null": lambda c: F.count_if(F.col(c).isNull())},
    )
    rate = F.round(F.try_divide(F.col("n_null") * 100, "n"), 2).alias("null_pct")
    return prof.where("n_null > 0").select("column", "n_null", rate).orderBy(F.desc("null_pct"), "column")


def missing_patterns(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Most frequent combinations of missing columns."""
    flags = [F.col(c).isNull().cast("int").alias(c) for c in columns]
    counts = df.select(*flags).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *columns).limit(top)


def missing_corr(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation between missing indicators."""
    from tagloom.operators.relate import corr_matrix

    return corr_matrix(df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns]), columns)


def outliers(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, z_limit: float = 3.0) -> DataFrame:
    """Values beyond the quartile fences and beyond ``z_limit`` population deviations.

    Pass one finds quartiles and moments per column; pass two counts against them.
    """
    columns = list(columns or numeric_columns(df))
    num = lambda c: F.col(c).cast("double")
    moments = per_column(
        df, columns,
        {"mu": lambda c: F.avg(num(c)), "sigma": lambda c: F.stddev_pop(num(c)), "n_rows": lambda c: F.count(F.lit(1))},
    )
    found = {r["column"]: r for r in moments.collect()}
    n_rows = max((r["n_rows"] for r in found.values()), default=0)
    fences = iqr_bounds(df, columns, factor, n_rows)

    def beyond_fence(c: str) -> Column:
        low, high = fences[c] or (None, None)
        return F.count_if((num(c) < F.lit(low)) | (num(c) > F.lit(high)))

    def beyond_z(c: str) -> Column:
        return F.count_if(F.abs(F.try_divide(num(c) - F.lit(found[c]["mu"]), F.lit(found[c]["sigma"]))) > z_limit)

    out = per_column(df, columns, {"n": F.count, "n_iqr": beyond_fence, "n_z": beyond_z})
    return out.select(
        "column", "n", "n_iqr", F.round(F.col("n_iqr") * 100 / F.col("n"), 2).alias("iqr_pct"),
        "n_z", F.round(F.col("n_z") * 100 / F.col("n"), 2).alias("z_pct"),
    )


def clip_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Limit every column to its quartile fences."""
    bounds = iqr_bounds(df, columns, factor)
    return df.withColumns({c: clip(F.col(c), *bounds[c]) for c in columns if bounds[c] is not None})


def clipped_counts(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """How many values :func:`clip_outliers` changes per column."""
    return outliers(df, columns, factor).select("column", F.col("n_iqr").alias("n_clipped"))


def fill_mean(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Fill with the mean of ``train`` (default: of the data itself)."""
    row = (df if train is None else train).agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.na.fill({c: row[c] for c in columns if row[c] is not None}, list(columns))


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def fill_by_rule(
    df: DataFrame, columns: Sequence[str], *, order_by: Sequence[str], partition_by: Sequence[str] = (), limit: float = 0.05
) -> DataFrame:
    """Columns with fewer than ``limit`` missing are filled forward, the others with their mean."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    carried = [c for c in columns if rates[c] is not None and 0 < rates[c] < limit]
    averaged = [c for c in columns if rates[c] is not None and rates[c] >= limit]
    out = order.fill(df, carried, order_by=order_by, partition_by=partition_by) if carried else df
    return fill_mean(out, averaged) if averaged else out


def quality_checks(df: DataFrame, ts: str | None = None, file_order: Sequence[str] = (), temperature_part: str = "temp") -> DataFrame:
    """Findings ``(source, kind, column, metric, value)`` of the rule-based checks."""
    numeric = numeric_columns(df)
    medians = quantile_values(df, numeric, [0.5]) if numeric else {}
    found = []
    # without a shuffle: no value, or the smallest is the largest
    one = lambda c: F.when(F.count(c) == 0, 0.0).when(F.min(c) == F.max(c), 1.0)
    prof = per_column(df, df.columns, {"value": one}).where("value <= 1")
    found.append(prof.select(F.lit("constant_column").alias("kind"), "column", F.lit("n_distinct").alias("metric"), "value"))
    dup = duplicate_rows(df).where("n_duplicates > 0")
    found.append(
        dup.select(
            F.lit("duplicate_rows").alias("kind"), F.lit(None).cast("string").alias("column"),
            F.lit("count").alias("metric"), F.col("n_duplicates").cast("double").alias("value"),
        )
    )
    if numeric:
        extremes = per_column(
            df, numeric,
            {"hi": lambda c: F.max(F.col(c)).cast("double"), "lo": lambda c: F.min(F.col(c)).cast("double")},
        )
        middle = F.create_map(*[F.lit(x) for c in numeric for x in (c, float(medians[c][0] or 0.0))])
        extremes = extremes.withColumn("median", middle[F.col("column")])
        huge = extremes.where("hi > median * 1000")
        found.append(huge.select(F.lit("extreme_value").alias("kind"), "column", F.lit("max").alias("metric"), F.col("hi").alias("value")))
        cold = extremes.where((F.col("lo") < 0) & F.lower("column").contains(temperature_part))
        found.append(cold.select(F.lit("negative_temperature").alias("kind"), "column", F.lit("min").alias("metric"), F.col("lo").alias("value")))
    if ts is not None:
        from tagloom.operators.windows import time_gaps

        gaps = time_gaps(df.select(*dict.fromkeys([ts, *file_order])), ts, order_by=list(file_order))
        still = gaps.agg(F.min("gap_s").cast("double").alias("value")).where("value <= 0")
        found.append(still.select(F.lit("time_reversal").alias("kind"), F.lit(ts).alias("column"), F.lit("min_gap_s").alias("metric"), "value"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.lit("quality").alias("source"), "*")


def quality_score(df: DataFrame, n_quality: int | Column, n_outlier: int | Column) -> DataFrame:
    """0-100: penalties for missing cells, duplicate rows, quality and outlier findings."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    cells = df.agg(
        F.count(F.lit(1)).alias("n"),
        sum([F.count_if(F.col(c).isNull()) for c in df.columns[1:]], F.count_if(F.col(df.columns[0]).isNull())).alias("nulls"),
    )
    missing = F.col("nulls") / (F.col("n") * len(df.columns))
    both = cells.withColumn("duplicate_ratio", duplicate_rows(df).select("duplicate_ratio").scalar())
    score = 100 - missing * 30 - F.col("duplicate_ratio") * 20 - lit(n_quality) * 10 - lit(n_outlier) * 5
    return both.select(
        missing.alias("missing_ratio"), "duplicate_ratio",
        F.greatest(F.lit(0), F.least(F.lit(100), score.cast("bigint"))).cast("bigint").alias("score"),
    )


# Confidence texts by row count, numeric columns and findings.
CONFIDENCE = {
    "few_rows": "低（データ数不足）",
    "both_limited": "中（データ・特徴量ともに限定的）",
    "enough_features": "中（十分な特徴量）",
    "few_features": "中（特徴量不足）",
    "few_findings": "中（発見事項少）",
    "high": "高（十分なデータと発見事項）",
}


def confidence(rows: Column, numeric: Column, findings: Column) -> Column:
    medium = F.when(numeric < 5, CONFIDENCE["both_limited"]).otherwise(CONFIDENCE["enough_features"])
    large = (
        F.when(numeric < 3, CONFIDENCE["few_features"])
        .when(findings < 5, CONFIDENCE["few_findings"])
        .otherwise(CONFIDENCE["high"])
    )
    return F.when(rows < 100, CONFIDENCE["few_rows"]).when(rows < 1000, medium).otherwise(large)


def jarque_bera(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Normality test from distributed moments: statistic, p value and flag (p < 0.05)."""
    columns = list(columns or numeric_columns(df))
    num = lambda c: F.col(c).cast("double")
    m = per_column(
        df, columns, {"n": F.count, "s": lambda c: F.skewness(num(c)), "k": lambda c: F.kurtosis(num(c))}
    )
    jb = F.col("n") / 6 * (F.pow("s", F.lit(2)) + F.pow("k", F.lit(2)) / 4)
    return m.where("n > 3").select("column", jb.alias("jb"), F.exp(-jb / 2).alias("p_value"), (F.exp(-jb / 2) < 0.05).alias("non_normal"))
