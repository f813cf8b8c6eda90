"""Moisture model: preprocess, features, selection, cross-validated forest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.scalars import numeric_columns
from tagloom.operators import models
from tagloom.operators.features import create_features
from tagloom.operators.quality import clip_outliers
from tagloom.operators.relate import corr_matrix
from tagloom.operators.windows import interpolate


@dataclass
class MoistureModel:
    models: list[PipelineModel]
    features: list[str]
    metrics: DataFrame
    predictions: DataFrame
    data: DataFrame


def preprocess(df: DataFrame, columns: Sequence[str], *, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation, then clipping to the quartile fences."""
    return clip_outliers(interpolate(df, columns, order_by=order_by, partition_by=partition_by), columns)


def train_moisture_model(
    df: DataFrame, target: str, *, ts: str = "ts", order_by: Sequence[str], partition_by: Sequence[str] = (),
    columns: Sequence[str] | None = None, top: int = 30, num_trees: int = 100, max_depth: int = 10, folds: int = 5,
) -> MoistureModel:
    columns = list(columns or numeric_columns(df, exclude=[*order_by, *partition_by]))
    clean = preprocess(df, columns, order_by=order_by, partition_by=partition_by)
    predictors = [c for c in columns if c != target]
    data = create_features(clean, predictors, ts=ts, order_by=order_by, partition_by=partition_by).persist()
    candidates = numeric_columns(data, exclude=[target, *order_by, *partition_by])
    chosen = models.select_by_forest(data, candidates, target, top, num_trees)
    features = [r["feature"] for r in chosen.collect()]
    metrics, predictions, fitted = models.cross_validate(
        data, features, target, models.forest(target, num_trees, max_depth), order_by=order_by, folds=folds
    )
    return MoistureModel(fitted, features, metrics, predictions, data)


def closing_summary(df: DataFrame, columns: Sequence[str], ts: str, metrics: DataFrame, importances: DataFrame) -> DataFrame:
    """One row: period, size, missing rate, strongest pair, top feature, error, and the two advices."""
    nulls = sum([F.count_if(F.col(c).isNull()) for c in columns], F.lit(0))
    base = df.agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(columns)).alias("n_features"), (nulls * 100 / (F.count(F.lit(1)) * len(columns))).alias("missing_pct"),
    )
    pair = corr_matrix(df, columns).where("r IS NOT NULL").agg(F.max_by(F.struct("var1", "var2", "r"), F.abs("r")))
    top = importances.agg(F.max_by("feature", "importance"))
    quality = metrics.where("fold = 'all'").agg(F.first(F.struct("mae", "r2")))
    out = base.withColumns({"strongest_pair": pair.scalar(), "top_feature": top.scalar(), "quality": quality.scalar()})
    actions = F.array_compact(
        F.array(
            F.when(F.col("missing_pct") > 5, "improve_data_quality"),
            F.when(F.col("quality.r2") < 0.8, "improve_model"),
        )
    )
    return out.select("*", actions.alias("actions"))
