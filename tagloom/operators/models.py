"""Feature selection, time-ordered cross-validation and tree models on MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from random import Random

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators import order
from tagloom.operators.forests import CellForest
from tagloom.operators.linear import evaluate
from tagloom.operators.quantiles import quantile_values
from tagloom.operators.relate import corr_with_target
from tagloom.operators.scaling import fit_scaler
from tagloom.session import ROWS_PER_CHUNK, materialize, setting


def select_by_corr(df: DataFrame, features: Sequence[str], label: str, top: int = 50) -> DataFrame:
    return corr_with_target(df, label, features, top)


def select_by_mutual_info(df: DataFrame, features: Sequence[str], label: str, top: int = 50, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of quantile-binned feature and label, highest first."""
    columns = list(dict.fromkeys([*features, label]))
    cuts = quantile_values(df, columns, [i / bins for i in range(1, bins)])

    def bin_of(c: str):
        edges = sorted({e for e in cuts[c] if e is not None})
        out = F.lit(0)
        for e in edges:
            out = out + F.when(F.col(c) > F.lit(e), 1).otherwise(0)
        return out.cast("int")

    feats = [c for c in features if c != label]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("a")) for c in feats])
    cells = df.dropna(subset=columns).select(bin_of(label).alias("b"), F.inline(pairs))
    joint = cells.groupBy("feature", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # windows over at most bins^2 cells per feature
    total = F.sum("n").over(Window.partitionBy("feature"))
    na = F.sum("n").over(Window.partitionBy("feature", "a"))
    nb = F.sum("n").over(Window.partitionBy("feature", "b"))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))
    scored = joint.select("feature", "n", total.alias("t"), na.alias("na"), nb.alias("nb"))
    return scored.groupBy("feature").agg(F.sum(term).alias("score")).orderBy(F.desc("score"), "feature").limit(top)


def importance_table(spark, features: Sequence[str], importances, top: int | None = None) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, importances)]
    table = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return table.limit(top) if top else table


def select_by_forest(df: DataFrame, features: Sequence[str], label: str, top: int = 50, num_trees: int = 100, max_depth: int = 5) -> DataFrame:
    forest = RandomForestRegressor(featuresCol="x", labelCol=label, numTrees=num_trees, maxDepth=max_depth, seed=42)
    data = VectorAssembler(inputCols=list(features), outputCol="x").transform(df.dropna(subset=[*features, label]))
    return importance_table(df.sparkSession, features, forest.fit(data).featureImportances.toArray(), top)


def select_features(df: DataFrame, features: Sequence[str], label: str, method: str = "correlation", top: int = 50) -> list[str]:
    table = {
        "correlation": lambda: select_by_corr(df, features, label, top).select("column"),
        "mutual_info": lambda: select_by_mutual_info(df, features, label, top).select("feature"),
        "rf_importance": lambda: select_by_forest(df, features, label, top).select("feature"),
    }[method]()
    return [r[0] for r in table.collect()]


def split_bounds(n: int, k: int = 5) -> list[tuple[int, int]]:
    """Expanding split: ``(test_start, test_end)`` per fold, training rows are all before."""
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]


def split_sizes(df: DataFrame, *, order_by: Sequence[str], k: int = 5, rows_per_chunk: int | None = None) -> DataFrame:
    """Rows in the training and test part of every fold, counted on the indexed data."""
    n = df.count()
    bounds = split_bounds(n, k)
    indexed = order.row_index(df.select(*order_by), "i", order_by=order_by, n_rows=n, rows_per_chunk=rows_per_chunk)
    folds = F.array(*[F.struct(F.lit(f + 1).cast("bigint").alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, (a, b) in enumerate(bounds)])
    cells = indexed.select("i", F.inline(folds))
    i = F.col("i")
    return cells.groupBy("fold").agg(
        F.count_if(i < F.col("a")).alias("n_train"), F.count_if((i >= F.col("a")) & (i < F.col("b"))).alias("n_test")
    )


def _indexed(df: DataFrame, features, label, order_by, rows_per_chunk):
    columns = list(dict.fromkeys([*order_by, *features, label]))
    data = df.select(*columns).dropna(subset=[*features, label])
    n = data.count()
    return order.row_index(data, "__i", order_by=order_by, n_rows=n, rows_per_chunk=rows_per_chunk), n


def _written(data: DataFrame, n: int, rows_per_chunk: int | None) -> DataFrame:
    """The indexed rows written once.  More than one chunk of them are spread evenly over all tasks, and so is every fold's part:
    in index order the early rows, which all folds train on, would be the work of one or two tasks."""
    size = rows_per_chunk or setting(data.sparkSession, ROWS_PER_CHUNK)
    if n > size:
        parts = max(4 * data.sparkSession.sparkContext.defaultParallelism, -(-4 * n // size))
        data = data.repartition(min(parts, order.MAX_CHUNKS), "__i").sortWithinPartitions("__i")  # sorted: bagging goes by place
    return materialize(data)


#: Fits at a time, and the share of training rows kept for early stopping.
AT_ONCE, TAIL = 4, 0.1


def at_once(work, items: Sequence) -> list:
    """``work`` of each item, a few at a time: one fit alone leaves most of a cluster idle between its passes."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(work), items))


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    make_model,
    *,
    order_by: Sequence[str],
    folds: int = 5,
    fit_on: str = "train",
    early_stop: bool = False,
    rows_per_chunk: int | None = None,
) -> tuple[DataFrame, DataFrame, list[PipelineModel]]:
    """Fit ``make_model()`` per expanding fold: (metrics per fold and pooled, predictions, models).

    ``fit_on`` says whether the scaler sees the training rows or all rows.  With ``early_stop`` the last TAIL of a fold's
    training rows are the learner's validation set; test rows are seen by neither.  Folds are fitted a few at a time.
    """
    data, n = _indexed(df, features, label, order_by, rows_per_chunk)
    data = _written(data, n, rows_per_chunk)
    everything = fit_scaler(data, features) if fit_on == "all" else None
    assembler = VectorAssembler(inputCols=list(features), outputCol="x")

    def fit(bounds: tuple[int, int]):
        start, end = bounds
        train, test = data.where(F.col("__i") < start), data.where(F.col("__i").between(start, end - 1))
        scaler = everything or fit_scaler(train, features)
        rows = scaler.transform(train)
        if early_stop:
            rows = rows.withColumn("__valid", F.col("__i") >= start - max(1, int(start * TAIL)))
        model = Pipeline(stages=[assembler, make_model()]).fit(rows)
        return model, model.transform(scaler.transform(test))

    predictions, models = None, []
    fitted = at_once(fit, split_bounds(n, folds)[::-1])  # the longest first: none is left to run alone
    for fold, (model, scored) in enumerate(fitted[::-1], 1):
        scored = scored.select(F.lit(str(fold)).alias("fold"), *order_by, F.col(label).alias("actual"), F.col("prediction").alias("predicted"))
        predictions = scored if predictions is None else predictions.unionByName(scored)
        models.append(model)
    per_fold = evaluate(predictions, "actual", "predicted", ["fold"])
    pooled = evaluate(predictions, "actual", "predicted").select(F.lit("all").alias("fold"), "*")
    return per_fold.unionByName(pooled).select("fold", "n", "r2", "rmse", "mae"), predictions, models


def forest(label: str, num_trees: int = 100, max_depth: int = 10):
    return lambda: CellForest(featuresCol="x", labelCol=label, numTrees=num_trees, maxDepth=max_depth, seed=42)


def boosted(label: str, max_iter: int = 1000, max_depth: int = 6, step: float = 0.1, subsample: float = 0.8, columns: float = 0.8):
    """Boosted trees that stop when the validation rows no longer improve."""
    return lambda: GBTRegressor(
        featuresCol="x", labelCol=label, maxIter=max_iter, maxDepth=max_depth, stepSize=step, subsamplingRate=subsample,
        featureSubsetStrategy=str(columns), seed=42, validationIndicatorCol="__valid",
    )


# The searched ranges.
SEARCH_SPACE = {
    "max_depth": (3, 10),
    "step": (0.01, 0.3),
    "max_iter": (100, 1000),
    "subsample": (0.6, 1.0),
    "columns": (0.6, 1.0),
}


def draw_params(trials: int, seed: int = 42, space: Mapping[str, tuple] = SEARCH_SPACE) -> list[dict]:
    """Seeded uniform draws; integer ranges give integers."""
    rng = Random(seed)
    draw = lambda lo, hi: rng.randint(lo, hi) if isinstance(lo, int) else rng.uniform(lo, hi)
    return [{k: draw(*bounds) for k, bounds in space.items()} for _ in range(trials)]


def search_params(
    df: DataFrame, features: Sequence[str], label: str, *, order_by: Sequence[str], trials: int = 100, folds: int = 3,
    space: Mapping[str, tuple] = SEARCH_SPACE, seed: int = 42, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Trial log ``trial, <params>, rmse`` (mean over expanding folds), best first."""
    data, n = _indexed(df, features, label, order_by, rows_per_chunk)
    assembled = _written(VectorAssembler(inputCols=list(features), outputCol="x").transform(data).select("__i", "x", label), n, rows_per_chunk)
    drawn, bounds = draw_params(trials, seed, space), split_bounds(n, folds)

    def error(job: tuple[dict, tuple[int, int]]) -> float:
        p, (start, end) = job
        learner = boosted(label, p["max_iter"], p["max_depth"], p["step"], p["subsample"], p["columns"])()
        learner = learner.clear(learner.validationIndicatorCol) or learner
        model = learner.fit(assembled.where(F.col("__i") < start))
        test = model.transform(assembled.where(F.col("__i").between(start, end - 1)))
        return evaluate(test, label, "prediction").first()["rmse"]

    errors = at_once(error, [(p, b) for p in drawn for b in bounds])
    rows = []
    for trial, p in enumerate(drawn):
        mean = sum(errors[trial * folds : (trial + 1) * folds]) / folds
        rows.append((trial + 1, int(p["max_depth"]), float(p["step"]), int(p["max_iter"]), float(p["subsample"]), float(p["columns"]), mean))
    schema = "trial int, max_depth int, step double, max_iter int, subsample double, columns double, rmse double"
    return df.sparkSession.createDataFrame(rows, schema).orderBy("rmse", "trial")


def score(df: DataFrame, model: PipelineModel, scaler=None, name: str = "prediction") -> DataFrame:
    """Batch scoring with the fitted scaler and model."""
    scaled = scaler.transform(df) if scaler is not None else df
    return model.transform(scaled).drop("x").withColumnRenamed("prediction", name)


def ensemble(df: DataFrame, models: Sequence[PipelineModel], weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean of the models' predictions."""
    weights = list(weights) if weights is not None else [1 / len(models)] * len(models)
    out = df
    for i, m in enumerate(models):
        out = m.transform(out).withColumnRenamed("prediction", f"__p{i}").drop("x")
    total = F.lit(float(sum(weights)))
    mean = sum([F.col(f"__p{i}") * F.lit(float(w)) for i, w in enumerate(weights)], F.lit(0.0)) / total
    return out.select(*df.columns, mean.alias("prediction"))
