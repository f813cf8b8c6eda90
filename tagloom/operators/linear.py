"""Linear models from one pass of sufficient statistics.

n, sums, cross products and squares decide every ridge solution, gradient-descent
trajectory and loss surface, so the data is read once and all iterations run on
matrices whose size depends on the number of features only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import order
from tagloom.operators.scaling import Scaler, fit_scaler

_NATIVE_FEATURES = 12


@dataclass
class Moments:
    """Gram matrix of ``(1, x1..xd, y)``."""

    gram: np.ndarray

    @property
    def n(self) -> float:
        return self.gram[0, 0]

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.gram + other.gram)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.gram - other.gram)

    def squared_error(self, w: np.ndarray, b: float) -> float:
        """Sum of squared residuals of ``y - w.x - b``."""
        v = np.concatenate([[-b], -w, [1.0]])
        return float(v @ self.gram @ v)

    def total_error(self) -> float:
        return float(self.gram[-1, -1] - self.gram[0, -1] ** 2 / self.n)

    def r2(self, w: np.ndarray, b: float) -> float:
        return 1 - self.squared_error(w, b) / self.total_error()

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        """Minimiser of squared error plus ``alpha * |w|^2``; the intercept is free."""
        mean = self.gram[0] / self.n
        centred = self.gram - self.n * np.outer(mean, mean)
        xx, xy = centred[1:-1, 1:-1], centred[1:-1, -1]
        w = np.linalg.solve(xx + alpha * np.eye(len(xy)), xy)
        return w, float(mean[-1] - w @ mean[1:-1])


def moments(df: DataFrame, features: Sequence[str], label: str, by: str | None = None) -> dict[object, Moments]:
    """Moments per value of ``by`` (e.g. folds), complete rows only.

    Few features use native sums.  Many use one numpy product per Arrow batch, summed
    per partition before the shuffle.
    """
    names = [*features, label]
    d = len(names) + 1
    key = F.col(by) if by else F.lit(0)
    data = df.select(key.alias("k"), *[F.col(c).cast("double").alias(f"v{i + 1}") for i, c in enumerate(names)])
    data = data.dropna(subset=data.columns[1:])
    if len(features) <= _NATIVE_FEATURES:
        value = lambda i: F.lit(1.0) if i == 0 else F.col(f"v{i}")
        cells = [(i, j) for i in range(d) for j in range(i, d)]
        rows = data.groupBy("k").agg(F.array(*[F.sum(value(i) * value(j)) for i, j in cells]).alias("g")).collect()
        out = {}
        for r in rows:
            g = np.zeros((d, d))
            for (i, j), s in zip(cells, r["g"]):
                g[i, j] = g[j, i] = s
            out[r["k"]] = Moments(g)
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        for pdf in batches:
            for k, part in pdf.groupby("k"):
                m = np.column_stack([np.ones(len(part)), part.iloc[:, 1:].to_numpy()])
                sums[k] = sums.get(k, 0) + m.T @ m
        if sums:
            yield pd.DataFrame({"k": list(sums), "g": [g.ravel() for g in sums.values()]})

    kind = data.schema["k"].dataType.simpleString()
    flat = data.mapInPandas(partial, f"k {kind}, g array<double>").select("k", F.posexplode("g").alias("p", "s"))
    rows = flat.groupBy("k", "p").agg(F.sum("s").alias("s")).collect()
    out = {k: Moments(np.zeros((d, d))) for k in {r["k"] for r in rows}}
    for r in rows:
        out[r["k"]].gram[divmod(r["p"], d)] = r["s"]
    return out


def contiguous_fold(idx, n: int, k: int):
    """Fold number of a dense index: ``k`` contiguous folds, the first ``n % k`` one longer."""
    q, r = divmod(n, k)
    head = r * (q + 1)
    late = F.lit(r) + F.floor((idx - head) / max(q, 1))
    return F.when(idx < head, F.floor(idx / (q + 1))).otherwise(late).cast("int")


@dataclass
class RidgeFit:
    features: list[str]
    scaler: Scaler
    alpha: float
    coef: np.ndarray
    intercept: float
    scores: dict[float, float]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        terms = [self.scaler.column(c) * F.lit(float(w)) for c, w in zip(self.features, self.coef)]
        return df.withColumn(name, sum(terms, F.lit(self.intercept)))

    def top_coefficients(self, spark, k: int = 10) -> DataFrame:
        rows = [(c, float(w)) for c, w in zip(self.features, self.coef)]
        table = spark.createDataFrame(rows, "feature string, coef double")
        return table.orderBy(F.desc(F.abs("coef")), "feature").limit(k)


def fit_ridge(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    order_by: Sequence[str],
    alphas: Iterable[float] | None = None,
    folds: int = 5,
    rows_per_chunk: int | None = None,
) -> RidgeFit:
    """Ridge on standardised features; alpha by mean R2 over contiguous folds."""
    alphas = list(np.logspace(-3, 3, 25)) if alphas is None else list(alphas)
    data = df.select(*order_by, *[c for c in [*features, label] if c not in order_by]).dropna()
    scaler = fit_scaler(data, features)
    n = data.count()
    scaled = order.row_index(scaler.transform(data), "__i", order_by=order_by, n_rows=n, rows_per_chunk=rows_per_chunk)
    parts = moments(scaled.withColumn("__fold", contiguous_fold(F.col("__i"), n, folds)), features, label, "__fold")
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    scores = {}
    for a in alphas:
        fits = [(test, (total - test).ridge(a)) for test in parts.values()]
        scores[float(a)] = float(np.mean([test.r2(*f) for test, f in fits]))
    best = max(scores, key=scores.get)
    coef, intercept = total.ridge(best)
    return RidgeFit(list(features), scaler, best, coef, intercept, scores)


def gradient_descent(m: Moments, epochs: int, learning_rate: float, start: Sequence[float] | None = None) -> list[tuple]:
    """Full-batch descent on the mean squared error: ``(epoch, w, b, loss, dw, db)`` per epoch.

    Gradients are those before the update, the loss is the one after it.
    """
    d = len(m.gram) - 2
    theta = np.zeros(d + 1) if start is None else np.asarray(start, dtype=float)  # b first
    g = m.gram / m.n
    out = []
    for epoch in range(1, epochs + 1):
        grad = 2 * (g[:-1, :-1] @ theta - g[:-1, -1])
        theta = theta - learning_rate * grad
        loss = m.squared_error(theta[1:], theta[0]) / m.n
        out.append((epoch, theta[1:].tolist(), float(theta[0]), float(loss), grad[1:].tolist(), float(grad[0])))
    return out


_HISTORY = "epoch int, w array<double>, b double, loss double, dw array<double>, db double"


def descent_history(
    df: DataFrame, features: Sequence[str], label: str, *, epochs: int = 100, learning_rate: float = 0.01
) -> DataFrame:
    """History of the descent over all rows of ``df``."""
    m = moments(df, features, label)[0]
    return df.sparkSession.createDataFrame(gradient_descent(m, epochs, learning_rate), _HISTORY)


def compare_learning_rates(
    df: DataFrame, features: Sequence[str], label: str, rates: Sequence[float] = (0.001, 0.01, 0.1, 0.5), epochs: int = 100
) -> DataFrame:
    """Loss per epoch and learning rate, all from one pass over the data."""
    m = moments(df, features, label)[0]
    rows = [(float(r), h[0], h[3]) for r in rates for h in gradient_descent(m, epochs, r)]
    return df.sparkSession.createDataFrame(rows, "learning_rate double, epoch int, loss double")


def compare_scenarios(scenarios: Mapping[str, DataFrame], features: Sequence[str], label: str, *, epochs: int = 100, learning_rate: float = 0.1) -> DataFrame:
    """Last epoch per named data set, e.g. one per noise level."""
    spark = next(iter(scenarios.values())).sparkSession
    rows = [
        (name, *gradient_descent(moments(d, features, label)[0], epochs, learning_rate)[-1][1:4])
        for name, d in scenarios.items()
    ]
    return spark.createDataFrame(rows, "scenario string, w array<double>, b double, loss double")


def loss_surface(df: DataFrame, feature: str, label: str, w_range, b_range, steps: int = 50) -> DataFrame:
    """Mean squared error on a (w, b) grid, a quadratic form of the moments."""
    g = moments(df, [feature], label)[0].gram
    g = g / g[0, 0]
    cells = df.sparkSession.range(steps * steps)
    i, j = F.floor(F.col("id") / steps), F.col("id") % steps
    grid = cells.select(
        (F.lit(float(w_range[0])) + i * F.lit((w_range[1] - w_range[0]) / (steps - 1))).alias("w"),
        (F.lit(float(b_range[0])) + j * F.lit((b_range[1] - b_range[0]) / (steps - 1))).alias("b"),
    )
    w, b = F.col("w"), F.col("b")
    c = lambda r, s: F.lit(float(g[r, s]))
    loss = c(2, 2) + w * w * c(1, 1) + b * b - 2 * w * c(1, 2) - 2 * b * c(0, 2) + 2 * w * b * c(0, 1)
    return grid.withColumn("loss", loss)


def evaluate(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE, MAE and mean residual."""
    y, p = F.col(actual), F.col(predicted)
    r = y - p
    n = F.count(r)
    spread = F.var_pop(y) * n
    return df.groupBy(*by).agg(
        n.alias("n"),
        (1 - F.try_divide(F.sum(r * r), spread)).alias("r2"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        F.avg(F.abs(r)).alias("mae"),
        F.avg(r).alias("mean_residual"),
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))
