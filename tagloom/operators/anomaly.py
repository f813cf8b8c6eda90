"""Principal components, clusters, process state and isolation forest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.quality import fill_mean, fill_zero
from tagloom.operators.quantiles import quantile_values
from tagloom.operators.scaling import standardize
from tagloom.session import materialize


def _scaled_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero-filled, standardised columns in vector ``x``."""
    scaled = standardize(fill_zero(df, columns), columns)
    return VectorAssembler(inputCols=list(columns), outputCol="x").transform(scaled)


def pca_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Explained variance ratio and running total per component."""
    fitted = PCA(k=len(columns), inputCol="x", outputCol="pc").fit(_scaled_vectors(df, columns))
    ratios = [float(v) for v in fitted.explainedVariance.toArray()]
    rows = [(i + 1, r, float(sum(ratios[: i + 1]))) for i, r in enumerate(ratios)]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


def components_needed(table: DataFrame) -> DataFrame:
    """Smallest number of components that explains 80 and 95 percent."""
    least = lambda share: F.min(F.when(F.col("cumulative") >= share, F.col("component")))
    return table.agg(least(0.8).alias("n_80"), least(0.95).alias("n_95"))


def kmeans_clusters(df: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """Cluster number per row, ``k = min(8, n / 10)`` by default; too few rows for two clusters are one.

    The scaled vectors are written once, for the start, the rounds and the assignment.
    """
    data = materialize(_scaled_vectors(df, columns))
    k = k or min(8, data.count() // 10)
    if k < 2:
        return data.drop("x").withColumn("cluster", F.lit(0))
    return KMeans(k=k, seed=42, featuresCol="x", predictionCol="cluster").fit(data).transform(data).drop("x")


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def process_state(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First (at most three) component scores per row."""
    k = min(3, len(columns))
    data = _scaled_vectors(df, columns)
    out = PCA(k=k, inputCol="x", outputCol="pc").fit(data).transform(data)
    scores = vector_to_array("pc")
    return out.select(*keep, *[scores[i].alias(f"pc{i + 1}") for i in range(k)])


def process_stability(scores: DataFrame, limit: float = 2.0) -> DataFrame:
    s = F.stddev_pop("pc1")
    return scores.agg(s.alias("pc1_std"), (s > limit).alias("unstable"))


def _average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n values."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    value = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


_NODE = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def _grow(tree: int, x: np.ndarray, max_depth: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = node
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or len(rows) <= 1 or len(usable) == 0:
            nodes.append([tree, node, -1, 0.0, -1, -1, len(rows), depth])
            continue
        f = int(rng.choice(usable))
        # between two neighbouring numbers a draw may be rounded up to the higher one, which would leave no row above
        cut = float(min(rng.uniform(lo[f], hi[f]), np.nextafter(hi[f], lo[f])))
        nodes.append([tree, node, f, cut, -1, -1, len(rows), depth])
        below = part[:, f] <= cut
        stack.append((rows[~below], depth + 1, node, 1))
        stack.append((rows[below], depth + 1, node, 0))
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForest:
    """Trees as flat node arrays; small enough to travel with the task."""

    columns: list[str]
    trees: list[dict[str, np.ndarray]]
    sample_size: int

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Negative anomaly score per row: the lower, the more abnormal."""
        trees, norm = self.trees, float(_average_path(self.sample_size))

        def depth_sum(x: np.ndarray) -> np.ndarray:
            total = np.zeros(len(x))
            for t in trees:
                at = np.zeros(len(x), dtype=np.int64)
                active = np.flatnonzero(t["feature"][at] >= 0)
                while len(active):
                    node = at[active]
                    low = x[active, t["feature"][node]] <= t["threshold"][node]
                    at[active] = np.where(low, t["left"][node], t["right"][node])
                    active = active[t["feature"][at[active]] >= 0]
                total += t["depth"][at] + _average_path(t["size"][at])
            return total

        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.column_stack([s.to_numpy(dtype=float) for s in batch])
                yield pd.Series(-(2.0 ** (-depth_sum(x) / (len(trees) * norm))))

        return df.withColumn(name, scored(*[F.col(c).cast("double") for c in self.columns]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that every bit of the result depends on every bit given."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least_of_each_tree(df: DataFrame, width: int, trees: int, size: int, seed: int, share: float) -> DataFrame:
    """(tree, h, x): per tree the ``size`` keys with the smallest hashes below ``share`` of all; equal keys count once.

    A task keeps the smallest of its rows per tree and sends only these, so rows are never multiplied.
    """
    salts = _mixed(np.arange(trees, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32))
    top = np.uint64(min(share, 1.0) * (2.0**64 - 2048))

    def merged(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((*x.T[::-1], h))  # of rows with one key the smallest values stand for it
        h, x = h[order], x[order]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        return h[first][:size], x[first][:size]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.uint64), np.zeros((0, width))) for _ in range(trees)]
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            for t in range(trees):
                h = _mixed(key ^ salts[t])
                bound = top if len(held[t][0]) < size else min(top, held[t][0][-1])
                near = h <= bound
                if near.any():
                    held[t] = merged(np.concatenate([held[t][0], h[near]]), np.concatenate([held[t][1], x[near]]))
        for t, (h, x) in enumerate(held):
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), t), pa.int32()), pa.array(h.view(np.int64)), pa.array(list(x), pa.list_(pa.float64()))], ["tree", "h", "x"])

    sent = df.mapInArrow(local, "tree int, h bigint, x array<double>")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        h, x = merged(pdf["h"].to_numpy().view(np.uint64), np.stack(pdf["x"].to_numpy()))
        return pd.DataFrame({"tree": pdf["tree"].iloc[0], "h": h.view(np.int64), "x": list(x)})

    return sent.groupBy("tree").applyInPandas(last, "tree int, h bigint, x array<double>")


def fit_isolation_forest(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], trees: int = 100, sample_size: int = 256, seed: int = 42
) -> IsolationForest:
    """Isolation forest (Liu, Ting, Zhou 2008) on samples drawn by hash, by one rule at every size.

    A tree's sample is the ``sample_size`` keys with the smallest hashes of its own, so it depends on the keys alone: not on
    partitions, nor on repeated rows.  Hashes beyond a bound that far more rows than wanted pass are not
    sent; should repeated keys leave a tree short, all are taken into account.
    """
    n = df.count()
    spread = df.select(F.xxhash64(*key).alias("k"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    enough = (sample_size + 8 * sample_size**0.5 + 16) / max(n, 1)
    names = [c.split()[0] for c in _NODE.split(", ")]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:  # ``limit``: depth of a balanced tree over the sample
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf["x"].to_numpy())
        x = x[np.lexsort(x.T[::-1])]
        return pd.DataFrame(_grow(tree, x, limit, seed), columns=names)

    for share in dict.fromkeys((min(1.0, enough), 1.0)):
        sample = materialize(_least_of_each_tree(spread, len(columns), trees, sample_size, seed, share))
        sizes = {r["tree"]: r["count"] for r in sample.groupBy("tree").count().collect()}
        if len(sizes) == trees and min(sizes.values()) >= sample_size:
            break
    size = max(sizes.values(), default=1)
    limit = int(np.ceil(np.log2(max(size, 2))))
    nodes = sample.groupBy("tree").applyInPandas(grow, _NODE).toPandas()
    built = []
    for _, t in nodes.groupby("tree"):
        t = t.sort_values("node")
        built.append({c: t[c].to_numpy() for c in names[2:]})
    return IsolationForest(list(columns), built, size)


def anomaly_scores(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], contamination: float = 0.1, prepare: str = "mean", **options
) -> DataFrame:
    """``score`` and ``is_anomaly`` (score below the contamination quantile) per row.

    ``prepare`` is ``mean`` (mean fill) or ``scaled`` (zero fill, standardised).
    """
    ready = fill_mean(df, columns) if prepare == "mean" else standardize(fill_zero(df, columns), columns)
    # scoring in Python costs more than writing its result once
    scored = materialize(fit_isolation_forest(ready, columns, key, **options).score(ready))
    limit = quantile_values(scored, ["score"], [contamination], n_rows=df.count())["score"][0]
    return scored.withColumn("is_anomaly", F.col("score") < F.lit(limit))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    n = F.count_if("is_anomaly")
    return scored.agg(n.alias("n_anomalies"), (n * 100 / F.count(F.lit(1))).alias("anomaly_pct"))
