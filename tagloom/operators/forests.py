"""Random forests of many rows, grown from sums per cell of binned features.

A tree sees a row only through the bins of its features, its label and its weight in the tree's bootstrap sample.  MLlib reads
all rows, with a weight for every tree, once per level.  Here one reading gives the sums of weight, label and squared label
per tree and cell (a combination of bins), and all levels of a tree follow from these: nothing that is read or sent after the
rows themselves grows with their number.  Thresholds, feature subsets and stopping rules are MLlib's, and so is the model.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from math import ceil, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import materialize, shared_dir

#: Up to so many rows MLlib grows the forest; so does it beyond so many possible cells (tree, cell and three sums: 28 bytes).
FEW_ROWS, MAX_CELLS = 100_000, 1 << 16
#: Rows whose values give the thresholds (MLlib takes 10,000), and rows of a task that are drawn from at once.
THRESHOLD_ROWS, BLOCK = 100_000, 1 << 16
#: A node of less impurity is a leaf, as in MLlib.
_EPSILON = 2.0**-52
_HANDLED = {"featuresCol", "labelCol", "predictionCol", "numTrees", "maxDepth", "maxBins", "seed"}
_SUMS = "tree int, part int, cells binary, sums binary"
_NODE = (
    "tree int, id int, prediction double, impurity double, weight double, total double, squares double, gain double, "
    "left int, right int, feature int, threshold double, cells binary"
)


class CellForest(RandomForestRegressor):
    """MLlib's forest; of many rows and few cells it is grown from the cells' sums."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        if not {p.name for p in self._paramMap} <= _HANDLED or (n := dataset.count()) <= FEW_ROWS:
            return super()._fit(dataset)
        x, y = vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")
        seed = self.getSeed() & (2**63 - 1)
        cuts = _cuts(dataset.sample(False, min(1.0, THRESHOLD_ROWS / n), seed).select(x), min(self.getMaxBins(), n))
        if prod(len(c) + 1 for c in cuts) > MAX_CELLS:
            return super()._fit(dataset)
        trees, depth = self.getNumTrees(), self.getMaxDepth()
        binned = dataset.select(x, y).mapInArrow(_binned(cuts), "cell int, y double")
        # tasks of neighbouring size, each with few of the cells; a crowded cell is split
        sums = binned.hint("rebalance", F.col("cell")).mapInArrow(_drawn(trees, seed), _SUMS)
        nodes = sums.groupBy("tree").applyInPandas(_grown(cuts, depth, trees, seed), _NODE)
        grown = materialize(nodes)
        means = grown.where("id = 0").select("tree", "cells").groupBy().applyInPandas(_cell_means, "means binary").collect()[0][0]
        return self._copyValues(CellForestModel(cuts, np.frombuffer(means), lambda: self._stored(grown, len(cuts))))

    def _stored(self, nodes: DataFrame, features: int) -> RandomForestRegressionModel:
        """MLlib's model of the nodes, by way of its file format."""
        spark, path = nodes.sparkSession, shared_dir(nodes.sparkSession)
        inner = F.col("left") >= 0
        split = F.struct(
            F.col("feature").alias("featureIndex"),
            F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
            F.lit(-1).alias("numCategories"),
        )
        node = F.struct(
            "id", "prediction", "impurity", F.array("weight", "total", "squares").alias("impurityStats"), F.col("weight").cast("long").alias("rawCount"),
            "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
        )
        nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")
        package, trees = "org.apache.spark.ml.regression", self.getNumTrees()
        params = {p.name: v for p, v in self._paramMap.items() if p.name != "numTrees"}
        tree = {"class": f"{package}.DecisionTreeRegressionModel", "timestamp": 0, "sparkVersion": spark.version, "paramMap": params, "defaultParamMap": {}}
        saved = [(i, json.dumps({**tree, "uid": f"{self.uid}_{i}"}), 1.0) for i in range(trees)]
        spark.createDataFrame(saved, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        DefaultParamsWriter.saveMetadata(self, path, spark, {"class": f"{package}.RandomForestRegressionModel", "numFeatures": features, "numTrees": trees})
        return RandomForestRegressionModel.load(path)


class CellForestModel(RandomForestRegressionModel):
    """MLlib's model; its trees are loaded when they are asked for, as the driver would hold all nodes of each fold's forest.

    The forest is constant on a cell, so rows get the mean of all trees for theirs.
    """

    def __init__(self, cuts: Sequence[np.ndarray], table: np.ndarray, load: Callable[[], RandomForestRegressionModel]):
        self._java, self._load = None, None
        super().__init__()
        self.cuts, self.table, self._load = cuts, table, load

    @property
    def _java_obj(self):
        if self._load is not None:
            load, self._load = self._load, None
            loaded = load()
            self._java, loaded._java_obj = loaded._java_obj, None  # taken over: a wrapper that ends takes its Java object along
        return self._java

    @_java_obj.setter
    def _java_obj(self, value) -> None:
        self._java, self._load = value, None

    def __del__(self) -> None:
        if self._java is not None:
            super().__del__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getLeafCol():
            return super()._transform(dataset)
        cuts, table = self.cuts, self.table

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            return pa.array(table[_cells(x, cuts)])

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(F.col(self.getFeaturesCol()))))


def _cell_means(roots: pd.DataFrame) -> pd.DataFrame:
    """Per cell the mean of all trees, added up in MLlib's order."""
    cells = roots.sort_values("tree")["cells"]
    total = sum(np.frombuffer(c) for c in cells)
    return pd.DataFrame({"means": [(total / len(cells)).tobytes()]})


def _cuts(sample: DataFrame, bins: int) -> list[np.ndarray]:
    """Thresholds per feature, by MLlib's rule and from ten times as many rows."""
    x = sample.toArrow()["x"].combine_chunks()
    return [thresholds(column, bins) for column in _matrix(x, len(x[0])).T]


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


def _cells(x: pa.Array, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """A value is in bin j if it is at most threshold j and above the ones before; the first feature's bins vary slowest."""
    values, cell = _matrix(x, len(cuts)), np.zeros(len(x), np.int64)
    for j, c in enumerate(cuts):
        cell = cell * (len(c) + 1) + np.searchsorted(c, values[:, j])
    return cell


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Between all distinct values if these are few, else where the counts come nearest to equal shares."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) < bins:
        return between
    stride = target = len(values) / bins
    reached, chosen = np.cumsum(counts), []
    for i in range(len(between)):
        if abs(reached[i] - target) < abs(reached[i + 1] - target):
            chosen.append(between[i])
            target += stride
    return np.array(chosen)


def _binned(cuts: Sequence[np.ndarray]):
    """Rows as cell and label.  Values that MLlib refuses are refused."""

    def run(batches):
        for b in batches:
            if not (np.isfinite(_matrix(b.column("x"), len(cuts))).all() and np.isfinite(b.column("y").to_numpy(zero_copy_only=False)).all()):
                raise ValueError("a label or a feature is NULL, NaN or infinite")
            cells = pa.array(_cells(b.column("x"), cuts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([cells, b.column("y")], ["cell", "y"])

    return run


def _drawn(trees: int, seed: int):
    """Per tree the cells of the task with their sums over a bootstrap sample of the task's rows.

    Poisson(1) weights of m rows are drawn as Poisson(m) rows with replacement, which is the same.  Rows are taken in order, so
    that a task that runs again draws the same ones.
    """

    def run(batches):
        parts = [(b.column("cell").to_numpy(), b.column("y").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        cell, y = (np.concatenate(p) for p in zip(*parts))
        rank = np.lexsort((y, cell))
        cell, y = cell[rank], y[rank]
        cells, part = np.unique(cell), TaskContext.get().partitionId()
        blocks = []
        for low in range(0, len(y), BLOCK):
            own, values = cell[low : low + BLOCK], y[low : low + BLOCK]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            first = np.searchsorted(cells, own[0])
            blocks.append((values, values * values, starts, slice(first, first + len(starts))))
        for tree in range(trees):
            rng, sums = np.random.default_rng([seed, tree, part]), np.zeros((3, len(cells)))
            for values, squares, starts, at in blocks:
                m = len(values)
                w = np.bincount(rng.integers(0, m, rng.poisson(m)), minlength=m).astype(float)
                for k, v in enumerate((w, w * values, w * squares)):
                    sums[k, at] += np.add.reduceat(v, starts)
            row = [[tree], [part], [cells.astype(np.int32).tobytes()], [sums.tobytes()]]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["tree", "part", "cells", "sums"])

    return run


def _grown(cuts: Sequence[np.ndarray], depth: int, trees: int, seed: int):
    n_cells = prod(len(c) + 1 for c in cuts)
    per_node = len(cuts) if trees == 1 else ceil(len(cuts) / 3)

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        tree, total = int(parts["tree"].iloc[0]), np.zeros((3, n_cells))
        for _, p in parts.sort_values("part").iterrows():  # in order: sums are the same each time
            cells = np.frombuffer(p["cells"], np.int32)
            total[:, cells] += np.frombuffer(p["sums"]).reshape(3, -1)
        nodes, means = grow(total, cuts, depth, per_node, np.random.default_rng([seed, tree]))
        nodes.insert(0, "tree", tree)
        nodes["cells"] = [means.tobytes(), *[None] * (len(nodes) - 1)]
        return nodes

    return run


def grow(sums: np.ndarray, cuts: Sequence[np.ndarray], depth: int, per_node: int, rng: np.random.Generator) -> tuple[pd.DataFrame, np.ndarray]:
    """Nodes of the tree over all cells, level by level, children after their parents; and the prediction of every cell.

    ``sums``: weight, label and squared label of every cell, the first feature's bins varying slowest.
    """
    sizes = [len(c) + 1 for c in cuts]
    cells, s, means = np.arange(sums.shape[1]), sums, np.zeros(sums.shape[1])
    bins = np.array(np.unravel_index(cells, sizes))
    node, ids, levels = np.zeros(len(cells), np.int64), np.zeros(1, np.int64), []
    for level in range(depth + 1):
        k = len(ids)
        weight, total, squares = sums = np.stack([np.bincount(node, v, k) for v in s])
        impurity = (squares - total * total / weight) / weight
        gain, feature, place = np.full(k, -np.inf), np.full(k, -1), np.zeros(k, np.int64)
        drawn = rng.random((k, len(cuts))).argsort(axis=1)[:, :per_node]
        for f, b in enumerate(sizes):
            tried = (drawn == f).any(axis=1) & (impurity > _EPSILON) & (level < depth) & (b > 1)
            if not tried.any():
                continue
            rows = tried[node]
            at = node[rows] * b + bins[f, rows]
            left = np.stack([np.bincount(at, v[rows], k * b).reshape(k, b) for v in s]).cumsum(axis=2)[:, :, :-1]
            right = sums[:, :, None] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                within = left[2] - left[1] ** 2 / left[0] + right[2] - right[1] ** 2 / right[0]
                gains = impurity[:, None] - within / weight[:, None]
            gains[(left[0] < 1) | (right[0] < 1)] = -np.inf
            best = gains.argmax(axis=1)
            most = np.where(tried, gains[np.arange(k), best], -np.inf)
            better = most > gain
            gain[better], feature[better], place[better] = most[better], f, best[better]
        split = gain > 0
        nth = np.cumsum(split) - 1
        left_id = np.where(split, ids[-1] + 1 + 2 * nth, -1)
        levels.append(
            pd.DataFrame({
                "id": ids, "prediction": total / weight, "impurity": impurity, "weight": weight, "total": total, "squares": squares,
                "gain": np.where(split, gain, -1.0), "left": left_id, "right": np.where(split, left_id + 1, -1),
                "feature": np.where(split, feature, -1), "threshold": [cuts[f][p] if yes else 0.0 for f, p, yes in zip(feature, place, split)],
            })
        )
        going = split[node]
        means[cells[~going]] = (total / weight)[node[~going]]
        if not split.any():
            break
        ids = ids[-1] + 1 + np.arange(2 * split.sum())
        cells, node, s, bins = cells[going], node[going], s[:, going], bins[:, going]
        above = bins[feature[node], np.arange(len(node))] > place[node]
        node = 2 * nth[node] + above
    return pd.concat(levels, ignore_index=True), means
