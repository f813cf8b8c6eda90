"""Vector codes: product quantisation by Lloyd's algorithm with a tree over the vectors' parts and a tree over the entries.

A vector is cut into equal consecutive parts; every part position has a codebook of its own.  Vectors are packed
once into blocks, rows of a table in the shared folder.  A block holds, for each position, its part vectors in
the order of a balanced tree, and per node of that tree the box around it and the sum of its vectors.
In each round a block walks its tree and the tree of the codebook's entries together:

* a pair of nodes is dropped if the least distance of their boxes exceeds the largest distance to another pair's
  entries; of single entries one is dropped if another one is nearer on the whole box;
* a node with one entry left is assigned as a whole, its cached sum and count are all the round needs;
* leaves that keep several entries are compared part by part in integers.

All bounds and distances are integers, so pruning never changes a result.  A block sends sums and
counts per entry, numbers of a size set by the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components lie within +-LIMIT (16384 before scaling), see ``limit_of``; components beyond count as the limit.
LIMIT = 1 << 26
#: A comparison holds the distance and the entry's index in one integer; codebooks have at most this many entries.
ENTRY_SLOTS = 32
BLOCK_VECTORS, LEAF = 4096, 16
#: Table of labels up to which it is broadcast (a label and two numbers each), and rows from which a label is hot beyond.
LABELS, HOT = 100_000, 1_000_000


def limit_of(part: int) -> int:
    """Largest power of two up to LIMIT with which distances of parts of this length fit 64 bits together with an entry's index."""
    limit = LIMIT
    while 4 * limit * limit * part * ENTRY_SLOTS >= 1 << 63:
        limit //= 2
    return limit


# Trees -----------------------------------------------------------------------------------------------------------


def _depth(n: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if n > leaf else 0


def _limits(n: int, depth: int) -> np.ndarray:
    """Start of every node's points in heap order, and end: shape (nodes, 2)."""
    out = [np.array([[0, n]])]
    for _ in range(depth):
        a, b = out[-1].T
        middle = (a + b) // 2
        out.append(np.stack([np.stack([a, middle], 1), np.stack([middle, b], 1)], 1).reshape(-1, 2))
    return np.concatenate(out)


@dataclass
class Tree:
    """Balanced tree in heap order (children of i: 2i+1, 2i+2) over ``points``, which lie in tree order; ``order`` are their old places."""

    points: np.ndarray
    order: np.ndarray
    depth: int
    limits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        depth = _depth(len(points), leaf)
        limits = _limits(len(points), depth)
        order = np.arange(len(points))
        for a, b in limits[: (1 << depth) - 1]:
            mine = points[order[a:b]]
            widest = int(np.argmax(mine.max(0) - mine.min(0))) if mine.shape[1] else 0
            if mine.shape[1]:
                order[a:b] = order[a:b][np.argpartition(mine[:, widest], (b - a) // 2, kind="introselect")]
        return cls.of(points[order], order, leaf)

    @classmethod
    def of(cls, points: np.ndarray, order: np.ndarray, leaf: int = LEAF) -> Tree:
        """From points in tree order: boxes and sums bottom up."""
        depth = _depth(len(points), leaf)
        limits = _limits(len(points), depth)
        first = (1 << depth) - 1
        nodes = len(limits)
        low, high, sums = (np.zeros((nodes, points.shape[1]), np.int64) for _ in range(3))
        starts = limits[first:, 0]  # an empty leaf has its sibling's first point: that changes no box above
        low[first:], high[first:], sums[first:] = (f.reduceat(points, starts, axis=0) for f in (np.minimum, np.maximum, np.add))
        sums[first:][limits[first:, 0] == limits[first:, 1]] = 0
        for level in reversed(range(depth)):
            own = np.arange((1 << level) - 1, (2 << level) - 1)
            left, right = 2 * own + 1, 2 * own + 2
            low[own], high[own], sums[own] = np.minimum(low[left], low[right]), np.maximum(high[left], high[right]), sums[left] + sums[right]
        return cls(points, order, depth, limits, low, high, sums)

    @property
    def first_leaf(self) -> int:
        return (1 << self.depth) - 1


@dataclass
class Assigned:
    """Entry of every point in tree order; nodes taken whole with their entry; points that were compared, and comparisons."""

    entry: np.ndarray
    nodes: np.ndarray
    node_entry: np.ndarray
    loose: np.ndarray
    compared: int


def assign(tree: Tree, entries: np.ndarray) -> Assigned:
    """Nearest entry of every point (squared distance, ties to the lower index)."""
    book = Tree.build(entries, 1)
    spread = book.limits[:, 1] - book.limits[:, 0]  # 1: a single entry
    best = np.full(len(tree.points), np.iinfo(np.int64).max)
    whole, whole_entry, loose = [], [], []
    d, e, compared = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    size = (tree.high - tree.low).max(1, initial=0)
    book_size = (book.high - book.low).max(1, initial=0)
    while len(d):
        d, e = _drop(tree, book, spread, d, e)
        ends = np.concatenate([[True], d[1:] != d[:-1]])
        head = np.flatnonzero(ends)
        group = np.cumsum(ends) - 1
        count = np.diff(np.append(head, len(d)))
        single = np.maximum.reduceat(spread[e], head) == 1
        done = single & (count == 1)
        whole.append(d[head[done]])
        whole_entry.append(book.order[book.limits[e[head[done]], 0]])
        is_leaf = d[head] >= tree.first_leaf
        uncertain = (~done & single & is_leaf)[group]
        if uncertain.any():
            compared += _compare(tree, book, d[uncertain], e[uncertain], best)
            loose.append(np.unique(d[uncertain]))
        rest = ~done[group] & ~uncertain
        coarse = np.maximum.reduceat(book_size[e], head)
        data_first = (single | ((size[d[head]] >= coarse) & ~is_leaf))[group]
        down = rest & data_first
        stay, split = rest & ~data_first & (spread[e] == 1), rest & ~data_first & (spread[e] > 1)
        d = np.concatenate([2 * d[down] + 1, 2 * d[down] + 2, d[stay], d[split], d[split]])
        e = np.concatenate([e[down], e[down], e[stay], 2 * e[split] + 1, 2 * e[split] + 2])
        keep = spread[e] > 0
        order = np.argsort(d[keep], kind="stable")
        d, e = d[keep][order], e[keep][order]
    nodes, node_entry = np.concatenate(whole), np.concatenate(whole_entry)
    entry = best & (ENTRY_SLOTS - 1)
    at = tree.limits[nodes]
    for (a, b), k in zip(at.tolist(), node_entry.tolist()):
        entry[a:b] = k
    return Assigned(entry, nodes, node_entry, np.concatenate(loose) if loose else np.zeros(0, np.int64), compared)


def _drop(tree: Tree, book: Tree, spread: np.ndarray, d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (ordered by data node) without those that hold no nearest entry of any point of the node."""
    low, high, elow, ehigh = tree.low[d], tree.high[d], book.low[e], book.high[e]
    near = np.maximum(0, np.maximum(low - ehigh, elow - high))
    far = np.maximum(np.abs(high - elow), np.abs(ehigh - low))
    head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    width = np.diff(np.append(head, len(d)))
    bound = np.repeat(np.minimum.reduceat((far**2).sum(1), head), width)
    keep = (near**2).sum(1) <= bound
    # Among single entries: the one nearest to the box's middle against the others, on the corner best for the other.
    single = spread[e] == 1
    middle = np.where(single, ((low + high - 2 * elow) ** 2).sum(1), np.iinfo(np.int64).max)
    best = np.minimum.reduceat(middle, head)
    rank = np.where(middle == np.repeat(best, width), np.arange(len(d)), len(d))
    champion = np.repeat(np.minimum.reduceat(rank, head), width)
    known = np.repeat(best, width) < np.iinfo(np.int64).max
    other = book.low[e[np.where(known, champion, 0)]]
    slope = 2 * (other - elow)
    least = np.where(slope > 0, slope * low, slope * high).sum(1) + (elow**2 - other**2).sum(1)
    keep &= ~(known & single & (least > 0))
    return d[keep], e[keep]


def _compare(tree: Tree, book: Tree, d: np.ndarray, e: np.ndarray, best: np.ndarray) -> int:
    """Distances of the points of leaves to their entries, into ``best``."""
    compared = 0
    for node in np.unique(e):
        a, b = tree.limits[d[e == node]].T
        length = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        k = int(book.order[book.limits[node, 0]])
        distance = ((tree.points[at] - book.low[node]) ** 2).sum(1)
        best[at] = np.minimum(best[at], distance * ENTRY_SLOTS + k)
        compared += len(at)
    return compared


def tally(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) of the points of each entry: whole nodes by their cached sums, the others one by one."""
    found = assign(tree, entries)
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    np.add.at(counts, found.node_entry, np.diff(tree.limits[found.nodes], axis=1)[:, 0])
    np.add.at(sums, found.node_entry, tree.sums[found.nodes])
    a, b = tree.limits[found.loose].T
    at = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)])[:-1], b - a) + np.arange((b - a).sum()) if len(a) else np.zeros(0, np.int64)
    np.add.at(counts, found.entry[at], 1)
    np.add.at(sums, found.entry[at], tree.points[at])
    return counts, sums


# Spark -----------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(v_id, v, v_label) of rows whose vector is known and all finite; ``v`` holds the integer components."""
    x = F.col("v")
    doubles = vectors.select(vectors[vec_id].alias("v_id"), vectors[embedding].cast("array<double>").alias("v"), vectors[label].alias("v_label"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long"))
    return doubles.where(x.isNotNull() & finite).withColumn("v", whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros up to ``width``, within the limits."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    limit = limit_of(width // PARTS)
    return out.clip(-limit, limit)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """Blocks: (ids, labels, data), data being all parts in tree order and their places, position after position."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("v_id", "v_label")}
    part = width // PARTS

    def block(ids: list, labels: list, vectors: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        x = np.concatenate(vectors)
        trees = [Tree.build(x[:, p * part : (p + 1) * part]) for p in range(PARTS)]
        data = b"".join(t.points.astype(np.int32).tobytes() + t.order.astype(np.int32).tobytes() for t in trees)
        return pa.RecordBatch.from_arrays([pa.array([ids], schema.field(0).type), pa.array([labels], schema.field(1).type), pa.array([data], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, held, schema = [], [], [], 0, None
        for batch in batches:
            schema = pa.schema([("ids", pa.list_(batch.schema.field("v_id").type)), ("labels", pa.list_(batch.schema.field("v_label").type)), ("data", pa.binary())])
            for start in range(0, batch.num_rows, BLOCK_VECTORS):
                piece = batch.slice(start, BLOCK_VECTORS)
                if held and held + piece.num_rows > BLOCK_VECTORS:
                    yield block(ids, labels, vectors, schema)
                    ids, labels, vectors, held = [], [], [], 0
                ids += piece.column("v_id").to_pylist()
                labels += piece.column("v_label").to_pylist()
                vectors.append(_matrix(piece.column("v"), width))
                held += piece.num_rows
        if held:
            yield block(ids, labels, vectors, schema)

    return table(rows.mapInArrow(run, f"ids array<{kinds['v_id']}>, labels array<{kinds['v_label']}>, data binary"))


def _trees(data: bytes, n: int, part: int) -> list[Tree]:
    flat, size = np.frombuffer(data, np.int32).astype(np.int64), n * (part + 1)
    return [Tree.of(flat[p * size : p * size + n * part].reshape(n, part), flat[p * size + n * part : (p + 1) * size]) for p in range(PARTS)]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round; what is collected is one row per entry."""
    part = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                n = len(batch.column("ids")[row])
                for p, tree in enumerate(_trees(batch.column("data")[row].as_py(), n, part)):
                    more = tally(tree, books[p])
                    counts[p] += more[0]
                    sums[p] += more[1]
        p, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(counts[p, k], pa.int64()), pa.array(list(sums[p, k]), pa.list_(pa.int64()))], ["p", "k", "n", "s"])

    sent = blocks.select("ids", "data").mapInArrow(run, "p int, k int, n long, s array<long>")
    totals = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(part)]
    after = books.copy()
    for r in sent.groupBy("p", "k").agg(F.sum("n").alias("n"), *totals).collect():
        after[r["p"], r["k"]] = [int(r[f"s{i}"]) // r["n"] for i in range(part)]
    return after


def fit(rows: DataFrame, blocks: DataFrame, width: int) -> np.ndarray:
    """Codebooks (part, entry, component) after all rounds, started from the vectors of the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("v_id"), "v").limit(ENTRIES).collect()
    start = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = r["v"]
    limit = limit_of(width // PARTS)
    start = start.clip(-limit, limit)
    books = np.ascontiguousarray(start.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2))
    return reduce(lambda b, _: _round(blocks, b), range(ROUNDS), books)


def encode(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(v_id, v_label, code, error, label_error, codebooks) of every vector that is known and all finite.

    Rows with a null vector, or one with null, NaN or infinite components, are left out.  Vectors are filled with
    zeros to the longest length, rounded up to a multiple of the parts (an empty vector is all zeros).
    Components beyond +-16384 (less for parts of over 16 components) count as that bound.  Repeated ids stay rows of their own; null ids come last, and equal
    ids by their components, when the first entries are chosen; fewer rows than entries give smaller codebooks.  An
    empty table gives no rows.  ``label_error`` is null where a sum passes 64 bits.
    """
    rows = usable(vectors, vec_id, embedding, label)
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = -(-max(longest or 0, 1) // PARTS) * PARTS
    if longest is None:
        empty = rows.select("v_id", "v_label").where("1 = 0")
        return empty.select("*", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.array().cast("array<long>").alias("codebooks"))
    blocks = _packed(rows, width)
    books = fit(rows, blocks, width)
    coded = table(_coded(rows, blocks, books))
    return with_label_error(coded).withColumn("codebooks", F.lit([int(x) for x in books.reshape(-1)]))


def _coded(rows: DataFrame, blocks: DataFrame, books: np.ndarray) -> DataFrame:
    part = books.shape[2]
    digits = np.array([f"{k:02x}" for k in range(books.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                error, code = np.zeros(len(ids), np.int64), np.zeros((PARTS, len(ids)), np.int64)
                for p, tree in enumerate(_trees(batch.column("data")[row].as_py(), len(ids), part)):
                    entry = assign(tree, books[p]).entry
                    code[p, tree.order] = entry
                    error[tree.order] += ((tree.points - books[p][entry]) ** 2).sum(1)
                text = reduce(np.char.add, digits[code])
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error, pa.int64())], ["v_id", "v_label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("v_id", "v_label")}
    return blocks.mapInArrow(run, f"v_id {kinds['v_id']}, v_label {kinds['v_label']}, code string, error long")


def with_label_error(coded: DataFrame, labels: int = LABELS, hot: int = HOT) -> DataFrame:
    """Add the summed error of all rows of the same label (nulls together).

    The table of labels is broadcast when counted to be short.  Otherwise only labels of more than ``hot`` rows are, of
    which there are at most rows / ``hot``, and the rest is joined by shuffle in groups of at most that size.
    """
    sums = coded.groupBy("v_label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = table(sums.withColumnRenamed("v_label", "s_label"))
    same = F.col("v_label").eqNullSafe(F.col("s_label"))
    columns = [*coded.columns, "label_error"]
    if sums.limit(labels + 1).count() <= labels:
        return coded.join(F.broadcast(sums), same, "left").select(*columns)
    often, rest = sums.where(F.col("n") > hot), sums.where(F.col("n") <= hot)
    marked = coded.join(F.broadcast(often), same, "left")
    return marked.where("n IS NOT NULL").select(*columns).unionByName(marked.where("n IS NULL").select(*coded.columns).join(rest, same).select(*columns))

