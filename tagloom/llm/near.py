"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

1. One pass counts, for hashed shingle slots, the documents that have them: a table of fixed size,
   so its broadcast is bounded (``SLOTS`` floats) while its counts cover the whole corpus.
2. One pass draws ``BANDS * ROWS`` consistent weighted samples per text and keeps a key per band.
   Equal texts become one node.
3. Nodes that share a band key are candidates.  Small buckets compare all their pairs, large ones every
   node with one leader, the node with most company.  Where nodes of a large bucket are not connected to its
   leader, blocks of signatures show which could be linked to what else; those are compared text by
   text, again in blocks, so that no list of pairs is made.
4. A pair whose signatures agree in too few samples is dropped (at similarity 0.8 a true pair has 45 of 56 in
   the mean; fewer than ``AGREE`` has a probability of about 1 in 10,000).  Weighted Jaccard similarity of
   the whole texts decides the others; connected nodes are a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import WordHashes, mix, table, text_of, windows_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
#: Slots of the document-frequency table; a power of two. More slots mean fewer shingles that share one.
SLOTS = 1 << 20
#: Weight of the most frequent shingle against the rarest. Frequency lowers a weight but can't
#: outweigh the text: a group of copies makes its own shingles frequent.
FLOOR = 0.8
#: Buckets up to this many nodes compare all pairs. Nodes of one block of signatures.
SMALL, BLOCK = 4, 512
#: Samples of two signatures that must agree, of BANDS * ROWS.
AGREE = 33
_TABLE, _CHUNK = 1 << 16, 1 << 14
_SLICES = 64


def shingles(text: str, cache: WordHashes) -> np.ndarray:
    """Hash of each run of five words (of the whole text, if it is shorter), lower case; empty without words."""
    words = cache.of(text.lower().encode().split())
    return windows_of(words, min(SHINGLE, len(words))) if len(words) else words


def weighted(text: str, cache: WordHashes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, occurrences times inverse document frequency)."""
    found, n = np.unique(shingles(text, cache), return_counts=True)
    return found, n * weights[(found & np.uint64(len(weights) - 1)).astype(np.int64)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if both else 0.0


def idf(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of each slot from FLOOR to 1: logarithmic inverse document frequency, scaled by that of a single document."""
    n = max(n_docs, 1)
    share = np.log((n + 1) / (counts + 1)) / np.log((n + 1) / 2) if n > 1 else np.ones(len(counts))
    return (FLOOR + (1 - FLOOR) * np.clip(share, 0, 1)).astype(np.float32)


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weights by slot, from the counts of all documents; tasks send sums of slots, in slices."""
    width = SLOTS // _SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts, n = WordHashes(), np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                slots = np.unique(shingles(t, cache) & np.uint64(SLOTS - 1)).astype(np.int64)
                counts[slots] += 1
                n += 1
        kind = pa.schema([("slice", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())])
        yield pa.RecordBatch.from_pylist([{"slice": k, "n": n, "counts": counts[k * width : (k + 1) * width].astype(np.int32).tobytes()} for k in range(_SLICES)], kind)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.int32)
        return pd.DataFrame({"slice": [pdf["slice"].iat[0]], "n": [pdf["n"].sum()], "counts": [total.tobytes()]})

    sent = docs.select(text_of(text).alias("text")).mapInArrow(run, "slice int, n long, counts binary")
    rows = sorted(sent.groupBy("slice").applyInPandas(add, "slice int, n long, counts binary").collect())  # SLOTS counts in all
    if not rows:
        return np.ones(SLOTS, np.float32)
    return idf(np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]), rows[0]["n"])


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010); variates come from seeded tables by shingle hash."""

    def __init__(self):
        draw = np.random.default_rng(20100101)
        self.r = draw.gamma(2.0, 1.0, _TABLE).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
        self.beta = draw.random(_TABLE, np.float32)
        self.seeds = draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)

    def sample(self, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The samples of a non-empty weighted set, as hashes."""
        best = np.full(len(self.seeds), np.inf, np.float32)
        sample = np.zeros(len(self.seeds), np.uint64)
        line = np.arange(len(self.seeds))
        for a in range(0, len(found), _CHUNK // 16):
            h = found[a : a + _CHUNK // 16]
            m = h[None, :] * self.seeds
            m ^= m >> np.uint64(32)
            low = (m & np.uint64(0xFFFF)).astype(np.int32)
            mid = ((m >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)
            top = ((m >> np.uint64(48)) & np.uint64(0xFFFF)).astype(np.int32)
            r, beta = self.r[low], self.beta[mid]
            t = np.floor(np.log(weights[a : a + _CHUNK // 16]).astype(np.float32)[None, :] / r + beta)
            value = self.log_c[top] - r * (t - beta + 1)
            at = value.argmin(1)
            better = value[line, at] < best
            best = np.where(better, value[line, at], best)
            sample = np.where(better, h[at] ^ (t[line, at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), sample)
        return mix(sample)


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One key per band of samples."""
    rows, out = sample.reshape(BANDS, ROWS), np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
    return mix(out)


def node_of(text: Column) -> Column:
    """Equal texts, up to case, are one node."""
    return F.unhex(F.md5(F.lower(text)))


def _signatures(docs: DataFrame, weights, text: str, doc_id: str) -> DataFrame:
    """(doc_id, node, keys: long per band, empty without words; signature: 16 bits of each sample)."""
    body = text_of(docs[text])
    slim = docs.select(docs[doc_id].alias("doc_id"), node_of(body).alias("node"), body.alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sampler, w = WordHashes(), Sampler(), weights.value
        for batch in batches:
            keys, signatures = [], []
            for t in batch.column("text").to_pylist():
                found, x = weighted(t, cache, w)
                sample = sampler.sample(found, x) if len(found) else found
                keys.append(band_keys(sample).view(np.int64) if len(found) else np.zeros(0, np.int64))
                signatures.append(sample.astype(np.uint16).tobytes())
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *keys])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(signatures, pa.binary())], ["doc_id", "node", "keys", "signature"])

    return slim.mapInArrow(run, f"doc_id {kind}, node binary, keys array<long>, signature binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, first, signature, n: size of the bucket, company: sizes of all buckets of the node) of buckets with several nodes.

    Signatures join the members of such buckets only, so that they don't move once per band.
    """
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    member = table(keyed.join(sizes, "bucket"))
    company = member.groupBy("node").agg(F.sum("n").alias("company")).join(nodes.select("node", "first", "signature"), "node")
    return table(member.join(company, "node"))


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) of the pairs whose signatures agree in AGREE samples at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary").distinct()


def _all_pairs(small: DataFrame) -> DataFrame:
    """Pairs of buckets that hold SMALL nodes at most: a node meets at most SMALL - 1 others in one."""
    a = small.select("bucket", F.col("node").alias("a"), F.col("signature").alias("sa"))
    b = small.select("bucket", F.col("node").alias("b"), F.col("signature").alias("sb"))
    return a.join(b, "bucket").where("a < b")


def _leaders(large: DataFrame) -> DataFrame:
    return large.groupBy("bucket").agg(F.max_by(F.struct("node", "signature"), F.struct("company", "node")).alias("x")).select("bucket", F.col("x.node").alias("leader"), F.col("x.signature").alias("sb"))


def _stars(large: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs of each node with the leader of its bucket."""
    return large.join(leaders, "bucket").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), F.col("signature").alias("sa"), "sb")


def spanning(linked: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that join different labels, as few as connect the same; ``labels`` of the rows, then of the columns."""
    labels, n, out = labels.copy(), len(linked), []
    for k in range(n):
        hit = np.flatnonzero(linked[k])
        found, first = np.unique(labels[n + hit], return_index=True)
        new = found != labels[k]
        out += [(k, int(j)) for j in hit[first[new]]]
        if new.any():
            labels[np.isin(labels, found[new])] = labels[k]
    return out


def between_roots(linked: np.ndarray, nodes: list, roots: list, final: bool) -> list[tuple[int, int]]:
    """Links (row, column) between different roots; ``nodes`` and ``roots`` of the rows, then of the columns.

    A final link makes two roots one, so one link for two roots is enough.  Links that are yet to be verified may fail,
    so they must connect all nodes they concern: which of them holds is not known.
    """
    root = np.unique(roots, return_inverse=True)[1]
    n = len(linked)
    return spanning(linked & (root[:n, None] != root[None, n:]), root if final else np.unique(nodes, return_inverse=True)[1])


def _block_links(groups: DataFrame, column: str, compare, final: bool) -> DataFrame:
    """(a, b): links that ``compare(values, values)``, a Boolean matrix, finds in each group between nodes of different roots.

    ``groups``: (group, n, apart, node, root, value).  A group is cut into blocks of about BLOCK nodes, and pairs of
    blocks are compared, at least one of which has nodes that are ``apart``.
    """
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))
    blocks = table(groups.groupBy("group", "apart", chunk.alias("chunk")).agg(F.collect_list(F.struct("node", "root", F.col(column).alias("value"))).alias("x")))
    one = blocks.where("apart").select("group", F.col("chunk").alias("c"), F.col("x").alias("xa"))
    other = blocks.select("group", "apart", F.col("chunk").alias("d"), F.col("x").alias("xb"))
    paired = one.join(other, "group").where("NOT apart OR c <= d").select("xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = batch.column("xa")[i].as_py(), batch.column("xb")[i].as_py()
                linked = compare([r["value"] for r in x], [r["value"] for r in y])
                out = between_roots(linked, *([r[c].hex() for r in (*x, *y)] for c in ("node", "root")), final)
                yield pa.RecordBatch.from_arrays([pa.array([x[k]["node"] for k, _ in out], pa.binary()), pa.array([y[j]["node"] for _, j in out], pa.binary())], ["a", "b"])

    return paired.mapInArrow(run, "a binary, b binary").distinct()


def agreement(a: list[bytes], b: list[bytes]) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(v), np.uint16).reshape(-1, BANDS * ROWS) for v in (a, b))
    return np.stack([(y == row).sum(1) >= AGREE for row in x])


def similar(a: list[str], b: list[str], weights: np.ndarray, least: float, cache: WordHashes) -> np.ndarray:
    """Which texts of ``a`` and ``b`` have a weighted Jaccard similarity of at least ``least``.

    The k-th occurrence of a shingle is an element of its own, so the sum of smaller weights is a product of matrices.
    """

    def elements(texts: list[str]):
        found = [np.sort(shingles(t, cache)) for t in texts]
        owner, h = np.repeat(np.arange(len(texts)), [len(f) for f in found]), np.concatenate(found)
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
        place = np.arange(len(h))
        number = place - np.maximum.accumulate(np.where(new, place, 0)) if len(h) else place
        w = weights[(h & np.uint64(len(weights) - 1)).astype(np.int64)].astype(np.float64)
        return mix(h + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), owner, w, np.bincount(owner, w, len(texts))

    (ea, oa, wa, ta), (eb, ob, _, tb) = elements(a), elements(b)
    shared = np.intersect1d(ea, eb)
    both = np.zeros((len(a), len(b)))
    for k in range(0, len(shared), 4096):
        part = shared[k : k + 4096]
        x, y = np.zeros((len(a), len(part))), np.zeros((len(b), len(part)))
        for m, e, o, w in ((x, ea, oa, wa), (y, eb, ob, None)):
            at = np.minimum(np.searchsorted(part, e), len(part) - 1)
            hit = part[at] == e
            m[o[hit], at[hit]] = 1.0 if w is None else w[hit]
        both += x @ y.T
    return both >= least * (ta[:, None] + tb[None, :] - both) - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, weights, least: float) -> DataFrame:
    """(a, b) of the pairs whose weighted Jaccard similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, w, last, known = WordHashes(), weights.value, None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb, keep = batch.column("text_a"), batch.column("text_b"), []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, known = a[i], weighted(ta[i].as_py(), cache, w)
                keep.append(similarity(known, weighted(tb[i].as_py(), cache, w)) >= least)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.hint("merge").join(right, "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root: smallest node of its component) for the nodes of ``edges`` (a, b), by alternating large and small stars."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = table(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = table(small.where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _texts_of(docs: DataFrame, member: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, text) of the nodes in ``member``, written once.

    Only the row with the node's first id is looked for, so copies of one text meet in different tasks and are not kept.
    """
    body = text_of(docs[text])
    texts = docs.select(node_of(body).alias("node"), docs[doc_id].alias("t_id"), body.alias("text"))
    wanted = member.select(F.col("node").alias("w_node"), "first").distinct().hint("merge")
    met = texts.join(wanted, (F.col("node") == F.col("w_node")) & F.col("t_id").eqNullSafe(F.col("first")))
    return table(met.groupBy("node").agg(F.min("text").alias("text")))


def grouped(docs: DataFrame, nodes: DataFrame, weights, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """(node, root) of the nodes that are linked to others."""
    member = _buckets(nodes)
    texts = _texts_of(docs, member, text, doc_id)
    large = member.where(F.col("n") > SMALL)
    leaders = table(_leaders(large))
    pairs = _all_pairs(member.where(F.col("n") <= SMALL)).select("a", "b", "sa", "sb").unionByName(_stars(large, leaders))
    edges = table(_verified(table(_agreeing(pairs)), texts, weights, least))
    roots = components(edges)

    of_leader = leaders.select("bucket", F.col("leader").alias("node")).join(roots, "node", "left").select("bucket", F.coalesce("root", "node").alias("home"))
    rooted = large.select(F.col("bucket"), "node", "signature", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = table(rooted.join(of_leader, "bucket").withColumn("apart", F.col("root") != F.col("home")))
    open_ = rooted.join(rooted.where("apart").select("bucket").distinct(), "bucket").withColumnRenamed("bucket", "group")
    possible = table(_block_links(open_, "signature", agreement, final=False))
    if possible.isEmpty():
        return roots
    together = components(possible).withColumnRenamed("root", "group").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shares = together.groupBy("group", "root").agg(F.count("*").alias("share"))
    homes = shares.groupBy("group").agg(F.sum("share").alias("n"), F.max_by("root", F.struct("share", "root")).alias("home"))
    group = table(together.join(homes, "group").withColumn("apart", F.col("root") != F.col("home")))
    texts_of = group.hint("merge").join(texts, "node")

    def compare(a: list[str], b: list[str]) -> np.ndarray:
        return similar(a, b, weights.value, least, WordHashes())

    return components(edges.unionByName(_block_links(texts_of, "text", compare, final=True)))


def _assigned(docs: DataFrame, text: str, doc_id: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, node, none; nodes: node, root, class_id), written to the shared folder."""
    weights = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs, text))
    signed = table(_signatures(docs, weights, text, doc_id))
    nodes = table(signed.where(F.size("keys") > 0).groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("keys").alias("keys"), F.any_value("signature").alias("signature")))
    rooted = grouped(docs, nodes, weights, text, doc_id, least)
    named = nodes.select("node", "first").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("class_id"))
    return signed.select("doc_id", "node", (F.size("keys") == 0).alias("none")), table(named.join(smallest, "root").select("node", "root", "class_id"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) per row of ``docs``: class_id is the smallest id of the row's class.

    Texts equal up to case are one class.  A text without words is similar to none: its class is its own id.
    Null ids count only where a class has no other id.  Rows may repeat.
    """
    rows, nodes = _assigned(docs, text, doc_id, least)
    return rows.join(nodes, "node", "left").select("doc_id", F.when(F.col("none"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row of each class, with the class's smallest id; texts without words all stay.

    If rows repeat that id, the smallest text digest decides, and among equal texts the smallest digest of the row.
    """
    rows, nodes = _assigned(docs, text, doc_id, least)
    first = rows.where("NOT none").join(nodes, "node").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = first.groupBy("root", "node", F.col("doc_id").alias("nd_id")).agg(F.count("*").alias("n"))
    first = table(first.groupBy("root").agg(F.min(F.struct("node", "nd_id", "n")).alias("x")).select("root", F.col("x.node").alias("nd_node"), F.col("x.nd_id").alias("nd_id"), F.col("x.n").alias("n")))
    body = text_of(F.col("row")[text])
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    blank = ~body.rlike(r"[^\x20\x09-\x0D]")
    kept = held.where(~blank).join(first, (node_of(body) == F.col("nd_node")) & F.col("row")[doc_id].eqNullSafe(F.col("nd_id")))
    if not first.where("n > 1").isEmpty():
        plain = [F.col("row")[f.name] for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
        again = kept.where("n > 1").groupBy("root").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
        kept = kept.where("n = 1").select("row").unionByName(again.select("row"))
    return held.where(blank).select("row.*").unionByName(kept.select("row.*"))
