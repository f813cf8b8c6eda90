"""Near duplicates, decontamination and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import decontaminate, near
from tagloom.llm.common import WordHashes
from tests.conftest import DATA
from tests.llm.conftest import by_id


def brute_classes(rows, weights, least=near.SIMILARITY):
    cache = WordHashes()
    sets = [(d, near.weighted(t or "", cache, weights)) for d, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i][1][0]) and len(sets[j][1][0]) and near.similarity(sets[i][1], sets[j][1]) >= least:
                parent[root(i)] = root(j)
    classes = {}
    for i, (d, _) in enumerate(sets):
        classes.setdefault(root(i), []).append(d)
    return {d: min(ds) for ds in classes.values() for d in ds}


def family(seed, n, words, edits, first):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 5000)}" for _ in range(words)]
    out = [(first, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(words)] = f"e{draw.randint(0, 10**9)}"
        out.append((first + i, " ".join(w)))
    return out


def test_classes_match_brute_force(spark):
    rows = [r for k in range(12) for r in family(k, 8, 150, 3, 100 * k)] + [(5000 + i, " ".join(f"u{i}_{j}" for j in range(60))) for i in range(40)]
    rows += family(77, 60, 400, 6, 9000) + [(20_000, None), (20_001, ""), (20_002, "one two"), (20_003, "One  TWO"), (20_004, "three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {d: r["class_id"] for d, r in by_id(near.classes(docs)).items()}
    want = brute_classes(rows, near.document_frequencies(docs))
    want |= {20_003: 20_002, 20_002: 20_002}
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    assert len(pairs) > 400 and sum(got[a] == got[b] for a, b in pairs) / len(pairs) > 0.99
    assert not [(a, b) for a in got for b in got if a < b and got[a] == got[b] and want[a] != want[b]]


def test_hub_with_spokes_that_are_not_similar_to_each_other(spark):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        w = list(base)
        at = draw.randrange(0, 183)
        w[at : at + 12] = [f"x{i}_{k}" for k in range(12)]
        rows.append((i if i < 30 else 1000 + i, " ".join(w)))
    got = by_id(near.classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert np.mean([r["class_id"] == 0 for r in got.values()]) > 0.95


def test_blocks_compare_like_pairs():
    weights, cache = np.random.default_rng(0).uniform(0.5, 1, near.SLOTS).astype(np.float32), WordHashes()
    texts = [t for k in range(3) for _, t in family(k, 12, 80, 8, 0)] + ["", "one", "a a a a a a a a a b", "a a a a a a a a a"]
    sets = [near.weighted(t, cache, weights) for t in texts]
    want = np.array([[len(x[0]) > 0 and near.similarity(x, y) >= 0.5 for y in sets] for x in sets])
    got = near.similar(texts, texts, weights, 0.5, cache)
    got[36], got[:, 36] = False, False  # a text without words never gets here
    assert (got == want).all() and want.sum() > len(texts)


def test_spanning_links():
    links = np.array([[1, 1, 0], [0, 1, 1], [0, 0, 1]], bool)
    assert len(near.spanning(links, np.arange(6))) == 5 and near.spanning(links, np.zeros(6, int)) == []


def test_unverified_links_keep_every_node():
    """Nodes a and b of one root may both be similar to c: the one that is must be looked at, whatever the order."""
    links = np.array([[1], [1]], bool)
    for order in (["a", "b"], ["b", "a"]):
        nodes, roots = [*order, "c"], ["r", "r", "c"]
        assert near.between_roots(links, nodes, roots, final=False) == [(0, 0), (1, 0)]
        assert near.between_roots(links, nodes, roots, final=True) == [(0, 0)]
    assert near.between_roots(np.ones((2, 2), bool), ["a", "b", "a", "b"], ["r"] * 4, final=False) == []


def test_dense_group_without_a_hub(spark):
    """A chain of texts: each is similar to its neighbours only."""
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 160])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows, near.document_frequencies(docs))
    got = {d: r["class_id"] for d, r in by_id(near.classes(docs)).items()}
    assert np.mean([got[d] == want[d] for d in want]) > 0.97


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, k) for k in range(101, 160)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r["node"][0]: r["root"][0] for r in near.components(df).collect()}
    assert all(got[i] == i - i % 10 for i in range(40)) and all(got[k] == 100 for k in range(100, 160))


def test_consistent_samples_estimate_similarity():
    draw = np.random.default_rng(1)
    sampler, found = near.Sampler(), np.unique(draw.integers(0, 1 << 63, 3000, np.uint64))
    x = draw.uniform(0.5, 3, len(found)).astype(np.float32)
    y = x * draw.uniform(0.8, 1.25, len(found)).astype(np.float32)
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    hits = np.mean([np.mean(sampler.sample(found[k::10], x[k::10]) == sampler.sample(found[k::10], y[k::10])) for k in range(10)])
    assert abs(hits - true) < 0.1


def test_one_row_of_each_class_stays(spark, odd_docs, no_docs):
    kept = near.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 1").count() == 1
    assert kept.where("length(text) > 1000").count() == 1 and kept.where("trim(coalesce(text, '')) = ''").count() == 3
    assert near.keep_one(no_docs).count() == 0 and near.classes(no_docs).count() == 0
    assert near.classes(odd_docs).count() == odd_docs.count()


def edit_distance(item, text):
    """Smallest distance of ``item`` to any stretch of ``text``."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != w)))
        row = new
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_bit_parallel_distance(seed):
    draw = random.Random(seed)
    item = [draw.choice("abcd") for _ in range(draw.randint(1, 90))]
    text = [draw.choice("abcd") for _ in range(draw.randint(0, 200))]
    assert decontaminate.best_match(item, text)[0] == edit_distance(item, text)


def test_matches_match_brute_force(spark):
    draw = random.Random(8)
    items = [(i, " ".join(f"q{draw.randint(0, 30)}" for _ in range(draw.randint(3, 50)))) for i in range(25)] + [(90, None), (91, "..."), (None, "odd one item without id")]
    rows = []
    for i in range(150):
        w = [f"q{draw.randint(0, 30)}" for _ in range(60)]
        item = decontaminate.words(items[draw.randrange(25)][1])
        for _ in range(draw.randint(0, 6)):
            item[draw.randrange(len(item))] = "Zz"
        rows.append((i, " ".join(w + item + w[:20]).upper() + "!"))
    rows += [(1000, None), (1001, "")]
    got = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for d, t in rows:
        for i, x in items:
            w = decontaminate.words(x or "")
            if w and (e := edit_distance(w, decontaminate.words(t or ""))) <= decontaminate.budget(len(w)):
                want[d, i] = e
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want and len(want) > 50


def test_items_in_blocks_find_the_same(spark, odd_docs, no_docs, monkeypatch):
    docs, items = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.find(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    assert whole and sorted(map(tuple, decontaminate.find(docs, items).collect())) == whole
    hit = {r[0] for r in whole}
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {r["doc_id"] for r in docs.collect()} - hit
    assert decontaminate.clean(odd_docs, items).count() == odd_docs.count() and decontaminate.clean(no_docs, items).count() == 0
    assert decontaminate.clean(docs, items.where("1 = 0")).count() == docs.count()


def test_pipeline_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs_out = stage(spark, docs, DATA)
            assert set(docs.columns) <= set(docs_out.columns) or name == "mixture"
            docs_out.collect()


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    assert got and len({r["doc_id"] for r in got}) == len(got) and all(0 < r["taken"] <= 2 * r["size"] for r in got)
