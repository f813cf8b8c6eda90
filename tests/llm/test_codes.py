"""Vector codes: the two trees against plain comparison, and the whole operator on odd rows."""

import math

import numpy as np
import pytest

from tagloom.llm import codes


def plain(points, entries):
    return ((points[:, None, :] - entries[None]) ** 2).sum(2).argmin(1)


@pytest.mark.parametrize("n,k,kind", [(1, 1, "wide"), (15, 3, "wide"), (500, 16, "wide"), (700, 4, "clusters"), (300, 5, "few"), (257, 16, "same")])
def test_trees_assign_as_plain_comparison_does(n, k, kind):
    rng = np.random.default_rng(n)
    points = {
        "wide": lambda: rng.integers(-4000, 4000, (n, 8)), "clusters": lambda: rng.integers(0, 4, (n, 1)) * 3000 + rng.integers(0, 200, (n, 8)),
        "few": lambda: rng.integers(0, 2, (n, 8)), "same": lambda: np.full((n, 8), 7),
    }[kind]()
    entries = {"same": np.full((k, 8), 7), "clusters": np.arange(4)[:, None] * 3000 + np.full((4, 8), 100)}.get(kind, points[rng.integers(0, n, k)])
    tree = codes.Tree.build(points)
    found = codes.assign(tree, entries)
    want = plain(tree.points, entries)
    assert (found.entry == want).all() and sorted(tree.order) == list(range(n))
    counts, sums = codes.tally(tree, entries)
    assert (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[e] == tree.points[want == e].sum(0)).all() for e in range(k))
    if kind == "clusters":  # whole nodes are taken and most combinations never meet
        assert len(found.nodes) and found.compared < n * k / 4


def test_boxes_and_sums_of_nodes():
    points = np.random.default_rng(3).integers(-50, 50, (333, 3))
    tree = codes.Tree.build(points)
    assert (tree.points == points[tree.order]).all()
    for i, (a, b) in enumerate(tree.limits):
        mine = tree.points[a:b]
        assert (tree.low[i] == mine.min(0)).all() and (tree.high[i] == mine.max(0)).all() and (tree.sums[i] == mine.sum(0)).all()


def test_extremes_stay_within_64_bits():
    for part in (1, 8, 16, 192, 4096):
        limit = codes.limit_of(part)
        tree = codes.Tree.build(np.array([[limit] * part, [-limit] * part]), 1)
        assert codes.assign(tree, tree.points[::-1].copy()).entry.tolist() == [1, 0]
    assert codes.limit_of(8) == codes.LIMIT


def brute(rows):
    """(id, label, code, error, label_error) of every row, and the codebooks, straight from the definition."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max([len(v) for _, v, _ in kept] + [1]) // 8) * 8
    kept = [(i, [math.floor(4096 * max(-16384.0, min(16384.0, c))) for c in v] + [0] * (width - len(v)), g) for i, v, g in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    part = width // 8
    x = np.array([v for _, v, _ in kept], object).reshape(len(kept), 8, part)
    books = [x[:16, p].copy() for p in range(8)]

    def nearest(p):
        return [min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(row, books[p][e])), e)) for row in x[:, p]]

    for _ in range(6):
        for p in range(8):
            own = nearest(p)
            for e in range(len(books[p])):
                mine = [x[i, p] for i, o in enumerate(own) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [nearest(p) for p in range(8)]
    out = []
    for i, (key, _, g) in enumerate(kept):
        error = sum(int(sum((a - b) ** 2 for a, b in zip(x[i, p], books[p][final[p][i]]))) for p in range(8))
        out.append((key, g, "".join(f"{final[p][i]:02x}" for p in range(8)), error))
    totals = {}
    for _, g, _, error in out:
        totals[g] = totals.get(g, 0) + error
    return sorted(((*r, totals[r[1]]) for r in out), key=repr), [int(c) for b in books for e in b for c in e]


ODD = [(i, [math.sin(i * 3 + j) for j in range(16)], i % 3 if i % 5 else None) for i in range(60)] + [
    (100, None, 1), (101, [1.0, None], 2), (102, [float("nan")] * 16, 1), (103, [float("inf")] * 16, 1), (104, [], 1), (105, [0.5], None),
    (None, [0.25] * 16, 2), (5, [0.25] * 16, 2), (5, [0.25] * 16, 2), (106, [3e38] * 16, 7), (107, [-3e38] * 13, 7),
]


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({c: F.lit(7) for c in ("v", "v_id", "code", "n", "p", "error", "label_error")})


def found(df):
    return sorted((tuple(r[c] for c in ("v_id", "v_label", "code", "error", "label_error")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("take", [5, len(ODD)])
def test_codes_of_odd_rows_match_brute_force(spark, take):
    got = codes.encode(frame(spark, ODD[:take]).repartition(3))
    want, books = brute(ODD[:take])
    assert found(got) == want and got.first()["codebooks"] == books


def test_no_vectors_give_no_codes(spark):
    for rows in ([], [(1, None, 1), (2, [None], 1)]):
        got = codes.encode(frame(spark, rows))
        assert got.columns == ["v_id", "v_label", "code", "error", "label_error", "codebooks"] and got.count() == 0


def test_label_sums_without_a_broadcast_of_all_labels(spark):
    coded = spark.range(50).selectExpr("id AS v_id", "CASE WHEN id % 7 > 0 THEN id % 7 % 4 END AS v_label", "'00' AS code", "id * id AS error")
    split = codes.with_label_error(coded, labels=1, hot=10)
    assert found(split) == found(codes.with_label_error(coded))
