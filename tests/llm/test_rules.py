"""Quality rules, line dedup and mixing."""

import collections
import re

import pytest

from tagloom.llm import lines, mixing, quality
from tests.conftest import DATA
from tests.llm.conftest import by_id

WORD = re.compile(r"[^ \t-\r]+")


def brute_metrics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered)


def test_metrics_match_brute_force(spark, odd_docs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    for r in quality.judge(docs).select("row.text", "metrics.*", "kept", "failed").collect():
        want = brute_metrics(r["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert not r["kept"] or (want[0] >= 10 and 100 * want[4] <= 20 * want[0])
        assert r["kept"] == (not r["failed"])


def test_kept_rows_keep_their_columns(odd_docs, no_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 1").count() == 2
    assert quality.keep_good(no_docs).count() == 0


def test_clean_documents_stay(spark):
    docs, labels = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    rows = quality.judge(docs.join(labels, "doc_id")).where("row.quality = 1 AND metrics.n_words >= 10 AND NOT array_contains(failed, 'repeated_windows')")
    assert rows.where("kept").count() / rows.count() > 0.98


def brute_boilerplate(rows, sites, contexts):
    where, around, n = collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
    for _, text, site in rows:
        ls = [x.strip(" \t\n\x0b\f\r") for x in (text or "").split("\n")]
        for i, x in enumerate(ls):
            if x:
                where[x].add(site or "")
                around[x].add((ls[i - 1] if i else None, ls[i + 1] if i + 1 < len(ls) else None))
                n[x] += 1
    return {x for x in n if len(where[x]) >= sites and len(around[x]) >= contexts * n[x]}


@pytest.mark.parametrize("sites", [3, 10])
def test_lines_match_brute_force(spark, sites):
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    gone = brute_boilerplate(docs.select("doc_id", "text", "source").collect(), sites, lines.CONTEXTS)
    got = by_id(lines.drop_boilerplate(docs, sites=sites).selectExpr("row.doc_id AS doc_id", "row.text AS text", "l_text", "l_removed"))
    assert gone and sum(r["l_removed"] for r in got.values()) > 0
    for r in got.values():
        assert r["l_text"] == "\n".join(x for x in r["text"].split("\n") if x.strip(" \t\n\x0b\f\r") not in gone)


def test_copies_on_many_sites_keep_their_lines(spark):
    rows = [(i, f"first line of the copy\nsecond line of the copy\nshared notice {'' if i % 2 else ''}", f"s{i % 12}") for i in range(60)]
    rows += [(100 + i, f"own line {i}\nshared notice", f"s{i % 12}") for i in range(240)]
    got = by_id(lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).selectExpr("row.doc_id AS doc_id", "l_text"))
    assert got[0]["l_text"].startswith("first line of the copy\nsecond line of the copy")
    assert got[100]["l_text"] == "own line 0"


def test_lines_of_odd_tables(odd_docs, no_docs):
    got = lines.drop_boilerplate(odd_docs)
    assert got.count() == odd_docs.count() and got.where("row.text IS NULL AND l_text IS NULL").count() == 2
    assert lines.drop_boilerplate(no_docs).count() == 0


def brute_targets(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_matches_targets(spark, odd_docs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    got = mixing.mix(docs).selectExpr("row.source AS source", "row.text AS text", "size", "source_size", "target", "taken").collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = brute_targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-3)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_mix_repeats_and_empty(odd_docs, no_docs):
    one, two = (sorted(map(tuple, mixing.mix(odd_docs).selectExpr("row.text", "size", "taken").na.fill("").collect())) for _ in range(2))
    assert one == two and mixing.mix(no_docs).count() == 0


def test_better_documents_come_first_more_often(spark):
    rows = [(i, "word " * 20 if i % 2 else "w#### " * 20, s) for i in range(2000) for s in ("a",)] + [(5000 + i, "word " * 2000, "b") for i in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("row.source = 'b' OR taken > 0").selectExpr("row.doc_id AS doc_id", "taken", "size").collect()
    assert got and all(r["taken"] <= 2 * r["size"] for r in got)


def test_budgets_reach_rows_in_both_ways(odd_docs):
    from pyspark.sql import functions as F

    rows = odd_docs.select(F.col("source").isNull().alias("m_none"), F.coalesce("source", F.lit("")).alias("m_name"), F.rand(3).alias("m_key"), F.lit(1).alias("m_tie"), "doc_id")
    ends = rows.groupBy("m_none", "m_name").agg(F.count(F.lit(1)).alias("m_total"))
    one, other = (sorted(map(repr, mixing.with_budgets(rows, ends, b).select("doc_id", "m_name", "m_total").collect())) for b in (1 << 20, 0))
    assert one == other and len(one) == odd_docs.count()
