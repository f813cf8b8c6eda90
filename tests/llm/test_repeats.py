"""Repeated bytes and phrases, archives."""

import base64
import hashlib
import random

import numpy as np
import pytest

from tagloom.llm import blocks, phrases, suffixes, warc
from tests.llm.conftest import by_id


def brute_bytes(rows):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen[s] = doc
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out


def brute_words(rows):
    first, words = {}, {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    out = {}
    for d, ws in words.items():
        gone = {i + k for i in range(len(ws) - 12) if first[tuple(ws[i : i + 13])] < d for k in range(13)}
        out[d] = (len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone))
    return out


def corpus(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["wörd", "a", "of", "the", "stone", "river", "tal", "x1", "zzz", "lamp"]
    passages = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(draw.choice(vocabulary) + str(draw.randint(0, 50)) for _ in range(draw.randint(0, 40))) for _ in range(3)]
        parts.insert(draw.randint(0, 3), draw.choice(passages)[draw.randint(0, 40) :])
        rows.append((i * 3, " ".join(parts)))
    rows += [(1000 + i, rows[draw.randint(0, 5)][1]) for i in range(20)]
    rows += [(2000, "ab" * 500), (2001, "ab" * 300 + "c" + "ab" * 200), (2002, None), (2003, ""), (2004, "same " * 400), (2005, "same " * 90), (2006, "é" * 49 + "x"), (2007, "é" * 49 + "x"), (2008, "y" * 99), (2009, "y" * 99)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8000)
    rows = corpus(seed)
    got = by_id(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    for doc, want in brute_bytes(rows).items():
        r = got[doc]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_words_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = by_id(phrases.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    for doc, want in brute_words(rows).items():
        r = got[doc]
        assert (r["n_words"], r["n_removed"], bytes(r["kept"])) == want


def test_odd_tables(odd_docs, no_docs):
    for dedup in (suffixes.dedup, phrases.dedup):
        got = dedup(odd_docs)
        assert got.count() == odd_docs.count() and got.where("doc_id IS NULL").count() == 2
        assert got.where("doc_id = 8 AND n_removed > 0").count() == 1
        assert dedup(no_docs).count() == 0


def test_multikey_order_is_a_stable_sort_by_all_columns():
    import numpy as np

    draw = np.random.default_rng(0)
    a, b, c = (draw.integers(0, n, 5000) for n in (20, 5, 3))
    assert (suffixes.multikey_order(a, b, c) == np.lexsort((c, b, a))).all()


def _hot_gram(n=40):
    """Documents that share 40 bytes in surroundings of their own, some of which come twice."""
    draw = random.Random(5)
    noise = lambda k: "".join(draw.choice("abcdefghijklmnop") for _ in range(k))
    hot = "In case of doubt the licence text rules."
    around = [(noise(90), noise(90)) for _ in range(n)]
    rows = [(i, a + hot + b) for i, (a, b) in enumerate(around)]
    rows += [(100 + i, noise(30) + around[i][0][-draw.randint(0, 90) :] + hot + around[i][1][: draw.randint(0, 90)] + noise(30)) for i in range(0, n, 2)]
    return rows


def test_a_splitter_among_equal_suffixes_loses_nothing(spark, monkeypatch):
    """Every range holds one interval of the hot gram at most, so only its neighbours know that there are more."""
    rows = _hot_gram()
    block = blocks.Block.of(blocks._row(0, [(d, t.encode()) for d, t in rows]))
    found = suffixes._anchors_of(block)
    keys = np.unique(suffixes.keys_of([found[f] for f in suffixes.ORDER]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_bytes(rows)
    assert sum(w[1] > 0 for w in want.values()) >= 8
    monkeypatch.setattr(suffixes, "splitters", lambda _, n: keys[1:])
    for crossing, same in ((suffixes.across, True), (lambda found: found.select("block", "payload").where("1 = 0"), False)):
        monkeypatch.setattr(suffixes, "across", crossing)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(docs).collect()}
        assert (got == want) == same


def test_order_beyond_the_first_token_decides(monkeypatch):
    """Suffixes with one first token: without the later tokens repeats are no neighbours and get lost."""
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab") for _ in range(140)) for _ in range(150)]
    rows = [(i, texts[i % 150]) for i in range(300)]
    packed = {k: v for k, v in blocks._row(0, [(d, t.encode()) for d, t in rows]).items() if k in ("block", "ids", "sizes", "data")}
    cut_by = lambda: {int(d) for r in _sent_bytes(suffixes._send(np.zeros(0, "S40")), [packed], ["ids"])[1] if r["bucket"] < 0 for d in blocks.unpack(r["ids"], suffixes._CUT)["doc"]}
    assert cut_by() == set(range(150, 300))
    monkeypatch.setattr(suffixes, "multikey_order", lambda *columns: np.argsort(columns[0], kind="stable"))
    assert len(cut_by()) < 150


def test_splitters_follow_the_content(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8000)
    packed = blocks.make(spark.createDataFrame(corpus(6, 400), "doc_id long, text string"))
    cuts = suffixes.splitters(packed, 8)
    assert len(cuts) == 7 and (np.sort(cuts) == cuts).all() and len(np.unique(cuts)) == 7
    keys = np.concatenate([suffixes.keys_of([a[f] for f in suffixes.ORDER]) for r in packed.collect() for a in [suffixes._firsts(suffixes._anchors_of(blocks.Block.of(r.asDict())))[0]]])
    assert np.bincount(np.searchsorted(cuts, keys, "right"), minlength=8).max() < 0.3 * len(keys)


def test_long_documents_in_pieces(spark, monkeypatch):
    rows = [(1, "".join(random.Random(9).choice("abcdef ") for _ in range(7000))), (2, "q" * 150)]
    rows.append((3, rows[0][1][1500:6000] + "!" + rows[0][1][:700]))
    block = blocks.Block.of(blocks._row(0, [(d, t.encode()) for d, t in rows]))
    monkeypatch.setattr(suffixes, "_PIECE", 1000)
    suffixes._powers.cache_clear()
    got = suffixes._anchors_of(block)
    strings = sum(int(m) + 1 for m in got["more"])
    suffixes._powers.cache_clear()
    assert strings == sum(len(t) - 99 for _, t in rows)


def test_archive_round_trip(spark):
    rows = [(i, f"http://x/{i}" if i % 3 else None, ["<p>ä\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n</p>", None, "", "b" * 5000][i % 4]) for i in range(40)] + [(None, None, "alone"), (5, "u", "b" * 5000), (5, "u", "b" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(pages).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    for r in got:
        payload = bytes(r["payload"])
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if r["page_id"] is not None:
            first = largest[payload.decode()]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
    want = sorted((i if i is not None else -1, hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((r["page_id"] if r["page_id"] is not None else -1, hashlib.sha256(bytes(r["payload"])).hexdigest()) for r in got) == want
    assert warc.archive(pages.where("1 = 0")).count() == 0


def test_urls_that_look_like_header_fields(spark):
    url = "http://registry/image@sha256:deadbeef?WARC-Type: response"
    rows = [(9, url, "one"), (1, "http://x/1", "one"), (2, url, "one"), (8, url, "other"), (3, "http://x/3", "other"), (4, url, "alone")]
    got = {r["page_id"]: (r["record_type"], bytes(r["payload"]).decode(), r["payload_bytes"]) for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("response" if i in (9, 8, 4) else "revisit", html, len(html)) for i, _, html in rows}


def test_header_without_payload_fails(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef")], "page_id long, url string, html string")
    payloads, headers = warc.store(warc.records(pages).selectExpr("header", "cast(payload AS binary) AS payload"))
    assert warc.restore(payloads, headers).count() == 3
    for restored in (warc.restore(payloads.where("payload_bytes > 3"), headers), warc.restore(payloads, headers.unionByName(headers.selectExpr("cast(NULL AS string) AS address", "header")))):
        with pytest.raises(Exception, match="no payload of"):
            restored.count()


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    kinds = sorted(r["header"].split("\r\n")[1] for r in warc.records(pages, least_bytes=5).collect())
    assert kinds == ["WARC-Type: response"] * 3 + ["WARC-Type: revisit"]


def test_more_distinct_words_than_code_points():
    many = b" ".join(b"w%d" % i for i in range(1_200_000))
    shared = many.split()[100:120]
    docs = [(1, many), (2, b"before " + b" ".join(shared) + b" behind")]
    block = blocks.Block.of(blocks._row(0, docs))
    place = (np.uint64(1) << np.uint64(32)) + np.arange(1, 9, dtype=np.uint64)
    words, removed = phrases._removed(block, [phrases._found(place, np.full(len(place), 1))])
    assert not removed[0].any() and removed[1].tolist() == [False] + [True] * 20 + [False]


def test_automata_locate_occurrences_that_were_not_confirmed(monkeypatch):
    """A block gets one place per window; parts and further occurrences are found by the automata alone."""
    passage = [b"p%d" % i for i in range(30)]
    join = lambda *parts: b" ".join(w for p in parts for w in p)
    docs = [(5, join([b"a"], passage, [b"b"])), (6, join(passage[10:25], [b"c"], passage)), (7, join([b"d", b"e"], passage[:13])), (8, join(passage[:12], [b"f"]))]
    block = blocks.Block.of(blocks._row(0, docs))
    place = np.arange(1, 19, dtype=np.uint64)
    payload = [phrases._found(place, np.full(18, 2))]
    want = [[False] + [True] * 30 + [False], [True] * 15 + [False] + [True] * 30, [False] * 2 + [True] * 13, [False] * 13]
    for size in (13, 40, 1_000_000):
        monkeypatch.setattr(phrases, "WORDS_PER_AUTOMATON", size)
        assert [r.tolist() for r in phrases._removed(block, payload)[1]] == want
    own = [phrases._found(place, np.full(18, 5))]
    assert [bool(r.any()) for r in phrases._removed(block, own)[1]] == [False, True, True, False]
    monkeypatch.setattr(phrases, "_occurrences", lambda flat, at: [(at, np.arange(len(at)))])
    assert [bool(r.any()) for r in phrases._removed(block, payload)[1]] == [True, False, False, False]


def test_codes_tell_words_apart_and_keep_to_their_borders():
    codes, length = phrases._codes(b"%d" % (i % 40_000) for i in range(50_000))
    assert length == 4 and len(set(codes.values())) == 40_000
    assert {c[0] for c in codes.values()}.isdisjoint(letter for c in codes.values() for letter in c[1:])
    assert phrases._codes(iter([b"one", b"one"])) == ({b"one": "\x01"}, 1)


def _sent_bytes(send, rows, columns):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())]))
    out = [r for b in send(iter([batch])) for r in b.to_pylist()]
    return sum(len(r[c] or b"") for r in out for c in columns), out


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_ids_sent_do_not_grow_with_ranges(kind):
    draw = random.Random(8)
    docs = [(draw.getrandbits(62), " ".join(str(draw.randrange(10**6)) for _ in range(120)).encode()) for _ in range(1500)]
    rows = [{k: v for k, v in blocks._row(3, docs).items() if k in ("block", "ids", "sizes", "data")}]
    few, many = (
        _sent_bytes(phrases._send(n) if kind == "words" else suffixes._send(np.sort(suffixes.keys_of([np.array([draw.getrandbits(62) for _ in range(n - 1)], np.uint64)] * 5))), rows, ["ids"])[0]
        for n in (10, 1000)
    )
    whole = len(rows[0]["ids"]) * 1000
    assert many < whole / 5 and many < 12 * few


def test_a_passage_is_sent_once_per_block():
    docs = [(1, b"a" * 300_000), (2, b"b" + b"0123456789" * 30_000), (3, b"x" * 50 + b"a" * 1000)]
    rows = [{k: v for k, v in blocks._row(0, docs).items() if k in ("block", "ids", "sizes", "data")}]
    _, out = _sent_bytes(suffixes._send(np.zeros(0, "S40")), rows, ["ids"])
    anchors = sum(len(blocks.unpack(r["at"], np.uint32)) for r in out if r["bucket"] >= 0)
    cuts = sum(len(blocks.unpack(r["ids"], suffixes._CUT)) for r in out if r["bucket"] < 0)
    assert anchors < 1000 and cuts > 200_000


def test_repeated_text_in_one_and_many_documents_matches_brute_force(spark):
    rows = [(1, "a" * 5000), (2, "xyz" + "a" * 400), (3, "0123456789" * 120), (4, "q" + "0123456789" * 40), (5, "a" * 120 + "b" + "a" * 120)]
    want = brute_bytes(rows)
    for n in (1, 4):
        got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == want
