"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may occur with up to ``floor(m * ERRORS)`` word edits.  Split into one piece more than
that budget, at least one piece occurs unchanged.  An Aho-Corasick automaton finds piece hits, and
Myers' bit-parallel distance verifies the stretch of text around each hit.

Items are taken in blocks of bounded size, each one broadcast; every block meets every document,
so a larger benchmark means more passes over the documents and never a larger broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import text_of

ERRORS = 0.1
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, lower case."""
    return _WORD.findall(text.lower())


def budget(n_words: int, errors: float = ERRORS) -> int:
    return int(n_words * errors + 1e-9)


def pieces(item: list[str], k: int) -> list[tuple[int, list[str]]]:
    """(first word, words) of ``k + 1`` pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: list[str], text: list[str]) -> tuple[int, int]:
    """(distance, end) of the stretch of ``text`` with the smallest edit distance to ``item``; the earliest end on ties.

    Myers' algorithm: bit i of the vectors stands for word i of the item, and a stretch may start anywhere.
    """
    m = len(item)
    masks: dict[str, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(horizontal | plus)) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full  # without a carried-in error: stretches start anywhere
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[object, str]], errors: float):
        self.items = [(i, words(t)) for i, t in items]
        self.budgets = [budget(len(w), errors) for _, w in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, w) in enumerate(self.items):
            for at, piece in pieces(w, self.budgets[n]) if w else []:
                places.setdefault(f" {' '.join(piece)} ", []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, distance, first word, end word) of the best match of each item within its budget."""
        if self.empty:
            return []
        found = words(text)
        line = f" {' '.join(found)} "
        windows: dict[int, set[tuple[int, int]]] = {}
        at, counted = 0, 0
        for end, (length, places) in self.automaton.iter(line):
            start = end + 1 - length
            if start >= counted:
                at, counted = at + line.count(" ", counted, start), start
                word = at
            else:  # pieces that end later may start earlier
                word = at - line.count(" ", start, counted)
            for n, offset in places:
                k, m = self.budgets[n], len(self.items[n][1])
                windows.setdefault(n, set()).add((max(0, word - offset - k), min(len(found), word - offset + m + k)))
        out = []
        for n, spans in sorted(windows.items()):
            item_id, item = self.items[n]
            best = None
            for a, b in sorted(spans):
                distance, end = best_match(item, found[a:b])
                if distance <= self.budgets[n] and (best is None or distance < best[0]):
                    back, length = best_match(item[::-1], found[a : a + end][::-1])
                    best = (distance, a + end - length, a + end) if back == distance else (distance, a, a + end)
            if best:
                out.append((item_id, *best))
        return out


def _by_block(docs: DataFrame, benchmark: DataFrame, errors: float, searched, combine) -> DataFrame:
    """``searched(docs, items)`` for each block of items, folded by ``combine``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // BLOCK_CHARS))
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()  # BLOCK_CHARS in all, about
        sent = docs.sparkSession.sparkContext.broadcast(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        docs = combine(docs, searched(docs, sent, errors))
    return docs


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", errors: float = ERRORS) -> DataFrame:
    """(doc_id, item_id, distance, start, end in words): the best match of each item in each row that contains it.

    Letters and digits count, case and punctuation do not.  Null texts match nothing, items without words are
    not searched, items that repeat are separate items, rows may repeat.
    """
    slim = docs.select(docs[doc_id].alias("doc_id"), text_of(docs[text]).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    found: list[DataFrame] = []

    def searched(_, sent, errors):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, errors)
            for batch in batches:
                hits = [[dict(zip(("item_id", "distance", "start", "end"), h)) for h in matcher.search(t)] for t in batch.column("text").to_pylist()]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hits, _HITS)], ["doc_id", "hits"])
                yield out.filter(pa.array([bool(h) for h in hits], pa.bool_()))

        return slim.mapInArrow(run, f"doc_id {kind}, hits array<struct<item_id: bigint, distance: int, start: int, end: int>>")

    _by_block(slim, benchmark, errors, searched, lambda docs, more: found.append(more) or docs)
    return reduce(DataFrame.unionByName, found).select("doc_id", F.inline("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""

    def searched(docs, sent, errors):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, errors)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

        at = docs.columns.index(text)
        return docs.mapInArrow(run, docs.schema)

    return _by_block(docs, benchmark, errors, searched, lambda _, kept: kept)
