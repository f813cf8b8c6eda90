"""Repeated phrases: confirm recurring passages, then locate them with sharded Aho-Corasick automata.

A window is 13 consecutive words of one document.  Blocks send each distinct window once: its hash,
its first and last document and the place where it starts first.  Grouping by hash range confirms
the windows that more than one document holds and finds their first document.  Blocks get back
the one place of each of their confirmed windows, no hashes.  The words at these places make passages,
which are cut into pieces of seven words: every window of a passage holds one piece, so a part of a passage is found
too.  The pieces are compiled into automata over words, all documents of the block stream through them, and
around a hit the windows are compared.  Only this tells where else in the block a window occurs.  A shard holds
at most ``WORDS_PER_AUTOMATON`` words of pieces and codes its own words.  Passages go to the blocks that
hold them, so the work grows with the corpus, not with its square.

Whether a window recurs in another block is decided by 64-bit hashes of its words, so two of n distinct windows are
taken for equal with a probability of about n**2 / 2**65; within a block words are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import blocks as B
from tagloom.llm.common import WordHashes, shuffle_partitions, windows_of

WINDOW = 13
#: Words of a piece: of the pieces of a passage, laid end to end, every window holds one.
PIECE = (WINDOW + 1) // 2
#: Windows that one grouping task holds, about; and the words of the pieces of one automaton.
WINDOWS_PER_TASK, WORDS_PER_AUTOMATON = 4_000_000, 1_000_000


def _windows(block: B.Block, cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place in it) of each window."""
    hashes = [windows_of(cache.of(t.split()), WINDOW) for t in block.texts()]
    sizes = np.array([len(h) for h in hashes], np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), doc, place


_SENT = "bucket int, block long, ids binary, hashes binary, first binary, spread binary, place binary"


def _send(n_buckets: int):
    """Blocks -> (bucket, block, payload): the distinct windows of a hash range with their first place and last document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        cuts = np.array([(k << 64) // n_buckets for k in range(1, n_buckets)], np.uint64)
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *[(f, pa.binary()) for f in ("ids", "hashes", "first", "spread", "place")]])
        for batch in batches:
            for row in batch.to_pylist():
                block = B.Block.of(row)
                hashes, doc, place = _windows(block, cache)
                if not len(hashes):
                    continue
                order = np.argsort(hashes, kind="stable")  # documents ascend by id, so the first of equal ones is the smallest
                hashes, doc, place = hashes[order], doc[order].astype(np.uint32), place[order].astype(np.uint32)
                head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                first, last = doc[head], doc[np.concatenate([head[1:], [len(hashes)]]) - 1]
                hashes, spread, place = hashes[head], last - first, place[head]
                at = np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])
                # a row carries the ids of its own windows, so that what a block sends does not grow with the number of ranges
                own = lambda a, b: B.pack_sorted(block.ids[np.unique([first[a:b], last[a:b]])].view(np.uint64))
                yield pa.RecordBatch.from_pylist([
                    {"bucket": k, "block": row["block"], "ids": own(a, b), "hashes": B.pack_sorted(hashes[a:b]), "first": B.pack(first[a:b]), "spread": B.pack(spread[a:b]), "place": B.pack(place[a:b])}
                    for k, (a, b) in enumerate(zip(at, at[1:])) if a < b
                ], schema)

    return run


def _confirm(pdf: pd.DataFrame) -> pd.DataFrame:
    """One hash range: for each block the places of windows that also occur in a document before one of the block's."""
    hashes, first, last, place, source = [], [], [], [], []
    for i, row in enumerate(pdf.itertuples()):
        ids = B.unpack_sorted(row.ids).view(np.int64)
        lo = B.unpack(row.first, np.uint32)
        at = np.unique([lo, lo + B.unpack(row.spread, np.uint32)], return_inverse=True)[1].reshape(2, -1)
        hashes.append(B.unpack_sorted(row.hashes))
        first.append(ids[at[0]])
        last.append(ids[at[1]])
        place.append(lo.astype(np.uint64) << np.uint64(32) | B.unpack(row.place, np.uint32))
        source.append(np.full(len(lo), i, np.int32))
    hashes, first, last, place, source = map(np.concatenate, (hashes, first, last, place, source))
    order = np.argsort(hashes, kind="stable")
    hashes, first, last, place, source = hashes[order], first[order], last[order], place[order], source[order]
    head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    least = np.repeat(np.minimum.reduceat(first, head), np.diff(np.concatenate([head, [len(hashes)]])))
    hit = last > least
    place, least, source = place[hit], least[hit], source[hit]
    order = np.lexsort((place, source))
    at = np.searchsorted(source[order], np.arange(len(pdf) + 1))
    out = [(pdf["block"].iat[i], order[a:b]) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]
    return pd.DataFrame({"block": [k for k, _ in out], "payload": [_found(place[o], least[o]) for _, o in out]}).astype({"block": "int64"})


def _found(place: np.ndarray, least: np.ndarray) -> bytes:
    """Ascending places (document in the high half, word in the low one) and the first document of the window there."""
    head = B.pack_sorted(place)
    return len(head).to_bytes(4, "little") + head + B.pack(least)


def recurring(blocks: DataFrame) -> DataFrame:
    """(block, payload): one place in the block of each window that recurs, with the id of its first document."""
    spark = blocks.sparkSession
    n = max(shuffle_partitions(spark), B.total_bytes(blocks) // (6 * WINDOWS_PER_TASK))
    sent = blocks.select("block", "ids", "sizes", "data").mapInArrow(_send(n), _SENT)
    return sent.groupBy("bucket").applyInPandas(_confirm, "block long, payload binary")


def _codes(words: Iterator[bytes]) -> tuple[dict[bytes, str], int]:
    """A code of equal length for every distinct word, and that length.

    Nodes of an automaton search their children one by one, so a code has a few letters of 32, not one of
    thousands.  Its first letter is never one of its others: a key matches whole words only.
    """
    numbers: dict[bytes, int] = {}
    for w in words:
        numbers.setdefault(w, len(numbers))
    length = 1
    while 32**length < len(numbers):
        length += 1
    letters = lambda n: chr(1 + n % 32) + "".join(chr(33 + (n >> 5 * k) % 32) for k in range(1, length))
    return {w: letters(n) for w, n in numbers.items()}, length


def _occurrences(flat: list[bytes], at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, which): every place of ``flat`` where the words of the window at ``at[which]`` stand, a shard at a time.

    The windows at ``at`` ascend and differ from each other.  A run of them is a passage, cut into pieces of ``PIECE`` words
    such that each window holds one as a whole.  Around the hits of the pieces windows are compared word by word.
    Words of no key, and the gap between documents, are runs of the letter 0.
    """
    run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    into = np.arange(len(at)) - np.repeat(run, np.diff([*run, len(at)]))  # place of a window in its run
    first = np.flatnonzero(into % PIECE == 0)  # windows from one of these to the next share a piece
    for a in range(0, len(first), per := max(WORDS_PER_AUTOMATON // PIECE, 1)):
        low, high = first[a], first[a + per] if a + per < len(first) else len(at)
        keys, pieces = at[low:high], at[first[a : a + per]] + WINDOW - PIECE
        codes, length = _codes(flat[i] for i in np.unique(keys[:, None] + np.arange(WINDOW)).tolist())
        other = "\0" * length
        line = "".join([codes.get(w, other) for w in flat])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in (pieces * length).tolist():
            automaton.add_word(line[p : p + PIECE * length])
        automaton.make_automaton()
        hits = np.fromiter((end for end, _ in automaton.iter(line)), np.int64) // length + 1 - PIECE
        near = np.zeros(len(flat) + 1, np.int32)
        np.add.at(near, np.maximum(hits - (WINDOW - PIECE), 0), 1)
        near[hits + 1] -= 1
        starts, width = np.flatnonzero(np.cumsum(near) > 0), WINDOW * length
        window = {line[p : p + width]: which for which, p in enumerate((keys * length).tolist(), int(low))}
        which = np.fromiter((window.get(line[p : p + width], -1) for p in (starts * length).tolist()), np.int64, len(starts))
        yield starts[which >= 0], which[which >= 0]


def _removed(block: B.Block, payloads: list[bytes] | None) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """(words, removed flag per word) of each document of the block."""
    words = [t.split() for t in block.texts()]
    if not payloads:
        return words, [np.zeros(len(w), bool) for w in words]
    parts = [(B.unpack_sorted(p[4 : 4 + (n := int.from_bytes(p[:4], "little"))]), B.unpack(p[4 + n :], np.int64)) for p in payloads]
    place, least = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    flat = [w for ws in words for w in (*ws, b"")]  # no word is empty, so this one keeps documents apart
    starts = np.cumsum([0, *[len(ws) + 1 for ws in words]])
    at = starts[(place >> np.uint64(32)).astype(np.int64)] + (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(at)  # neighbours share words, so a shard has few
    covers = np.zeros(len(flat) + 1, np.int32)
    for where, which in _occurrences(flat, at[order]):
        own = block.ids[np.searchsorted(starts, where, "right") - 1]
        where = where[least[order[which]] < own]
        covers[where] += 1  # a place holds one window, so no place comes twice
        covers[where + WINDOW] -= 1
    removed = np.cumsum(covers) > 0
    return words, [removed[a : a + len(ws)] for a, ws in zip(starts.tolist(), words)]


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept: binary, kept words joined by one space) per row of ``docs``.

    A word is removed if a window that covers it also starts in a document with a smaller id.
    Null texts have no words.  Null ids count as larger than all others; rows with one id are
    not before each other, so among themselves they remove nothing.
    """
    packed = B.make(docs, text, doc_id)
    both = B.with_payloads(packed, recurring(packed)).select("ids", "sizes", "data", "payloads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = B.Block.of(row)
                words, removed = _removed(block, row["payloads"])
                kept = [b" ".join(np.array(w, object)[~r].tolist() if r.any() else w) for w, r in zip(words, removed)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.ids, pa.int64(), mask=block.null), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([int(r.sum()) for r in removed], pa.int64()), pa.array(kept, pa.binary()),
                ], ["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
