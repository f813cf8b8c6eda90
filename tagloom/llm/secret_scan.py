"""Secrets in texts: rules are looked up in a trigram inverted index before they are run.

Every batch of documents is one index segment.  The segment's postings hold, for each
trigram that some rule asks for, the documents that contain it.  A rule's Boolean query
is derived from its regular expression; intersecting and uniting postings gives the
candidates, and only those are searched with the expression itself.  Rules without a
mandatory trigram search every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as _op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.common import SPANS, text_of

ANY = True
_MOST_STRINGS = 64
_INDEX_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``group`` must be ``least`` characters long, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    # No rule has an upper length.  Segments are taken whole and not given back, and a first segment of "jwt" without the
    # others is a match to drop, so that no later "eyJ" of the same segment is tried: time is linear in the text.
    # Longer runs than the least length match the same with a counted repeat, and shorter ones fail at once.
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+(\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,})?", 1),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"://[^\s/:@]++:[^\s/:@]{3,}+@"),
)


# Boolean trigram queries -----------------------------------------------------------------------------------------


def _all(queries):
    rest = [q for q in queries if q is not ANY]
    return ANY if not rest else rest[0] if len(rest) == 1 else ("and", tuple(rest))


def _one(queries):
    queries = list(dict.fromkeys(queries))
    return ANY if not queries or any(q is ANY for q in queries) else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _query_of_strings(strings):
    return _one([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(op, arg):
    """The few strings that an element can match, lower case, or None."""
    if op is _op.LITERAL and arg < 128:
        return {chr(arg).lower()}
    if op is _op.IN and len(arg) <= 4 and all(o is _op.LITERAL and a < 128 for o, a in arg):
        return {chr(a).lower() for _, a in arg}
    if op in (_op.MAX_REPEAT, _op.MIN_REPEAT) and arg[1] == 1:
        inner = _strings_of_sequence(arg[2])
        return inner if inner is None or arg[0] else inner | {""}
    if op is _op.SUBPATTERN:
        return _strings_of_sequence(arg[-1])
    if op is _op.BRANCH:
        parts = [_strings_of_sequence(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    return None


def _strings_of_sequence(items):
    out = {""}
    for op, arg in items:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _query_of_sequence(items):
    queries, run = [], {""}
    for op, arg in items:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = {a + b for a, b in product(run, more)}
            continue
        queries.append(_query_of_strings(run))
        run = {""}
        if more is not None:
            run = more
        elif op is _op.SUBPATTERN:
            queries.append(_query_of_sequence(arg[-1]))
        elif op is _op.BRANCH:
            queries.append(_one([_query_of_sequence(p) for p in arg[1]]))
        elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT) and arg[0] >= 1:
            queries.append(_query_of_sequence(arg[2]))
    return _all([*queries, _query_of_strings(run)])


def trigram_query(pattern: str):
    """What every text that ``pattern`` matches must contain, on lower-case text: a trigram, ("and"|"or", parts), or ANY."""
    return _query_of_sequence(_parser.parse(pattern))


def trigrams_in(query) -> set[str]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


# Index segments --------------------------------------------------------------------------------------------------

_LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class Segment:
    """Postings of the wanted trigrams over a list of texts (bytes)."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        self.size, pairs = len(texts), []
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end]) <= _INDEX_BYTES):
                held += len(texts[end]) + 2
                end += 1
            pairs.append(self._pairs(texts[start:end], start, wanted))
            start = end
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        codes = found >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(codes)) + 1
        self.postings = {int(part[0] >> np.uint64(32)): (part & np.uint64(0xFFFFFFFF)).astype(np.int64) for part in np.split(found, cuts) if len(part)}

    @staticmethod
    def _pairs(texts: list[bytes], first: int, wanted: np.ndarray) -> np.ndarray:
        data = _LOWER[np.frombuffer(b"\0\0".join([*texts, b""]), np.uint8)].astype(np.uint32)
        if len(data) < 3:
            return np.zeros(0, np.uint64)
        codes = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
        at = np.flatnonzero(wanted[codes])
        ends = np.cumsum([len(t) + 2 for t in texts])
        doc = np.searchsorted(ends, at, "right") + first
        return np.unique(codes[at].astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64))

    def find(self, query) -> np.ndarray:
        if query is ANY:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings.get(_code(query), np.zeros(0, np.int64))
        parts = [self.find(q) for q in query[1]]
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)


def find_spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[dict]]:
    """The spans of every text, by way of one index segment."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = np.zeros(1 << 24, bool)
    wanted[[_code(t) for q in queries for t in trigrams_in(q)]] = True
    return _find(texts, rules, queries, wanted)


def _find(texts, rules, queries, wanted):
    segment = Segment([t.encode() for t in texts], wanted)
    out: list[list[dict]] = [[] for _ in texts]
    for rank, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        search = re.compile(rule.pattern).finditer
        for i in segment.find(query).tolist():
            for m in search(texts[i]):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    out[i].append({"rank": rank, "kind": rule.kind, "start": m.start(), "end": m.end(), "base": rule.base})
    return out


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) per row of ``docs``: whole texts, code points, end exclusive, no shuffle.

    Leftmost non-overlapping matches per rule; a match whose group is too short is dropped
    and not tried again.  Null and empty texts have no spans; rows may repeat.
    """
    slim = docs.select(docs[doc_id].alias("doc_id"), text_of(docs[text]).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        wanted = np.zeros(1 << 24, bool)
        wanted[[_code(t) for q in queries for t in trigrams_in(q)]] = True
        for batch in batches:
            spans = _find(batch.column("text").to_pylist(), rules, queries, wanted)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return slim.mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


_SPANS = pa.list_(pa.struct([("rank", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
