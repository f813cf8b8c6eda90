"""Repeated byte strings from a sparse suffix array, built in range partitions.

A string is ``LENGTH`` consecutive bytes of one document.  Suffixes are taken at anchors only:
the anchor of a string is the leftmost smallest hash among its grams of ``GRAM`` bytes, so equal
strings have their anchor at the same place, and about one byte in 35 is an anchor.  Strings that share an
anchor are neighbours; what they span together is the anchor's interval.

1. Blocks send each anchor with the first ``GRAM`` bytes of its suffix, as four tokens of eight bytes.  Splitters from
   a sample of anchors cut the suffixes into ranges of content.  A range is sorted by multikey
   quicksort: by the first token, ties by the next one, suffixes equal in all tokens by the hash of the interval.
   Neighbours with equal intervals are repeats as a whole; only the first keeps its bytes.  Neighbours
   with equal tokens but different intervals differ somewhere inside: the first of each such interval is an edge.
   A splitter may fall among suffixes with equal tokens.  Then the last suffix of a range and the first of the
   next are compared, and an interval that looked single on its side of the splitter becomes an edge.
2. Edges send their bytes, to be compared string by string.  A string reaches ``HALF`` bytes beyond the gram on one
   side at least, so edges meet by these bytes and the gram, once per side, and hot grams are divided by what is around them.
3. Blocks turn what was found into removed byte ranges.

Hot strings are met once per block and interval, never once per occurrence.  Whole intervals are compared by
64-bit hashes, strings of edges by hash and then by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm import blocks as B
from tagloom.llm.common import mix, shuffle_partitions, table

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
#: Anchors of one range, about; anchors sampled per block in slices of some bytes, and per splitter about.
ANCHORS_PER_RANGE, SAMPLE, SLICE, PER_SPLITTER = 1_000_000, 64, 1 << 12, 200
_PIECE = 1 << 21
#: Bytes beside the gram that edges have in common, and the bytes an edge sends per side.
HALF = REACH // 2
_WIDTH = LENGTH + HALF
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE + LENGTH + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling."""
    values, step = _BYTES[data], 1
    while step < GRAM:
        values = values[:-step] * _power(step) + values[step:]
        step *= 2
    return mix(values)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of each maximal run of strings of ``data`` with one anchor."""
    n = len(data) - LENGTH + 1
    gram = grams(data)
    best = gram & np.uint64(0xFFFFFFFF00000000) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= REACH + 1:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    rest = REACH + 1 - span
    best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at = at[head]
    return at, head, np.concatenate([head[1:], [n]]) - 1


def tokens_at(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The gram at each place as big-endian numbers, which order as their bytes do."""
    out = []
    for first in range(0, GRAM, 8):
        token = np.zeros(len(at), np.uint64)
        for k in range(first, first + 8):
            token = token << np.uint64(8) | data[at + k].astype(np.uint64)
        out.append(token)
    return out


TOKENS = tuple(f"t{k}" for k in range(GRAM // 8))
ORDER = (*TOKENS, "whole")
KINDS = dict.fromkeys(ORDER, np.uint64) | {"doc": np.uint32, "at": np.uint32, "before": np.uint8, "more": np.uint8}
FIELDS = tuple(KINDS)


def _anchors_of(block: B.Block) -> dict[str, np.ndarray]:
    """Of all anchors: tokens, interval hash, document, place in it, bytes of the interval before it, strings after the first."""
    data, starts, parts = np.frombuffer(block.data, np.uint8), block.starts.tolist(), []
    up, down = _powers(int(_BASE)), _powers(int(_INVERSE))
    for d in range(len(block.sizes)):
        a, b = starts[d], starts[d + 1]
        for p in range(a, b - LENGTH + 1, _PIECE):  # long documents in pieces that overlap by a string
            piece = data[p : min(p + _PIECE + LENGTH - 1, b)]
            at, first, last = anchors(piece)
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[piece] * up[: len(piece)], dtype=np.uint64)])
            whole = mix((prefix[last + LENGTH] - prefix[first]) * down[first] + mix(((at - first) * 4096 + last - first).astype(np.uint64)))
            parts.append((*tokens_at(piece, at), whole, np.full(len(at), d), at + (p - a), at - first, last - first))
    out = dict(zip(FIELDS, map(np.concatenate, zip(*parts)))) if parts else dict.fromkeys(FIELDS, np.zeros(0, np.uint64))
    return {f: out[f].astype(k) for f, k in KINDS.items()}


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of unsigned 64-bit numbers as byte strings that order alike."""
    return np.ascontiguousarray(np.stack(columns, 1).astype(">u8")).view(f"S{8 * len(columns)}").reshape(-1)


def splitters(blocks: DataFrame, n: int) -> np.ndarray:
    """``n - 1`` suffix keys (tokens, interval hash) between ranges of about equal size, from a seeded sample of anchors.

    The sample is ordered by ranges on Spark; only the splitters come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, draw, got = np.frombuffer(B.Block.of(row).data, np.uint8), np.random.default_rng(row["block"]), []
                for a in draw.integers(0, max(len(data) - SLICE, 1), 4) if len(data) >= LENGTH else []:
                    part = data[a : a + SLICE]
                    at = anchors(part)[0]
                    at = np.sort(draw.choice(at, min(len(at), SAMPLE // 4), replace=False))
                    got.append(keys_of([*tokens_at(part, at), draw.integers(0, 1 << 63, len(at)).astype(np.uint64) << np.uint64(1)]))
                keys = np.concatenate(got).view(np.uint8).reshape(-1, 8 * len(ORDER)) if got else []
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary())], ["key"])

    if n < 2:
        return np.zeros(0, f"S{8 * len(ORDER)}")
    share = min(1.0, n * PER_SPLITTER / max(blocks.count() * SAMPLE, 1))
    some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else blocks
    sample = table(some.select("block", "ids", "sizes", "data").mapInArrow(run, "key binary").withColumn("head", F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long")))
    # sizes of coarse ranges go to the driver, ranks are taken within the ranges
    coarse = max(16, n // 1000)
    ends = sample.agg(F.percentile_approx("head", [k / coarse for k in range(1, coarse)], 100 * coarse)).first()[0] or []
    ends = sorted(set(ends))
    part = sum((F.col("head") > F.lit(e)).cast("int") for e in ends) if ends else F.lit(0)
    parted = sample.withColumn("part", part)
    sizes = {r["part"]: r["count"] for r in parted.groupBy("part").count().collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    if not total:
        return np.zeros(0, f"S{8 * len(ORDER)}")
    shift = F.coalesce(*[F.when(F.col("part") == k, F.lit(v)) for k, v in before.items()])
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key")) + shift
    step = max(total // n, 1)
    cuts = parted.withColumn("rank", rank).where(f"rank % {step} = 0 AND rank < {step * n}").select("key").toArrow().column("key").to_pylist()
    return np.sort(np.array(cuts, f"S{8 * len(ORDER)}"))


_SENT = "bucket int, block long, ids binary, " + ", ".join(f"{f} binary" for f in FIELDS)


def _send(cuts: np.ndarray):
    """Blocks -> the anchors of each range, sorted by the first token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), *[(f, pa.binary()) for f in FIELDS]])
        for batch in batches:
            for row in batch.to_pylist():
                block = B.Block.of(row)
                found, again = _firsts(_anchors_of(block))  # in order, so ranges are runs
                bucket = np.searchsorted(cuts, keys_of([found[f] for f in ORDER]), "right")
                at = np.concatenate([np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), [len(bucket)]]) if len(bucket) else [0]
                # a row carries the ids of its own anchors, so that what a block sends does not grow with the number of ranges
                own = lambda a, b: B.pack(block.ids[np.unique(found["doc"][a:b])])
                if len(again):
                    yield pa.RecordBatch.from_pylist([{"bucket": -1 - row["block"] % len(_SPARE), "block": row["block"], "ids": B.pack(again)}], schema)
                yield pa.RecordBatch.from_pylist([
                    {"bucket": int(bucket[a]), "block": row["block"], "ids": own(a, b), "t0": B.pack_sorted(found["t0"][a:b]), **{f: B.pack(found[f][a:b]) for f in FIELDS[1:]}}
                    for a, b in zip(at, at[1:])
                ], schema)

    return run


#: Groups that carry what blocks have cut themselves.
_SPARE = range(4096)


def _firsts(found: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Anchors in suffix order, without those whose tokens and interval a block has had before, and the cuts that these are.

    However often a passage occurs, a block sends it once.
    """
    order = multikey_order(*[found[f] for f in ORDER])
    found = {f: v[order] for f, v in found.items()}
    same = ~_changes(found, ORDER)
    return {f: v[~same] for f, v in found.items()}, _cuts(found, same)


def _changes(x: dict[str, np.ndarray], fields: tuple[str, ...]) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.zeros(len(x["t0"]), bool)
    out[:1] = True
    for f in fields:
        out[1:] |= x[f][1:] != x[f][:-1]
    return out


def _cuts(x: dict[str, np.ndarray], chosen: np.ndarray) -> np.ndarray:
    cut = np.zeros(int(chosen.sum()), _CUT)
    cut["doc"] = x["doc"][chosen]
    cut["start"] = x["at"][chosen] - x["before"][chosen]
    cut["end"] = cut["start"] + x["more"][chosen] + LENGTH
    return cut


def multikey_order(*columns: np.ndarray) -> np.ndarray:
    """Stable order by the first column, ties by the next and so on; only ties are looked at again."""
    order = np.argsort(columns[0], kind="stable")
    same = columns[0][order[1:]] == columns[0][order[:-1]]
    for column in columns[1:]:
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(same) or not len(tied):
            break
        group = np.cumsum(np.concatenate([[True], ~same]))[tied]
        part = order[tied]
        order[tied] = part[np.lexsort((column[part], group))]
        at = np.flatnonzero(same)
        same[at] = column[order[at]] == column[order[at + 1]]
    return order


_FOUND = "block long, edge boolean, payload binary, border binary, bucket int"
_EDGE = np.dtype([("doc", "<u4"), ("at", "<u4"), ("before", "u1"), ("more", "u1")])
_CUT = np.dtype([("doc", "<u4"), ("start", "<u4"), ("end", "<u4")])


def _rows(block: np.ndarray, blocks: np.ndarray, edge: bool, records: np.ndarray) -> pd.DataFrame:
    order = np.argsort(block, kind="stable")
    at = np.searchsorted(block[order], np.arange(len(blocks) + 1))
    out = [(blocks[i], B.pack(records[order[a:b]])) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]
    return pd.DataFrame({"block": pd.Series([k for k, _ in out], dtype="int64"), "edge": edge, "payload": [p for _, p in out], "border": None, "bucket": 0})


def _edges(x: dict[str, np.ndarray], chosen: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x["doc"][chosen]), _EDGE)
    for f in _EDGE.names:
        out[f] = x[f][chosen]
    return out


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range: whole repeats, edges (first of each interval of tokens that have several), and what stands at its two ends.

    A row of an end holds the tokens in ``border``; its payload is the edge to be if the neighbouring range has
    these tokens too, null if they are edges anyway.
    """
    bucket = int(pdf["bucket"].iat[0])
    if bucket < 0:
        return pd.DataFrame({"block": pdf["block"], "edge": False, "payload": pdf["ids"], "border": None, "bucket": 0})
    pdf = pdf.sort_values("block", ignore_index=True)
    got: dict[str, list] = {f: [] for f in (*FIELDS, "id", "source")}
    for i, row in enumerate(pdf.itertuples()):
        got["t0"].append(B.unpack_sorted(row.t0))
        for f in FIELDS[1:]:
            got[f].append(B.unpack(getattr(row, f), KINDS[f]))
        ids = B.unpack(row.ids, np.int64)
        got["id"].append(ids[np.unique(got["doc"][-1], return_inverse=True)[1]])
        got["source"].append(np.full(len(got["doc"][-1]), i, np.int32))
    x = {f: np.concatenate(v) for f, v in got.items()}
    del got
    order = np.lexsort((x["at"], x["doc"], x["source"], x["id"]))  # occurrences from the first to the last
    order = order[multikey_order(*[x[f][order] for f in ORDER])]
    x = {f: v[order] for f, v in x.items()}
    new_gram, new = _changes(x, TOKENS), _changes(x, ORDER)
    heads = np.flatnonzero(new_gram)
    intervals = np.add.reduceat(new.astype(np.int64), heads)
    edge = new & np.repeat(intervals > 1, np.diff(np.concatenate([heads, [len(new)]])))
    blocks = pdf["block"].to_numpy()
    ends = np.unique(heads[[0, -1]])
    border = pd.DataFrame({
        "block": blocks[x["source"][ends]], "edge": False,
        "payload": [None if edge[i] else B.pack(_edges(x, slice(i, i + 1))) for i in ends],
        "border": [b"".join(int(x[f][i]).to_bytes(8, "big") for f in TOKENS) for i in ends], "bucket": bucket,
    })
    return pd.concat([_rows(x["source"][~new], blocks, False, _cuts(x, ~new)), _rows(x["source"][edge], blocks, True, _edges(x, edge)), border], ignore_index=True)


def across(found: DataFrame) -> DataFrame:
    """(block, payload): edges at the ends of ranges whose tokens the next range has too."""
    ends = found.where("border IS NOT NULL").select("block", "payload", "border", "bucket")
    both = ends.groupBy("border").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).where("low < high")
    return ends.join(both.select("border"), "border").where("payload IS NOT NULL").select("block", "payload")


#: Distances from string to anchor that a side decides, and the first byte that the side sends, seen from the anchor.
_SIDES = ((range(HALF), 1 - HALF), (range(HALF, REACH + 1), -REACH))


def _send_edges(n_buckets: int):
    """Blocks with their edges -> the bytes that the strings of each edge span, per side by the hash of what they have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("edges", pa.binary()), ("bytes", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = B.Block.of(row)
                all_edges = np.concatenate([B.unpack(p, _EDGE) for p in row["payloads"]])
                data = np.concatenate([np.frombuffer(block.data, np.uint8), np.zeros(_WIDTH, np.uint8)])
                rows = []
                for side, (distances, first) in enumerate(_SIDES):
                    high = all_edges["before"].astype(int)
                    edges = all_edges[(high >= distances[0]) & (high - all_edges["more"] <= distances[-1])]
                    place = block.starts[edges["doc"]] + edges["at"]
                    common = np.zeros(len(edges), np.uint64)
                    for k in range(GRAM + HALF):
                        common = common * _BASE + _BYTES[data[place + k - side * HALF]]
                    bucket = 2 * (mix(common) % np.uint64(n_buckets)).astype(np.int64) + side
                    order = np.argsort(bucket, kind="stable")
                    bucket, edges, place = bucket[order], edges[order], place[order]
                    at = [*np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)]
                    for a, b in zip(at, at[1:]):
                        e, column = edges[a:b], np.arange(_WIDTH)[None, :] + first
                        inside = (column >= -e["before"].astype(int)[:, None]) & (column < (e["more"].astype(int) - e["before"] + LENGTH)[:, None])
                        spans = np.where(inside, data[np.maximum(place[a:b, None] + column, 0)], 0).astype(np.uint8)
                        rows.append({"bucket": int(bucket[a]), "block": row["block"], "ids": B.pack(block.ids[np.unique(e["doc"])]), "edges": B.pack(e), "bytes": B.pack(np.ascontiguousarray(spans).reshape(-1))})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _compare_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of one side: strings that also start in an earlier edge, one distance from the anchor at a time."""
    distances, offset = _SIDES[int(pdf["bucket"].iat[0]) % 2]
    pdf = pdf.sort_values("block", ignore_index=True)
    edges, ids, source, spans = [], [], [], []
    for i, row in enumerate(pdf.itertuples()):
        edges.append(B.unpack(row.edges, _EDGE))
        ids.append(B.unpack(row.ids, np.int64)[np.unique(edges[-1]["doc"], return_inverse=True)[1]])
        source.append(np.full(len(edges[-1]), i, np.int32))
        spans.append(B.unpack(row.bytes, np.uint8).reshape(-1, _WIDTH))
    edges, ids, source, spans = map(np.concatenate, (edges, ids, source, spans))
    order = np.lexsort((edges["at"], edges["doc"], source, ids))
    edges, source, spans = edges[order], source[order], np.ascontiguousarray(spans[order].T)
    high = edges["before"].astype(int)  # a string starts ``distance`` bytes before its anchor
    low = high - edges["more"]
    value = np.zeros(len(edges), np.uint64)
    begin = -distances[0] - offset  # where in the span the string of the first distance starts
    for k in range(begin, begin + LENGTH):
        value = value * _BASE + _BYTES[spans[k]]
    repeats = np.zeros((len(distances), len(edges)), bool)
    for j, distance in enumerate(distances):
        at = begin - j
        if j:
            value = (value - _BYTES[spans[at + LENGTH]]) * _INVERSE + _BYTES[spans[at]] * _power(LENGTH - 1)
        has = np.flatnonzero((low <= distance) & (distance <= high))
        by = has[np.argsort(value[has], kind="stable")]
        pair = np.flatnonzero(value[by[1:]] == value[by[:-1]])
        for a in range(0, len(pair), 1 << 18):
            p = pair[a : a + (1 << 18)]
            equal = (spans[at : at + LENGTH, by[p + 1]] == spans[at : at + LENGTH, by[p]]).all(0)
            repeats[j, by[p[equal] + 1]] = True
    edge, j = np.nonzero(repeats.T)
    if not len(edge):
        return _rows(source[:0], pdf["block"].to_numpy(), False, np.zeros(0, _CUT))
    distance = j + distances[0]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(edge) != 0) | (np.diff(distance) != 1)]))
    last = np.concatenate([new[1:], [len(edge)]]) - 1
    cut = np.zeros(len(new), _CUT)
    cut["doc"] = edges["doc"][edge[new]]
    cut["start"] = edges["at"][edge[new]] - distance[last]
    cut["end"] = edges["at"][edge[new]] - distance[new] + LENGTH
    return _rows(source[edge[new]], pdf["block"].to_numpy(), False, cut)


def repeats(blocks: DataFrame) -> DataFrame:
    """(block, payload): byte ranges of the block's documents that earlier strings cover."""
    spark = blocks.sparkSession
    n = max(shuffle_partitions(spark), B.total_bytes(blocks) // (35 * ANCHORS_PER_RANGE))
    sent = blocks.select("block", "ids", "sizes", "data").mapInArrow(_send(splitters(blocks, n)), _SENT)
    found = table(sent.groupBy("bucket").applyInPandas(_compare, _FOUND))
    met = found.where("edge").select("block", "payload").unionByName(across(found))
    edges = B.with_payloads(blocks, met).where("payloads IS NOT NULL").select("block", "ids", "sizes", "data", "payloads")
    spans = edges.mapInArrow(_send_edges(n), "bucket int, block long, ids binary, edges binary, bytes binary")
    partial = spans.groupBy("bucket").applyInPandas(_compare_edges, _FOUND)
    return found.where("NOT edge AND border IS NULL").select("block", "payload").unionByName(partial.select("block", "payload"))


def removed_ranges(block: B.Block, payloads: list[bytes] | None) -> list[np.ndarray]:
    """Maximal removed runs (start, end) of each document."""
    cut = np.concatenate([np.zeros(0, _CUT), *[B.unpack(p, _CUT) for p in payloads or []]])
    starts = block.starts
    a, b = starts[cut["doc"]] + cut["start"], starts[cut["doc"]] + cut["end"]
    order = np.argsort(a, kind="stable")
    a, b, doc = a[order], np.maximum.accumulate(b[order]) if len(b) else b, cut["doc"][order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] > b[:-1]) | (doc[1:] != doc[:-1])])) if len(a) else np.zeros(0, int)
    a, b, doc = a[new], b[np.concatenate([new[1:], [len(b)]]) - 1] if len(new) else b, doc[new]
    at = np.searchsorted(doc, np.arange(len(block.sizes) + 1))
    return [np.stack([a[i:j], b[i:j]], 1) - starts[d] for d, (i, j) in enumerate(zip(at, at[1:]))]


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: binary) per row of ``docs``.

    A byte is removed if a string of ``LENGTH`` bytes covers it that also starts earlier: in a
    document with a smaller id, or before it in the same one.  Null ids count as larger than
    all others; rows with one id follow each other in input order.  Null texts are empty.
    """
    packed = B.make(docs, text, doc_id)
    both = B.with_payloads(packed, repeats(packed)).select("ids", "sizes", "data", "payloads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = B.Block.of(row)
                ranges, kept = removed_ranges(block, row["payloads"]), []
                for text_, cut in zip(block.texts(), ranges):
                    edges = [0, *cut.reshape(-1).tolist(), len(text_)]
                    kept.append(b"".join(text_[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.ids, pa.int64(), mask=block.null), pa.array(block.sizes, pa.int64()),
                    pa.array([int((c[:, 1] - c[:, 0]).sum()) for c in ranges], pa.int64()), pa.array([len(c) for c in ranges], pa.int64()),
                    pa.array(kept, pa.binary()),
                ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
