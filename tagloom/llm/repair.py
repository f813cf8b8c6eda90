"""Repair of damaged conversations by Knuth's lightest-derivation agenda.

Derived items are ``(rows read, state)``; the state says what has been emitted: nothing, a system row, a user row or
an assistant row.  Every row is a premise with the edits that it allows.  A deduction takes an item and a premise to
the item behind that row, by keeping, reroling or deleting it; another one inserts a row and reads none.
The value of an item is ``(cost, audit)``.  Each deduction adds to the cost and appends to the audit, so values never
fall along a derivation (superior functions), and of two values the smaller stays smaller (monotone): two audits of
equal cost over the same rows are never prefixes of each other, as the longer one has paid for its inserts.
Hence the first time an item is popped from the agenda its value is final, and the agenda ends with its goal.

Long conversations are cut into segments.  A segment's agenda runs from each state and gives the lightest
derivation between every two states; the same agenda then chains segments, whose derivations are its premises.
Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread over tasks;
equal rows are counted before they move.  What one task needs of a conversation are 16 audits per segment; its
audit itself is one value of the result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SPACES, shuffle_partitions, table

#: Rows of a segment, and bytes of text from which it takes no further row; rows with texts that a task sends at once.
SEGMENT, SEGMENT_BYTES, BATCH = 512, 16 << 20, 1024
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Emitted so far: nothing, a system row only, a user row last, an assistant row last.  A conversation may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (NOTHING, ASSISTANT)
_NEXT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}

Value = tuple[int, str]
#: (state before, state behind, cost, letter)
Edit = tuple[int, int, int, str]


def edits(initial: str, fault: str) -> list[Edit]:
    """What may be done with a row of this role initial and first fault."""
    out = [(q, q, DELETE, "D") for q in range(4)]
    if fault in ("blank", "duplicate"):
        return out
    extra = CUT_OFF if fault == "truncated" else 0
    if initial == "s":
        out.append((NOTHING, SYSTEM, KEEP + extra, "K"))
    for q, to in _NEXT.items():
        if initial == ROLE[to][0]:
            out.append((q, to, KEEP + extra, "K"))
        out.append((q, to, REROLE + extra, "R"))
    return out


INSERTS: list[Edit] = [(q, to, INSERT, "I") for q, to in _NEXT.items()]
_TABLE = {(i, f): edits(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


def lightest(n: int, premises: Callable[[int], Sequence[tuple[int, int, int, str]]], start: int, goals: Sequence[int], inserts: Sequence[Edit] = INSERTS, first: bool = False) -> dict[int, Value]:
    """Lightest (cost, audit) from ``start`` to each goal state behind all ``n`` premises; with ``first`` only of the lightest goal."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    found: dict[int, Value] = {}
    while agenda and len(found) < len(goals):
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n and q in goals:
            found[q] = (cost, audit)
            if first:
                break
        for before, behind, weight, letters in premises(i) if i < n else ():
            if before == q and (i + 1, behind) not in final:
                heapq.heappush(agenda, (cost + weight, audit + letters, i + 1, behind))
        for before, behind, weight, letters in inserts:
            if before == q and (i, behind) not in final:
                heapq.heappush(agenda, (cost + weight, audit + letters, i, behind))
    return found


def repair_rows(rows: Sequence[tuple[str, str, str]]) -> Value:
    """(cost, audit) of the lightest repair of rows (role, text, first fault)."""
    found = lightest(len(rows), lambda i: _TABLE[_initial(rows[i][0]), rows[i][2]], NOTHING, GOALS, first=True)
    return next(iter(found.values()))


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def between_states(rows: Sequence[tuple[str, str, str]]) -> list[Value | None]:
    """Lightest derivation of a segment from each state to each state, row by row of that matrix."""
    out: list[Value | None] = []
    for q in range(4):
        found = lightest(len(rows), lambda i: _TABLE[_initial(rows[i][0]), rows[i][2]], q, range(4))
        out += [found.get(to) for to in range(4)]
    return out


def chain(segments: Sequence[Sequence[Value | None]]) -> Value:
    """Lightest repair over all segments, whose derivations are the premises."""
    premises = [[(q // 4, q % 4, v[0], v[1]) for q, v in enumerate(m) if v is not None] for m in segments]
    found = lightest(len(segments), lambda i: premises[i], NOTHING, GOALS, inserts=(), first=True)
    return next(iter(found.values()))


def pieces(audit: str, sizes: Sequence[int]) -> list[str]:
    """The audit cut behind every segment's last row; inserts behind it belong to the next one, the rest to the last."""
    out, at = [], 0
    for k, size in enumerate(sizes):
        begin, left = at, size
        while left:
            left -= audit[at] != "I"
            at += 1
        if k == len(sizes) - 1:
            at = len(audit)
        out.append(audit[begin:at])
    return out


def apply(rows: Sequence[tuple[str, str, str]], audit: str, state: int = NOTHING) -> tuple[list[str], int]:
    """Repaired lines ``role:text`` and the state behind them."""
    lines, i = [], 0
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            lines.append(f"{ROLE[state]}:")
            continue
        role, text, _ = rows[i]
        i += 1
        if letter == "K":
            state = SYSTEM if state == NOTHING and role[:1] == "s" else _NEXT[state]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            state = _NEXT[state]
            lines.append(f"{ROLE[state]}:{text}")
    return lines, state


# Rows ------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(c, t, role, text, n): rows after damage, null role and text as one space, ``n`` equal rows next to each other."""
    at = lambda name: conversations[name]
    said = lambda name: F.coalesce(at(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    slim = conversations.select(at("conv_id").alias("c"), at("turn").alias("t"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return slim.where("kind > 0").select("c", "t", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows (c, t, role, text, n) with ``fault``, the first fault of the first of the equal rows, and ``seen``: the later ones'."""
    equal = rows.groupBy("c", "t", "role", "text").agg(F.sum("n").alias("n"))
    part = lambda name: F.concat(F.length(name).cast("string"), F.lit(":"), name)
    spoken = F.sha2(F.concat(F.coalesce(part(F.col("c").cast("string")), F.lit("-")), part(F.col("role")), F.col("text")), 256)
    keyed = equal.withColumn("spoken", spoken)
    when = F.struct(F.col("t").isNotNull().alias("known"), F.col("t"))
    # only what is said in several turns goes to the join; several turns may be many, which the join splits by size
    ends = rows.withColumn("spoken", spoken).groupBy("spoken").agg(F.min(when).alias("earliest"), F.max(when).alias("latest"))
    again = ends.where("earliest < latest").drop("latest")
    blank = F.length(F.translate("text", SPACES, "")) == 0
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    later = F.col("earliest").isNotNull() & (when != F.col("earliest"))
    fault = F.when(blank, "blank").when(later, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    joined = keyed.join(again, "spoken", "left")
    return joined.select("c", "t", "role", "text", "n", fault.alias("fault"), F.when(blank, "blank").otherwise("duplicate").alias("seen"))


_PART = "part long, no long, n_rows long, first_turn {t}, last_turn {t}, turns long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long"
_DONE = "cost long, audit string, digest string, costs array<long>, audits array<string>, roles array<string>, texts array<string>, faults array<string>"


def _segments(kinds: dict[str, str], size: int):
    """Sorted rows -> segments.  A conversation that cannot reach into another task and is short is repaired at once."""
    names = [f.split()[0] for f in f"{_PART}, {_DONE}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, schema = TaskContext.get().partitionId(), None
        no, held, ended, opened = 0, [], [], True  # opened: the conversation may have begun in an earlier task
        size_held, waiting = 0, 0

        def segment(c, rows: list, whole: bool) -> dict:
            turns = [r[0] for r in rows if r[0] is not None]
            initials = [_initial(r[1]) for r in rows]
            plain = [r[1:] for r in rows]
            faults = [r[3] for r in rows]
            out = {
                "c": c, "part": number, "no": no, "n_rows": len(rows), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "turns": len(set(turns)),
                "first_role": initials[0], "last_role": initials[-1], "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            }
            if whole:
                cost, audit = repair_rows(plain)
                digest = hashlib.sha256("\n".join(apply(plain, audit)[0]).encode()).hexdigest()
                return out | {"cost": cost, "audit": audit, "digest": digest}
            values = between_states(plain)
            return out | {
                "costs": [v and v[0] for v in values], "audits": [v and v[1] for v in values],
                "roles": [r[0] for r in plain], "texts": [r[1] for r in plain], "faults": faults,
            }

        current = None
        for batch in batches:
            if schema is None:
                fields = {"c": batch.schema.field("c").type, "first_turn": batch.schema.field("t").type, "last_turn": batch.schema.field("t").type}
                text, many = ("first_role", "last_role", "audit", "digest"), {"costs": pa.list_(pa.int64())} | {k: pa.list_(pa.string()) for k in ("audits", "roles", "texts", "faults")}
                schema = pa.schema([(k, fields.get(k) or many.get(k) or (pa.string() if k in text else pa.int64())) for k in ("c", *names)])
            columns = [batch.column(k).to_pylist() for k in ("c", "t", "role", "text", "n", "fault", "seen")]
            for c, t, role, text_, n, fault, seen in zip(*columns):
                if held and c != current:
                    ended.append(segment(current, held, whole=not opened and no == 0))
                    waiting += 1 if not opened and no == 0 else len(held)
                    held, size_held, opened, no = [], 0, False, 0
                current = c
                for k in range(n):
                    if len(held) == size or size_held > SEGMENT_BYTES:
                        ended.append(segment(c, held, whole=False))
                        waiting += len(held)
                        held, size_held, no = [], 0, no + 1
                    held.append((t, role, text_, seen if k else fault))
                    size_held += 4 * len(text_)
                    if waiting >= BATCH or size_held > SEGMENT_BYTES and ended:
                        yield pa.RecordBatch.from_pylist(ended, schema)
                        ended, waiting = [], 0
        if held:
            ended.append(segment(current, held, whole=False))
        if ended:
            yield pa.RecordBatch.from_pylist(ended, schema)

    return run, f"c {kinds['c']}, {_PART.format(t=kinds['t'])}, {_DONE}"


_STATS = ("blank", "duplicate", "truncated")


def _chained(kinds: dict[str, str]):
    """All segments of a conversation, without their rows -> its repair, and every segment's piece of the audit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "no"], kind="stable")
        values = [[None if v is None else (int(k), v) for k, v in zip(c, a)] for c, a in zip(pdf["costs"], pdf["audits"])]
        cost, audit = chain(values)
        roles = list(zip(pdf["last_role"], pdf["first_role"][1:]))
        known = pdf[pdf["first_turn"].notna()]
        shared = sum(a == b for a, b in zip(known["last_turn"], known["first_turn"][1:]))
        span = known["last_turn"].max() - known["first_turn"].min() + 1 if len(known) else 0
        row = {
            "gaps": int(span - (known["turns"].sum() - shared)), **{k: int(pdf[k].sum()) for k in _STATS},
            "illegal": int(pdf["illegal"].sum() + sum(a + b not in ("su", "ua", "au") for a, b in roles)), "cost": cost, "audit": audit,
        }
        cut = pieces(audit, pdf["n_rows"].tolist())
        out = pdf[["c", "part", "no"]].assign(piece=cut, **row)
        out.iloc[1:, out.columns.get_loc("audit")] = None  # once per conversation
        return out

    return run, f"c {kinds['c']}, part long, no long, piece string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _digests(kinds: dict[str, str]):
    """Segments in order with their pieces -> one row per conversation with the digest of its repaired rows, in a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            schema = schema or pa.schema([("c", batch.schema.field("c").type), ("digest", pa.string())])
            for row in batch.to_pylist():
                if held is None or row["c"] != held[0]:
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([{"c": held[0], "digest": held[1].hexdigest()}], schema)
                    held = [row["c"], hashlib.sha256(), NOTHING, False]
                lines, held[2] = apply(list(zip(row["roles"], row["texts"], row["faults"])), row["piece"], held[2])
                for line in lines:
                    held[1].update(("\n" + line if held[3] else line).encode())
                    held[3] = True
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"c": held[0], "digest": held[1].hexdigest()}], schema)

    return run, f"c {kinds['c']}, digest string"


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation after damage.

    Null role and text count as one space; a null conv_id is a conversation of its own; null turns come first.  Rows of
    one turn are taken by role and text (code points), equal rows next to each other.  Long texts and conversations are taken whole: a
    conversation's audit is one value, of at most 2 GB.  A conversation without rows after damage has zeros, an empty
    audit and the digest of nothing; an empty table gives no rows.
    """
    rows = judged(damaged(conversations))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("c", "t")}
    run, schema = _segments(kinds, segment)
    order = ["c", "t", "role", "text"]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    parts = table(dealt.mapInArrow(run, schema))
    at_once, cut = parts.where("costs IS NULL"), parts.where("costs IS NOT NULL")
    span = F.coalesce(F.col("last_turn").cast("long") - F.col("first_turn").cast("long") + 1 - F.col("turns"), F.lit(0))
    short = at_once.select("c", span.alias("gaps"), *_STATS, "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))
    run, schema = _chained(kinds)
    chained = table(cut.select("c", "part", "no", "n_rows", "first_turn", "last_turn", "turns", "first_role", "last_role", *_STATS, "illegal", "costs", "audits").groupBy("c").applyInPandas(run, schema))
    run, schema = _digests(kinds)
    # by the numbers of the segments: a task's segments are its own, and the null conversation joins as well
    placed = cut.select("part", "no", "c", "roles", "texts", "faults").join(chained.select("part", "no", F.col("c").alias("c2"), "piece"), (F.col("c").eqNullSafe(F.col("c2"))) & (cut["part"] == chained["part"]) & (cut["no"] == chained["no"]))
    ordered = placed.select("c", cut["part"], cut["no"], "roles", "texts", "faults", "piece").repartition("c").sortWithinPartitions("c", "part", "no")
    digests = ordered.select("c", "roles", "texts", "faults", "piece").mapInArrow(run, schema).withColumnRenamed("c", "c2")
    once = chained.where("audit IS NOT NULL").drop("piece", "part", "no")
    long = once.join(digests, once["c"].eqNullSafe(digests["c2"])).select("c", "gaps", *_STATS, "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))
    repaired = short.unionByName(long).withColumnRenamed("c", "r_id")
    ids = conversations.select(conversations["conv_id"].alias("conv_id")).distinct()
    nothing = {**dict.fromkeys(RESULT[:6], 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return ids.join(repaired, F.col("conv_id").eqNullSafe(F.col("r_id")), "left").select("conv_id", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in nothing.items()])
