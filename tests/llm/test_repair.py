"""Conversation repair: the agenda against all derivations, and the whole operator against a plain reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tagloom.llm import repair
from tests.conftest import DATA

WORD = re.compile(r"[^ \t-\r]")


def every_repair(rows, most_inserts=3):
    """All (cost, audit, lines) of short conversations: every choice per row and every placing of inserts."""
    def step(i, state, cost, audit, lines, inserts):
        if inserts < most_inserts:
            to = "ua"[state == "u"] if state else "u"
            yield from step(i, to, cost + 2, audit + "I", [*lines, f"{ {'u': 'user', 'a': 'assistant'}[to]}:"], inserts + 1)
        if i == len(rows):
            if state in ("", "a"):
                yield cost, audit, lines
            return
        role, text, fault = rows[i]
        yield from step(i + 1, state, cost + 3, audit + "D", lines, inserts)
        if fault in ("blank", "duplicate"):
            return
        extra = fault == "truncated"
        to = role[:1]
        if state + to in ("s", "u", "su", "ua", "au"):
            yield from step(i + 1, to, cost + extra, audit + "K", [*lines, f"{role}:{text}"], inserts)
        to = "a" if state == "u" else "u"
        yield from step(i + 1, to, cost + 2 + extra, audit + "R", [*lines, f"{ {'u': 'user', 'a': 'assistant'}[to]}:{text}"], inserts)

    return min(step(0, "", 0, "", [], 0), key=lambda r: r[:2])


ROLES, FAULTS = ("system", "user", "assistant", "tool", "admin"), ("", "", "blank", "duplicate", "truncated")


@pytest.mark.parametrize("n", range(5))
def test_agenda_finds_the_lightest_of_all_repairs(n):
    rng = random.Random(n)
    for _ in range(60):
        rows = [(rng.choice(ROLES), f"t{i}", rng.choice(FAULTS)) for i in range(n)]
        cost, audit, lines = every_repair(rows)
        assert repair.repair_rows(rows) == (cost, audit)
        assert repair.apply(rows, audit)[0] == lines


@pytest.mark.parametrize("size", [1, 2, 7])
def test_chained_segments_equal_one_agenda(size):
    rng = random.Random(size)
    for _ in range(25):
        rows = [(rng.choice(ROLES), f"t{i}", rng.choice(FAULTS)) for i in range(rng.randrange(1, 30))]
        cuts = [rows[i : i + size] for i in range(0, len(rows), size)]
        value = repair.chain([repair.between_states(c) for c in cuts])
        assert value == repair.repair_rows(rows)
        parts = repair.pieces(value[1], [len(c) for c in cuts])
        assert "".join(parts) == value[1]
        lines, state = [], repair.NOTHING
        for c, p in zip(cuts, parts):
            more, state = repair.apply(c, p, state)
            lines += more
        assert lines == repair.apply(rows, value[1])[0]


def test_long_conversations_take_bounded_steps():
    rows = [(ROLES[i % 3], str(i), FAULTS[i % 5]) for i in range(repair.SEGMENT)]
    values = repair.between_states(rows)
    assert values[repair.NOTHING * 4 + repair.ASSISTANT] and values[4 * repair.USER + repair.NOTHING] is None


def plain(rows):
    """The query's rows from (conv_id, turn, role, text) by the rules, with a table of lightest values per state."""
    said = lambda v: " " if v is None else str(v)
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        role, text = "user" if kind == 4 else said(role), "" if kind == 1 else re.sub("[.!?]", "", said(text)) if kind == 2 else said(text)
        out[c] += [(t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    result = []
    for c, mine in out.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for t, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        best = {"": (0, "", [])}
        follow = lambda q: "a" if q == "u" else "u"
        named = {"u": "user", "a": "assistant"}

        def inserted(best):
            for _ in range(3):
                for q, (k, a, ls) in list(best.items()):
                    to = follow(q)
                    best[to] = min(best.get(to, (10**9, "", [])), (k + 2, a + "I", [*ls, named[to] + ":"]), key=lambda v: v[:2])
            return best

        for (_, role, text), fault in zip(mine, faults):
            nxt = {}
            for q, (k, a, ls) in inserted(best).items():
                steps = [(q, 3, "D", None)]
                if fault not in ("blank", "duplicate"):
                    x = fault == "truncated"
                    steps.append((follow(q), 2 + x, "R", named[follow(q)]))
                    if q + role[:1] in ("s", "u", "su", "ua", "au"):
                        steps.append((role[:1], x, "K", role))
                for to, w, letter, shown in steps:
                    nxt[to] = min(nxt.get(to, (10**9, "", [])), (k + w, a + letter, ls if shown is None else [*ls, f"{shown}:{text}"]), key=lambda v: v[:2])
            best = nxt
        best = inserted(best)
        cost, audit, lines = min((best[q] for q in ("", "a") if q in best), key=lambda v: v[:2])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(result, key=repr)


ODD = [(7, t, ("user", "assistant")[t % 2], f"word {t % 40}.") for t in range(120)] + [
    (1, 0, "system", "Be kind."), (1, 1, None, "Hello."), (1, None, "user", "First?"), (1, 2, "assistant", None), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
    (None, 1, "user", "No conversation."), (None, None, None, None), (2, 5, "user", ""), (3, None, "assistant", "x" * 100_000), (3, None, "user", " \n"),
    (4, -3, "Système", "é!"), (4, 9, "usher", "ok."), (4, 10, "ｕser", "wide."),
]


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(7) for c in ("c", "t", "n", "kind", "spoken", "fault", "part", "no", "cost", "audit")})


def found(df):
    assert df.columns == ["conv_id", *repair.RESULT]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("segment", [3, repair.SEGMENT])
def test_odd_conversations_match_the_rules(spark, segment):
    assert found(repair.repair(frame(spark, ODD + ODD[5:9]), segment)) == plain(ODD + ODD[5:9])


def test_conversations_match_the_rules(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert found(repair.repair(df)) == want and found(repair.repair(df, 2)) == want


def test_a_long_conversation_is_spread_over_tasks(spark):
    rows = [(5, t, "user" if t % 3 else "assistant", f"said {t}" + "." * (t % 4)) for t in range(3000)]
    assert found(repair.repair(frame(spark, rows), 100)) == plain(rows)


def test_no_conversations(spark):
    assert found(repair.repair(frame(spark, []))) == []
