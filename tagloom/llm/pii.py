"""Personal data: labelers vote on candidate spans, EM weighs the labelers, a classifier decides.

One pass over the texts finds candidates and lets three kinds of labelers (format rules,
gazetteers, context) vote.  Votes are few, so all candidates of the corpus come down to a
bounded table of vote patterns and counts; EM and the classifier are fitted on that
table, that is on every candidate, and the decision is a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SPANS, table, text_of

KINDS = ("email", "ip", "card", "phone", "local_phone", "national_id", "iban", "name")
BASE = 4
LABELERS = ("format", "gazetteer", "context", "surroundings")
ABSTAIN = -1

# Gazetteers.
TOP_LEVEL = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl"}
FIRST_NAMES = {"Anna", "Maria", "Sophie", "Julia", "Laura", "Emma", "Peter", "Thomas", "Michael", "David", "Daniel", "Paul", "Pierre", "Jean", "Claire", "Hans", "Karl", "Carlos", "Juan", "Miguel", "Carmen", "John", "Mary", "James", "Robert", "Linda", "Susan", "William"}
CALLING_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "421"}
CUES = {
    "email": ("mail", "contact", "write to", "correo"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"), "local_phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "national_id": ("ssn", "social security", "id no", "insurance"), "iban": ("iban", "account", "bank", "konto"), "name": ("name", "mr", "mrs", "ms", "dr", "signed", "dear"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "build", "issue", "ticket", "part no")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried once, from its first digit.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EXTRA = {
    "local_phone": re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3,4}\)\x20?|[0-9]{3,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{3,4}(?![0-9.-])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Characters of an IBAN without spaces, in the countries that have the shortest and by the standard.
_IBAN_LEAST, _IBAN_MOST = 15, 34
#: Letters of all scripts with case; accents may follow their letter as characters of their own.
_UPPER = "".join(c for c in map(chr, range(0x10000)) if c.isupper() and c.isalpha())
_LOWER = "".join(c for c in map(chr, range(0x10000)) if c.islower() and c.isalpha())
_ACCENTS = "\u0300-\u036f"
_NAME = re.compile(r"(?<!\w)(" + "|".join(sorted(FIRST_NAMES)) + rf")\x20[{_UPPER}][{_ACCENTS}]*[{_LOWER}](?:[{_ACCENTS}]*[{_LOWER}])+[{_ACCENTS}]*(?!\w)")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(filter("0123456789".__contains__, s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the run of local characters before it and a dotted domain after it; linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers at a time from each dotted chain."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield start, end
            start = end + 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each country code and check digits, the longest span with a valid checksum, else the longest span.

    A word in capitals or another IBAN may follow, so that the longest span can hold more than the IBAN.  A span
    without a valid checksum ends where one with a valid checksum begins.
    """
    found: list[tuple[int, int, bool]] = []
    for start in (m.start() for m in _IBAN_START.finditer(text)):
        m = _IBAN.match(text, start)
        ends = [e for e in range(m.end(), start, -1) if e == m.end() or text[e] == " "] if m else []
        ends = [e for e in ends if _IBAN_LEAST <= len(text[start:e].replace(" ", "")) <= _IBAN_MOST]
        end = next((e for e in ends if _iban_valid(text[start:e])), None)
        if found and start < found[-1][1]:
            if end is None or found[-1][2]:
                continue
            found[-1] = (found[-1][0], start - 1, False)
        if ends:
            found.append((start, end or ends[0], end is not None))
    for start, end, _ in found:
        yield start, end


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end); the first four kinds are exactly the base rules."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(1, a, b) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            digits = _only_digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
        out += [(KINDS.index(k), *m.span()) for k, pattern in _EXTRA.items() for m in pattern.finditer(text)]
        out += [(KINDS.index("iban"), a, b) for a, b in ibans(text)]
    out += [(7, *m.span()) for m in _NAME.finditer(text)]
    return out


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: int, start: int, end: int) -> list[int]:
    """1 for personal data, 0 against, -1 for no vote; in the order of ``LABELERS``."""
    s, name = text[start:end], KINDS[kind]
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 1]
    digits = _only_digits(s)
    if name == "email":
        form = int(not s.startswith((".", "-")) and ".." not in s)
        known = 1 if s.rpartition(".")[2].lower() in TOP_LEVEL else 0 if s.rpartition(".")[2].isdigit() else ABSTAIN
    elif name == "ip":
        form = int(all(p == "0" or p[0] != "0" for p in s.split(".")))
        known = 0 if s.startswith(("0.", "127.")) else ABSTAIN
    elif name == "card":
        form = int(len(digits) in (13, 14, 15, 16) and len(set(digits)) > 2)
        known = 1 if digits[0] in "3456" else 0
    elif name in ("phone", "local_phone"):
        form = int(len(digits) >= 9 and len(set(digits)) > 2)
        known = (1 if any(digits[:k] in CALLING_CODES for k in (1, 2, 3)) else 0) if name == "phone" else ABSTAIN
    elif name == "national_id":
        form = int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
        known = ABSTAIN
    elif name == "iban":
        form, known = int(_iban_valid(s)), ABSTAIN
    else:
        form, known = ABSTAIN, 1
    context = 1 if any(c in before for c in CUES[name]) else 0 if any(c in before for c in AGAINST) else ABSTAIN
    glued = text[start - 1 : start].isalnum() if start else False
    around = 0 if glued or after.isalnum() or before.endswith(("#", "$", "=")) else ABSTAIN if name == "name" else 1
    return [form, known, context, around]


_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int32()))])


def label(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, found: array of kind, start, end, votes) per row."""
    slim = docs.select(docs[doc_id].alias("doc_id"), text_of(docs[text]).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "votes": votes(t, k, a, b)} for k, a, b in candidates(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(_CANDIDATE))], ["doc_id", "found"])

    return slim.mapInArrow(run, f"doc_id {kind}, found array<struct<kind: int, start: int, end: int, votes: array<int>>>")


def vote_counts(labelled: DataFrame) -> list[tuple[int, tuple[int, ...], int]]:
    """(kind, votes, count): at most 8 kinds times 3**4 vote patterns, whatever the size of the corpus."""
    rows = labelled.select(F.explode("found").alias("x")).groupBy(F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes")).count().collect()
    return sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in rows)


def fit_reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50):
    """EM over vote patterns: (posterior per pattern, P(vote | class) per labeler).

    Starts from a majority of the votes; a prior of one vote each way keeps labelers that never vote defined.
    """
    v = np.array([c[1] for c in counts], int).reshape(-1, len(LABELERS))
    n = np.array([c[2] for c in counts], float)
    score = ((v == 1).sum(1) + 0.5) / ((v >= 0).sum(1) + 1.0)
    p, table_ = score, np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        for j in range(len(LABELERS)):
            for value in (-1, 0, 1):
                hit = v[:, j] == value
                table_[j, 1, value] = (n * p)[hit].sum() + (2.0 if value == 1 else 1.0)
                table_[j, 0, value] = (n * (1 - p))[hit].sum() + (2.0 if value == 0 else 1.0)
            table_[j] /= table_[j].sum(1, keepdims=True)
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        logit = np.log(prior / (1 - prior)) + sum(np.log(table_[j, 1, v[:, j]] / table_[j, 0, v[:, j]]) for j in range(len(LABELERS)))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, table_


def _features(kinds: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.hstack([np.eye(len(KINDS))[kinds], *[(v == value).astype(float) for value in (0, 1)]])


def fit_classifier(counts, rounds: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression of the EM posterior on kind and votes, weighted by counts (Newton steps with a ridge)."""
    w = np.zeros(len(KINDS) + 2 * len(LABELERS))
    if not counts:
        return w
    p, _ = fit_reliabilities(counts)
    x = _features(np.array([c[0] for c in counts]), np.array([c[1] for c in counts]).reshape(-1, len(LABELERS)))
    n = np.array([c[2] for c in counts], float)
    n /= n.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - q)) - ridge * w / len(w)
        hessian = (x * (n * q * (1 - q))[:, None]).T @ x + (ridge / len(w) + 1e-9) * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return w


def _score(w: np.ndarray, found: Column) -> Column:
    kinds = F.array(*[F.lit(float(a)) for a in w[: len(KINDS)]])
    score = F.get(kinds, found["kind"])
    for j in range(len(LABELERS)):
        against, for_ = w[len(KINDS) + j], w[len(KINDS) + len(LABELERS) + j]
        vote = F.get(found["votes"], j)
        score = score + F.when(vote == 0, float(against)).when(vote == 1, float(for_)).otherwise(0.0)
    return score


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) per row of ``docs``: base spans and the other candidates that the classifier takes.

    Whole texts, code points, end exclusive.  Null and empty texts have no spans; rows may
    repeat; without any candidate the classifier takes none.  Texts are read once; what was
    found is written to the shared folder, and later steps read that.
    """
    labelled = table(label(docs, text, doc_id))
    w = fit_classifier(vote_counts(labelled))
    names = F.array(*[F.lit(k) for k in KINDS])
    taken = F.filter("found", lambda x: (x["kind"] < BASE) | (_score(w, x) > 0))
    spans = F.transform(taken, lambda x: F.struct(x["kind"].alias("rank"), F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (x["kind"] < BASE).alias("base")))
    return labelled.select("doc_id", spans.cast(SPANS).alias("spans"))
