"""Secrets and personal data against literal readings of their rules."""

import random
import re
import string
import time

import pytest

from tagloom.llm import pii, secret_scan
from tests.conftest import DATA

SECRET_KINDS = [("assign", r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]


def literal_secrets(text):
    return sorted((m.start(), k, m.end()) for k, p, g, n in SECRET_KINDS for m in re.finditer(p, text) if len(m[g]) >= n)


def literal_personal(text):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or k == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def noise(seed, alphabet, n):
    draw = random.Random(seed)
    return "".join(draw.choice(alphabet) for _ in range(n))


def texts():
    out = [noise(i, "0123456789ab.- +()@", 300) for i in range(200)] + [noise(i, ["token", "=", ": ", "secret", "x", "API_KEY", "'", "AKIA", "A1", "deadbeef", " "], 120) for i in range(200)]
    return out + ["4111 1111 1111 1111, 1.2.3.4.5.6.7.8 and 300.1.1.1", "ü@b.co a@b..c a@@b.c @ x@y", "", "token: token = abcdefgh", "é" * 9 + " password=hunter22 " + "AKIA" + "B" * 20]


def base_of(spans):
    return sorted((s["start"], s["kind"], s["end"]) for s in spans if s["base"])


def test_secret_spans_match_the_literal_rules(spark):
    rows = list(enumerate(texts())) + [(10_000 + r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        assert base_of(got[i]) == literal_secrets(t), t
    assert sum(map(len, got.values())) > 100


def test_trigram_queries_never_lose_a_match():
    samples = {"github": "ghp_" + "a1" * 20, "slack": "xoxb-1234567890", "google": "AIza" + "x" * 35, "stripe": "sk_live_" + "a" * 20, "private_key": "-----BEGIN RSA PRIVATE KEY-----", "url_login": "ftp://me:secret1@host", "jwt": "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "assign": "Api_Key : 'abcdef'", "access": "AKIA" + "Q" * 16, "hex": "0" * 24}
    docs = [f"text {s} more" for s in samples.values()] + ["nothing here"]
    found = secret_scan.find_spans(docs)
    for kind, spans in zip(samples, found):
        assert kind in {s["kind"] for s in spans}, kind
    assert not found[-1]
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is secret_scan.ANY
    assert secret_scan.trigram_query("api_?key") == ("or", (("and", ("api", "pi_", "i_k", "_ke", "key")), ("and", ("api", "pik", "ike", "key"))))


def test_personal_spans_match_the_literal_rules(spark):
    rows = list(enumerate(texts())) + [(10_000 + r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["spans"] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert base_of(got[i]) == literal_personal(t), t


def test_long_runs_take_linear_time():
    assert pii.candidates("a" * 300_000 + "@ " + "1" * 300_000) == []
    assert secret_scan.find_spans(["token" + " " * 300_000 + "z" * 300_000]) == [[]]


def test_classifier_on_held_out_spans():
    """Reliabilities come from unlabelled votes; accuracy is measured on labelled spans that were not used."""
    draw = random.Random(5)
    cases = []
    for _ in range(600):
        good = draw.random() < 0.5
        digits = f"{draw.randint(201, 989)}-{draw.randint(200, 999)}-{draw.randint(1000, 9999)}"
        cue = draw.choice(["phone ", "call me: ", "tel. "]) if draw.random() < 0.8 else "and "
        cases.append((f"{cue}{digits} now", True) if good else (f"{draw.choice(['order no ', 'invoice #', 'serial $'])}{digits}{draw.choice(['', 'x'])}", False))
    found = [(pii.candidates(t), t, y) for t, y in cases]
    votes = [(c[0][0], tuple(pii.votes(t, *c[0])), y) for c, t, y in found if c]
    train, test = votes[::2], votes[1::2]
    counts = {}
    for kind, v, _ in train:
        counts[kind, v] = counts.get((kind, v), 0) + 1
    w = pii.fit_classifier([(k, v, n) for (k, v), n in sorted(counts.items())])
    import numpy as np

    x = pii._features(np.array([k for k, _, _ in test]), np.array([v for _, v, _ in test]))
    assert np.mean((x @ w > 0) == np.array([y for _, _, y in test])) > 0.9


@pytest.mark.parametrize("scan", [secret_scan.scan, pii.scan])
def test_odd_tables(scan, odd_docs, no_docs):
    got = scan(odd_docs)
    assert got.columns == ["doc_id", "spans"] and got.count() == odd_docs.count()
    assert got.where("doc_id IS NULL").count() == 2 and scan(no_docs).count() == 0


IBANS = ["NO9386011117947", "BE68539007547034", "NL91ABNA0417164300", "AT611904300234573201", "CH9300762011623852957", "DE89370400440532013000", "GB82WEST12345698765432", "ES9121000418450200051332", "FR1420041010050500013M02606", "IT60X0542811101000000123456", "MT84MALT011000012345MTLCAST001S"]


def found_by(kind, text):
    return [text[a:b] for k, a, b in pii.candidates(text) if pii.KINDS[k] == kind]


@pytest.mark.parametrize("iban", IBANS)
def test_ibans_of_every_length(iban):
    spaced = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
    for written in (iban, spaced):
        for after in ("", ".", " is mine", " IN", " FROM", " INTERNATIONAL"):
            text = f"the iban {written}{after}"
            assert found_by("iban", text) == [written], text
            assert pii.votes(text, pii.KINDS.index("iban"), 9, 9 + len(written))[0] == 1
        assert found_by("iban", f"{written} {spaced}") == [written, spaced]
        assert found_by("iban", f"AB12 3456 7891 {written}")[-1] == written
    assert found_by("iban", "DE89 3704 0044 0532 0130 01") == ["DE89 3704 0044 0532 0130 01"]
    assert found_by("iban", "AB12 3456 789") == [] and found_by("iban", "AB12 " * 20_000)


@pytest.mark.parametrize("name", ["Hans Müller", "Juan Núñez", "Jean Élysée", "Hans Mu\u0308ller", "Anna Smith"])
def test_surnames_beyond_ascii(name):
    assert found_by("name", f"signed {name}, today") == [name]


def test_long_secrets_are_whole():
    jwt = "eyJ" + "h" * 500 + ".eyJ" + "p" * 4100 + "." + "s" * 700
    login = "://x-access-token:github_pat_" + "a" * 82 + "@"
    user = "://" + "u" * 300 + ":" + "p" * 300 + "@"
    texts = [f"x {jwt} y", f"https{login}github.com", f"ftp{user}host", f"eyJ{'a' * 9} eyJ.eyJ{'b' * 9}.{jwt}"]
    wanted = [("jwt", 2, 2 + len(jwt)), ("url_login", 5, 5 + len(login)), ("url_login", 3, 3 + len(user)), ("jwt", 17, 17 + 12 + 1 + 503 + 1 + 4103)]
    for spans, want in zip(secret_scan.find_spans(texts), wanted, strict=True):
        assert want in [(s["kind"], s["start"], s["end"]) for s in spans]
    hard = ["eyJ" * 60_000, "eyJaaaaaaaaa." * 20_000, "://a:" * 40_000, "://" + "u" * 200_000]
    assert all(s["kind"] == "jwt" for spans in secret_scan.find_spans(hard) for s in spans)


def test_alphabet_of_local_parts():
    assert set(string.ascii_letters + string.digits + "._%+-") == set(pii._LOCAL)


def test_case_folds_ascii_letters_only():
    texts = ["\u017fecret=abcdefgh", "to\u212aen=abcdefgh secret: x", "SeCrEt=abcdefgh \u017fecret=abcdefgh to\u212aen=abcdefgh"]
    for text, spans in zip(texts, secret_scan.find_spans(texts), strict=True):
        assert base_of(spans) == literal_secrets(text)


def test_a_million_digits_take_linear_time():
    start = time.time()
    found = pii.candidates("1" * 1_000_000 + " 10.0.0.1")
    assert [f[1:] for f in found if pii.KINDS[f[0]] == "ip"] == [(1_000_001, 1_000_009)] and time.time() - start < 20


def test_long_surnames_are_whole():
    assert found_by("name", "signed Anna Featherstonehaughington, today") == ["Anna Featherstonehaughington"]
