"""Language identification: kernel and regression against plain definitions, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import language
from tests.conftest import DATA

TEXTS = ["", "a", "!!", "Der Hund, der schläft!", "the dog   sleeps.", "ÉTÉ été", "日本語 text", "x" * 5000, "Ab\nab\tAB", "été"]


def plain_grams(text, letters):
    import unicodedata

    symbols, gap = " ", True
    for ch in unicodedata.normalize("NFC", text):
        if not ch.isalpha():
            symbols, gap = symbols if gap else symbols + " ", True
            continue
        low = ch if ch in letters else ch.lower()
        symbols, gap = symbols + (low if low in letters else "#"), False
    symbols = symbols if gap else symbols + " "
    return {symbols[i : i + n] for n in (1, 2, 3) for i in range(len(symbols) - n + 1)}


def test_kernel_counts_shared_distinct_grams():
    alphabet = language.alphabet_of(["der hund schläft the dog sleeps été"])
    marks = TEXTS[3:7]
    got = language.Kernel(language.Landmarks.of(alphabet, marks)).of(TEXTS)
    sets = [plain_grams(t, alphabet.letters) for t in TEXTS]
    other = [plain_grams(t, alphabet.letters) for t in marks]
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in other] for a in sets]
    assert np.allclose(got, want, atol=1e-5)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")


def test_regression_equals_plain_kernel_ridge(spark, documents):
    rows = documents.where("lang IS NOT NULL").select(F.col("doc_id").alias("key"), "text", "lang").limit(150).cache()
    model = language.learn(rows)
    kernel = language.Kernel(model.landmarks)
    data = rows.collect()
    k = kernel.of([r["text"] for r in data])
    y = np.array([[1.0 if r["lang"] == x else -1.0 for x in model.languages] for r in data])
    values, vectors = np.linalg.eigh(model.landmarks.presence.T.astype(float) @ model.landmarks.presence)
    kept = values > language.LEAST_EIGENVALUE * values.max()
    phi = k @ (vectors[:, kept] / np.sqrt(values[kept]))
    centred = phi - phi.mean(0)
    w = np.linalg.solve(centred.T @ centred + language.RIDGE * len(data) * np.eye(phi.shape[1]), centred.T @ (y - y.mean(0)))
    assert np.allclose(model.scores(k), centred @ w + y.mean(0), atol=1e-4)
    rows.unpersist()


def test_held_out_languages_are_found(documents):
    rows = language.identify(documents).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"] and r["lang"] is not None and r["lang_pred"] != language.UNDETERMINED]
    right = sum(r["lang"] == r["lang_pred"] for r in tested)
    assert len(tested) > 250 and right / len(tested) > 0.97


def test_only_rows_that_are_not_held_out_are_learned(documents):
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = documents.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang")))
    as_rows = lambda df: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify(df).collect())
    assert as_rows(other) == as_rows(documents)


def test_odd_documents(odd_docs, no_docs):
    got = language.identify(odd_docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == odd_docs.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)
    assert language.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_letters_decide_what_is_undetermined(spark):
    model = language.learn(spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr")], "key long, text string, lang string"))
    docs = spark.createDataFrame([(1, "日本"), (2, "12 !?"), (3, None), (4, "ª")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language.predict(docs, model).orderBy("doc_id").collect()] == [False, True, True, False]


def test_sample_bound_holds(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 40)
    docs = spark.range(2000).selectExpr("id AS key", "concat('word ', id) AS text", "IF(id % 2 = 0, 'a', 'b') AS lang")
    seen = []
    monkeypatch.setattr(language, "_sums", lambda sample, *a: seen.append(sample.count()) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        language.learn(docs)
    assert 5 < seen[0] <= 40
