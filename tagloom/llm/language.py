"""Language of a text: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

A text becomes a string over a small alphabet: letters in lower case, every run of other characters one space, letters
outside the alphabet one common symbol.  The kernel of two texts counts the distinct 1-, 2- and 3-grams that both hold,
divided by the geometric mean of how many each holds (presence, not frequency, so a long text is no more alike).

Landmarks are learned texts, a few per language.  With the kernel matrix ``K`` among them and a text's kernel values ``k``
the Nyström features are ``K^(-1/2) k``; ridge regression of +-1 targets per language on these features needs only
sums over the learned rows, which tasks add up.  Scoring packs texts into batches: one product of the presence matrix
with the landmarks' gives the kernel values, a second one the scores.  Texts are whole and never leave their task.

Learning takes a bounded sample: at most ``SAMPLE`` rows, the same share of each language as far as there are rows, of
at most ``LANGUAGES`` languages (the most frequent), and at most ``LANDMARKS`` landmarks of ``LANDMARK_CHARS`` characters
or fewer.  Scoring takes every row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import table

#: Bounds of what is learned from.
SAMPLE, LANGUAGES, LANDMARKS, LANDMARK_CHARS = 20_000, 200, 192, 4_000
#: Letters of the alphabet at most, lengths of the grams, ridge per learned row, eigenvalues taken for zero.
LETTERS, ORDERS, RIDGE, LEAST_EIGENVALUE = 125, (1, 2, 3), 1e-3, 1e-6
#: Texts of one matrix product.
BATCH = 64
UNDETERMINED = "und"
SPACE, OTHER = 0, 1


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter (general category L)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass(frozen=True)
class Alphabet:
    """Symbols: 0 space, 1 any other letter, then the letters of the alphabet."""

    letters: str

    @property
    def size(self) -> int:
        return len(self.letters) + 2

    def table(self) -> np.ndarray:
        """Symbol of every code point; upper and title case take the symbol of their lower case."""
        out = np.where(_letters(), OTHER, SPACE).astype(np.uint8)
        for i, letter in enumerate(self.letters):
            for form in {letter, letter.upper(), letter.title()}:
                if len(form) == 1:
                    out[ord(form)] = i + 2
        return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet_of(texts: list[str], most: int = LETTERS) -> Alphabet:
    """The most frequent lower-case letters of these texts (ties by code point)."""
    counts = np.zeros(0x110000, np.int64)
    for text in texts:
        np.add.at(counts, points(text.lower()), 1)
    counts[~_letters()] = 0
    order = np.lexsort((np.arange(len(counts)), -counts))[:most]
    return Alphabet("".join(sorted(chr(c) for c in order if counts[c])))


class Grams:
    """Distinct grams of a text as numbers: symbols in base ``size``, shorter grams before longer ones."""

    def __init__(self, alphabet: Alphabet):
        self.size = alphabet.size
        self.symbol = alphabet.table()
        self.offsets = np.cumsum([0, *[self.size**n for n in ORDERS]])
        self.last = np.zeros(self.offsets[-1], np.int32)

    def of(self, text: str) -> np.ndarray:
        symbols = self.symbol[points(text)]
        both = np.concatenate([[SPACE], symbols, [SPACE]]).astype(np.int64)
        kept = both[np.concatenate([[True], (both[1:] != SPACE) | (both[:-1] != SPACE)])]
        out, code = [], np.zeros(len(kept), np.int64)
        for n, offset in zip(ORDERS, self.offsets):
            code = code[: len(kept) - n + 1] * self.size + kept[n - 1 :]
            out.append(code + offset)
        grams = np.concatenate(out)
        # of equal grams the one written last stays: no sort, and nothing to clear before the next text
        place = np.arange(len(grams), dtype=np.int32)
        self.last[grams] = place
        return grams[self.last[grams] == place]


@dataclass(frozen=True)
class Landmarks:
    """Grams of the landmarks: their numbers in order, and the normalised presence matrix (gram, landmark)."""

    alphabet: Alphabet
    grams: np.ndarray
    presence: np.ndarray

    @classmethod
    def of(cls, alphabet: Alphabet, texts: list[str]) -> Landmarks:
        reader = Grams(alphabet)
        found = [reader.of(t) for t in texts]
        grams = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        presence = np.zeros((len(grams), len(found)), np.float32)
        for i, g in enumerate(found):
            presence[np.searchsorted(grams, g), i] = 1 / np.sqrt(len(g))
        return cls(alphabet, grams, presence)


class Kernel:
    """Kernel values of texts and landmarks, batch by batch."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.reader = landmarks, Grams(landmarks.alphabet)
        self.slot = np.full(self.reader.offsets[-1], -1, np.int32)
        self.slot[landmarks.grams] = np.arange(len(landmarks.grams), dtype=np.int32)

    def of(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.landmarks.presence.shape[1]))
        for start in range(0, len(texts), BATCH):
            piece = texts[start : start + BATCH]
            rows = np.zeros((len(piece), len(self.landmarks.grams)), np.float32)
            for i, text in enumerate(piece):
                grams = self.reader.of(text)
                slots = self.slot[grams]
                rows[i, slots[slots >= 0]] = 1 / np.sqrt(len(grams))
            out[start : start + len(piece)] = rows @ self.landmarks.presence
        return out


@dataclass(frozen=True)
class Model:
    landmarks: Landmarks
    languages: list[str]
    #: (landmark, language), and a constant per language
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, kernel: np.ndarray) -> np.ndarray:
        """+1 for a language's own texts, -1 for others, as regression."""
        return kernel @ self.weights + self.bias


# Spark -----------------------------------------------------------------------------------------------------------


def remainder(doc_id: Column, modulus: int = 3) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def learn(rows: DataFrame) -> Model | None:
    """Model from rows (key, text, lang), None without any usable row.  Rows are sampled within the module's bounds; ``key`` only spreads the draw."""
    usable = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("key", "text", F.col("lang").cast("string").alias("lang"))
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    quota = SAMPLE // len(languages)
    # A share of each language, drawn by a hash of the row: what is expected lies six deviations below the quota,
    # and equal rows, which are drawn together, count once.
    expected = max(quota - 6 * quota**0.5, quota / 4)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 1.0 if r["count"] <= quota else expected / r["count"])])
    drawn = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.try_element_at(share, F.col("lang"))
    sample = table(usable.where(drawn).distinct())
    each = max(1, LANDMARKS // len(languages))
    short = sample.where(F.length("text") <= LANDMARK_CHARS).select("lang", "text").distinct()
    # texts that hold many grams first, otherwise by hash; the sample is bounded, and so are its groups
    rank = F.struct(F.length("text") < LANDMARK_CHARS // 8, F.xxhash64("text"), "text")
    ranked = short.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(rank)), 1, each).alias("best"))
    chosen = sorted((r["lang"], b["text"]) for r in ranked.collect() for b in r["best"])
    if not chosen:
        return None
    texts = [t for _, t in chosen]
    landmarks = Landmarks.of(alphabet_of(texts), texts)
    gram, cross = _sums(sample, landmarks, languages)
    n = gram[-1, -1]
    values, vectors = np.linalg.eigh(landmarks.presence.T.astype(float) @ landmarks.presence)
    kept = values > LEAST_EIGENVALUE * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])  # features of a text: kernel values times this
    features = np.zeros((len(texts) + 1, kept.sum() + 1))
    features[:-1, :-1], features[-1, -1] = root, 1
    ridge = RIDGE * n * np.eye(features.shape[1])
    ridge[-1, -1] = 0
    solved = np.linalg.lstsq(features.T @ gram @ features + ridge, features.T @ cross, rcond=None)[0]
    return Model(landmarks, languages, root @ solved[:-1], solved[-1])


def _sums(sample: DataFrame, landmarks: Landmarks, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows of the sample, with ``k`` the kernel values and a last 1: the sum of ``k k'`` and of ``k y'``."""
    width, at = landmarks.presence.shape[1] + 1, {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, total = Kernel(landmarks), np.zeros((width, width + len(at)))
        for batch in batches:
            values = np.ones((batch.num_rows, width))
            values[:, :-1] = kernel.of(batch.column("text").to_pylist())
            target = np.full((batch.num_rows, len(at)), -1.0)
            target[np.arange(batch.num_rows), [at[x] for x in batch.column("lang").to_pylist()]] = 1
            total += values.T @ np.concatenate([values, target], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    # the sample is bounded, and so is the number of its files: one small matrix from each
    files = sample.coalesce(16).mapInArrow(run, "i int, v array<double>").collect()
    total = np.zeros((width, width + len(at)))
    for r in sorted(files, key=lambda r: (r["i"], r["v"])):
        total[r["i"]] += r["v"]
    return total[:, :width], total[:, width:]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Columns of ``docs`` with ``lang_pred`` and ``score``.

    ``lang_pred`` is "und" with score 0 where the text is null or has no letter, or where nothing was learned.  The
    score is the regression's value mapped from -1..1 to 0..1, cut off there; equal scores go to the first language in order.
    Texts of any length are taken whole.  An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, letters = model and Kernel(model.landmarks), _letters()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            known = [i for i, t in enumerate(texts) if model and letters[points(t)].any()]
            languages, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if known:
                values = model.scores(kernel.of([texts[i] for i in known]))
                best = values.argmax(1)
                score[known] = ((values.max(1) + 1) / 2).clip(0, 1)
                for i, b in zip(known, best.tolist()):
                    languages[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(languages, pa.string()), pa.array(score, pa.float64())], [*rest, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those that are not held out.

    Held out is a document whose id has remainder 1; a null id counts as empty text, which is learned from.  Repeated rows are
    rows of their own.  Language, source and id are no inputs of a prediction.
    """
    out = F.coalesce(remainder(docs[doc_id]) == 1, F.lit(False))
    model = learn(docs.where(~out).select(docs[doc_id].alias("key"), docs[text].alias("text"), docs[lang].alias("lang")))
    return predict(docs.select(docs[doc_id].alias("doc_id"), out.alias("held_out"), docs[text].alias("text")), model)
