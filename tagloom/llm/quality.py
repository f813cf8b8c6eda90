"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SPACES, chars_in_words, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the four corpus languages, lower case.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by a this are from at he "
    "le la de et les des du un une en que pour dans par sur est qui au pas ne "
    "der die und das ist nicht mit von zu den dem ein eine sich auf "
    "el los las y con para se por del es no lo su"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` for texts of at least ``min_words`` words; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0

    def passes(self, metrics: Column) -> Column:
        value = metrics[self.metric]
        sides = [value >= F.lit(self.low)] if self.low is not None else []
        sides += [value <= F.lit(self.high)] if self.high is not None else []
        return (metrics["n_words"] < self.min_words) | reduce(Column.__and__, sides)


#: The production table. Thresholds are shares of words or lines, except for the mean word length.
RULES = (
    Rule("too_few_words", "n_words", low=10),
    Rule("repeated_windows", "repeat_share", high=0.2),
    Rule("mean_word_length", "mean_word", low=2.5, high=12.0),
    Rule("symbols_per_word", "symbol_share", high=0.1),
    Rule("stop_words", "stop_share", low=0.06, min_words=30),
    Rule("duplicate_lines", "dup_line_share", high=0.4),
    Rule("bullet_lines", "bullet_share", high=0.9),
    Rule("ellipsis_lines", "ellipsis_share", high=0.3),
)
BASE_RULES = ("too_few_words", "repeated_windows")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def _words_in_repeated_windows(words: Column) -> Column:
    """Words covered by windows of five words that the text holds twice or more.

    Window hashes are sorted only when some hash is not unique; equal ones are then
    neighbours, so a text of n words costs n log n.
    """
    n = F.size(words) - (WINDOW - 1)
    window = lambda hashes, i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    windows = lambda hashes: F.transform(F.sequence(F.lit(0), n - 1), lambda i: window(hashes, i))
    with_place = lambda hashes: F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(ordered: Column) -> Column:
        equal = lambda x, k: F.coalesce(x["h"] == F.get(ordered, k)["h"], F.lit(False))
        return F.sort_array(F.array_compact(F.transform(ordered, lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), x["i"]))))

    def covered(found: Column) -> Column:
        return F.aggregate(
            found, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, s: F.struct((s + WINDOW).alias("end"), (acc["n"] + s + WINDOW - F.greatest(s, acc["end"])).alias("n")),
            lambda acc: acc["n"],
        )

    count = lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(with_place(hashes), lambda o: covered(starts(o))))
    return F.when(n < 2, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), count)))


def metrics(text: Column) -> Column:
    """A struct of counts and shares of one text."""

    def of_text(body: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
        return _let(words_of(body), lambda words: _let(lines, lambda ls: counts(body, words, ls)))

    def counts(body: Column, words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words),
            "word_chars": chars_in_words(body),
            "n_symbols": F.length(body) - F.length(F.translate(body, SYMBOLS, "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _words_in_repeated_windows(words),
            "n_stop": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
            "n_lines": F.size(lines),
            "n_bullets": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))),
            "n_ellipses": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in found.items()])

    def shares(m: Column) -> Column:
        n, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
        more = {
            "mean_word": m["word_chars"] / n, "symbol_share": m["n_symbols"] / n, "stop_share": m["n_stop"] / n, "repeat_share": m["n_repeat_words"] / n,
            "dup_line_share": m["n_dup_lines"] / lines, "bullet_share": m["n_bullets"] / lines, "ellipsis_share": m["n_ellipses"] / lines,
        }
        return F.struct(*[m[c].alias(c) for c in COUNTS], *[value.alias(name) for name, value in more.items()])

    return _let(_let(text_of(text), of_text), shares)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_lines", "n_bullets", "n_ellipses")


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the metrics and ``failed``, the names of the failed rules in table order: one expression, no user function."""

    def failed(m: Column) -> Column:
        names = F.array_compact(F.array(*[F.when(~rule.passes(m), F.lit(rule.name)) for rule in rules]))
        return F.struct(m.alias("metrics"), names.alias("failed"))

    return _let(metrics(text), failed)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row of ``docs`` as a struct, metrics, failed, kept) for every row; no shuffle.

    Null and empty texts have no words and fail.  Rows repeat as they come, texts are judged
    whole, and columns of ``docs`` can't clash as they are held in ``row``.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = held.withColumn("verdict", verdict(F.col("row")[text], rules))
    return judged.select("row", "verdict.metrics", "verdict.failed", (F.size("verdict.failed") == 0).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their columns."""
    return docs.where(F.size(verdict(docs[text], rules)["failed"]) == 0)
