"""Quality rules: one table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import SPACE_SPLIT, WORD

#: Words that running prose of these languages can hardly avoid.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "are", "this", "a",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ein", "im", "auf", "dem", "für", "ist", "sich", "des",
    "le", "la", "les", "de", "et", "du", "un", "une", "que", "qui", "dans", "en", "pour", "par", "sur", "au", "est",
    "el", "los", "las", "y", "se", "no", "por", "con", "una", "su", "lo", "al", "más", "mi",
)


@dataclass(frozen=True)
class Rule:
    """A document of `least` words or more fails where 100 * top is below `low` or above `high` percent of bottom."""

    name: str
    top: str
    bottom: str = "one"
    low: int | None = None
    high: int | None = None
    least: int = 0


#: The base verdict; its bounds are part of the result's contract.
BASE = (
    Rule("few_words", "n_words", low=1000),
    Rule("repeats", "n_repeat_words", "n_words", high=20),
)
#: Measures are columns of `measures`; bounds are percent.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=150, high=2000),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("exclamations", "n_exclamations", "n_words", high=30),
    Rule("stop_words", "n_stop_words", low=200, least=60),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=50),
)


def _bound(value: Column, body) -> Column:
    """`body` over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first one included."""
    def windows(w: Column) -> Column:
        return F.when(F.size(w) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])))

    def starts(hashes: Column) -> Column:
        """Places of repeated windows, in order: neighbours in hash order with equal hash."""
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _bound(ordered, lambda s: F.sort_array(F.filter(
            F.transform(s, lambda x, k: F.when(
                (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull())))

    def covered(hashes: Column) -> Column:
        return _bound(starts(hashes), lambda s: F.aggregate(
            F.transform(s, lambda i, k: F.least(F.coalesce(F.get(s, k + 1) - i, F.lit(5)), F.lit(5))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    return _bound(words, lambda w: _bound(windows(w), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, measures): each row of `docs` as it is and what is counted in it; a null text has no words."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.regexp_count(value, F.lit("!")).cast("long").alias("n_exclamations"),
            F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.lit(1).cast("long").alias("one"))

    words = F.array_remove(F.split(value, SPACE_SPLIT), "")
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(WORD))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), _bound(words, lambda w: _bound(lines, lambda x: of(w, x))).alias("measures"))


def failed(rules: tuple[Rule, ...], measured: str = "measures") -> Column:
    """True where any rule of the table is broken."""
    def broken(rule: Rule) -> Column:
        top, bottom = F.col(f"{measured}.{rule.top}") * 100, F.col(f"{measured}.{rule.bottom}")
        tests = [] if rule.low is None else [top < rule.low * bottom]
        tests += [] if rule.high is None else [top > rule.high * bottom]
        return reduce(Column.__or__, tests) & (F.col(f"{measured}.n_words") >= rule.least)

    return reduce(Column.__or__, map(broken, rules))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, measures, base_failed, kept) of each row of `docs`; `row` holds its columns, whatever their names.

    Null, empty and blank texts have no words and fail. Every row is judged on its own whole text, so copies get
    the same verdict; an empty table stays empty.
    """
    return measures(docs, text).withColumns({
        "base_failed": failed(BASE), "kept": ~(failed(BASE) | failed(rules))})


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only the rows that pass, with their own columns."""
    return judge(docs, text).where("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])
