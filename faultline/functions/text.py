"""Text and code expressions with Python's notion of whitespace, words and truth."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from faultline.config import Redaction
from faultline.errors import ConfigError

log = logging.getLogger(__name__)

# Every character that Python's str.strip() removes.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WHITESPACE_RUN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]+"

# The texts a CSV reader in Python takes for "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Texts that mean "no code" and "no usable suggestion".
MISSING_CODES = ("", "nan", "none", "unknown")
UNUSABLE_SUGGESTIONS = ("not enough information", "keep current")


def any_of(conditions: Sequence[Column]) -> Column:
    """OR of all conditions, false when there is none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def normalise(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def or_unknown(c: Column) -> Column:
    return F.coalesce(normalise(c), F.lit("Unknown"))


def active_code(merged: Column, legacy: Column) -> Column:
    return F.coalesce(normalise(merged), normalise(legacy))


def tokens(code: Column) -> Column:
    return F.split(normalise(code), WHITESPACE_RUN)


def system_prefix(code: Column) -> Column:
    """Second token of a code, else the first."""
    parts = tokens(code)
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


def clean_prefixes(prefixes: Sequence[str]) -> list[str]:
    return [p.strip() for p in map(str, prefixes) if p.strip()]


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    return F.coalesce(any_of([c.startswith(p) for p in clean_prefixes(prefixes)]), F.lit(False))


def prefix_match(code: Column, prefixes: Sequence[str]) -> Column:
    """Does the code, or its system part, start with one of the prefixes?"""
    return starts_with_any(system_prefix(code), prefixes) | starts_with_any(normalise(code), prefixes)


def contains_any(c: Column, keywords: Sequence[str]) -> Column:
    lowered = F.lower(c)
    return F.coalesce(any_of([lowered.contains(k) for k in keywords]), F.lit(False))


def escape_regex(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


# The only other characters that equal an ASCII letter when case is ignored (i, i, s, k).
FOLDS_TO_ASCII = ("\u0131", "\u0130", "\u017f", "\u212a")


def mentions_word(c: Column, keywords: Sequence[str]) -> Column:
    """A word that begins with one of the keywords, in any case and any script.

    A plain substring search comes first: most texts fail it, and it is many times cheaper than
    the regular expression, which decides only about the rest.
    """
    words = clean_prefixes(keywords)
    if not words:
        return F.lit(False)
    pattern = r"(?iU)\b(" + "|".join(map(escape_regex, words)) + r")\w*\b"
    found = c.rlike(pattern)
    if all(w.isascii() for w in words):
        lowered = F.lower(c)
        maybe = any_of([*[lowered.contains(w.lower()) for w in words], *[c.contains(x) for x in FOLDS_TO_ASCII]])
        found = maybe & found
    return F.coalesce(found, F.lit(False))


def is_missing_code(code: Column) -> Column:
    return code.isNull() | F.lower(strip(code)).isin(*MISSING_CODES)


def is_unusable_code(code: Column) -> Column:
    cleaned = normalise(code)
    return cleaned.isNull() | F.lower(cleaned).isin(*UNUSABLE_SUGGESTIONS)


def resolve_suggestion(suggested: Column, existing: Column) -> Column:
    """The existing code when the answer was to keep it, else the answer."""
    return F.when(F.lower(strip(suggested)) == "keep current", existing).otherwise(suggested)


def strip_fence(c: Column) -> Column:
    """Response text without a Markdown code fence around it."""
    bare = strip(c)
    inner = strip(F.btrim(bare, F.lit("`")))
    inner = F.when(inner.startswith("json"), strip(F.substring(inner, 5, 2**31 - 1))).otherwise(inner)
    return F.when(bare.startswith("```"), inner).otherwise(bare)


def _java_pattern(pattern: str) -> str:
    return "(?U)" + re.sub(r"\(\?P<", "(?<", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))


def _java_replacement(replacement: str, groups: dict[str, int]) -> str:
    """Python's \\1, \\g<1>, \\g<name> as $1; every other $ and backslash stays literal."""
    out, last = [], 0
    for m in re.finditer(r"\\(?:g<(\w+)>|([1-9]\d?))", replacement):
        out.append(re.sub(r"([\\$])", r"\\\1", replacement[last:m.start()]))
        ref = m.group(1) or m.group(2)
        out.append(f"${ref if ref.isdigit() else groups[ref]}")
        last = m.end()
    out.append(re.sub(r"([\\$])", r"\\\1", replacement[last:]))
    return "".join(out)


def usable_patterns(redaction: Redaction) -> list[tuple[str, str]]:
    """(pattern, replacement) pairs in the JVM's syntax, tried out before the job starts.

    A pattern that is no regular expression is skipped with a warning. One that only the JVM
    rejects stops the run: leaving private text in place unasked would be worse.
    """
    pairs = []
    for pattern in redaction.patterns:
        try:
            compiled = re.compile(pattern)
            pair = (_java_pattern(pattern),
                    _java_replacement(redaction.replacement, dict(compiled.groupindex)))
        except (re.error, KeyError) as error:
            log.warning("redaction pattern skipped (%s): %s", pattern, error)
            continue
        spark = SparkSession.active()
        try:
            spark.range(1).select(F.regexp_replace(F.lit("x"), *map(F.lit, pair))).collect()
        except Exception as error:
            raise ConfigError(f"redaction pattern not usable in the JVM: {pattern}") from error
        pairs.append(pair)
    return pairs


def redact(c: Column, redaction: Redaction) -> Column:
    """Ordered pattern replacement; see operators.hooks for the custom step before it."""
    if not redaction.enabled:
        return c
    return reduce(lambda acc, pair: F.regexp_replace(acc, F.lit(pair[0]), F.lit(pair[1])),
                  usable_patterns(redaction), c)
