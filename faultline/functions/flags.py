"""Flags, confidence levels and the gate that combines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.config import CONFIDENCE_SCORES, Gate
from faultline.functions.text import strip

# Texts that read as false; any other text is true.
FALSE_TEXTS = ("false", "0", "no", "n", "", "nan", "none")
UNPROCESSED_TEXTS = ("", "false", "0", "nan", "none")


def coerce_flag(c: Column) -> Column:
    """Flag column of type boolean or string as a plain true / false."""
    text = F.lower(strip(c.cast("string")))
    return F.coalesce(~text.isin(*FALSE_TEXTS), F.lit(False))


def coerce_number_flag(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def is_unprocessed(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c.cast("string"))).isin(*UNPROCESSED_TEXTS)


def confidence_score(c: Column) -> Column:
    scored = F
    for level, score in CONFIDENCE_SCORES.items():
        scored = scored.when(c == level, score)
    return scored.otherwise(0)


def reaches(confidence: Column, required: str | None) -> Column:
    needed = 0 if required is None else CONFIDENCE_SCORES.get(required, 3)
    return confidence_score(confidence) >= needed


def passes(confidence: Column, flag: Column, gate: Gate) -> Column:
    ok = reaches(confidence, gate.required)
    return ok if gate.allow_flags else ok & ~coerce_flag(flag)


def lower_confidence(first: Column, second: Column) -> Column:
    """The lower of two levels; the second on a tie."""
    return F.when(confidence_score(first) < confidence_score(second), first).otherwise(second)
