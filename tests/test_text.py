"""Text, code and flag expressions on the edge rows."""

import pytest
from pyspark.sql import functions as F

from faultline.config import Gate, Redaction, Rules
from faultline.errors import ConfigError
from faultline.functions import flags, text
from faultline.operators import hooks, routing

x = F.col("x")


def test_strip_removes_what_python_strips(values):
    texts = [None, "", "  ", " a ", "\x1cb\x85", "​c"]
    assert values(texts, text.strip(x)) == [t if t is None else t.strip() for t in texts]


def test_normalise(values):
    assert values([None, " ", " a b ", "\t"], text.normalise(x)) == [None, None, "a b", None]


def test_active_code(spark):
    rows = spark.createDataFrame([(" ", " L "), ("M ", "L"), (None, None)], "m string, l string")
    assert [r[0] for r in rows.select(text.active_code(F.col("m"), F.col("l"))).collect()] == ["L", "M", None]


def test_system_prefix(values):
    assert values([None, " ", "=G1", "=G1  MDA10 GP", "=G1 MDA"], text.system_prefix(x)) == [
        None, None, "=G1", "MDA10", "MDA"]


@pytest.mark.parametrize("prefixes, expected", [
    (["MDA"], [False, False, True, True]),
    (["=G1"], [False, False, True, False]),
    ([" ", ""], [False] * 4),
    ([], [False] * 4),
])
def test_prefix_match(values, prefixes, expected):
    assert values([None, " ", "=G1 MDA10", "MDA10"], text.prefix_match(x, prefixes)) == expected


def test_contains_any(values):
    assert values([None, "a PITCHfork", "yaw"], text.contains_any(x, ["pitch"])) == [False, True, False]


def test_mentions_word(values):
    texts = ["épitch", "a pitché", "_pitch", "x-Ptch9", None, "PICH", "a.b"]
    assert values(texts, text.mentions_word(x, ["pitch", "pich", "ptch"])) == [
        False, True, False, True, False, True, False]
    assert values(texts, text.mentions_word(x, [" ", ""])) == [False] * 7
    assert values(["axb", "a.b"], text.mentions_word(x, ["a.b"])) == [False, True]
    # letters that equal ASCII ones without regard to case, and keywords beyond ASCII
    assert values(["p\u0131tch", "K\u0131", "x"], text.mentions_word(x, ["pitch"])) == [True, False, False]
    assert values(["\u212aey", "\u017fee"], text.mentions_word(x, ["Key", "see"])) == [True, True]
    assert values(["ÉTÉ", "ete"], text.mentions_word(x, ["été"])) == [True, False]


def test_missing_and_unusable_codes(values):
    texts = [None, " ", "NaN", " Unknown", "none", "=G1", "Keep Current ", "not enough information"]
    assert values(texts, text.is_missing_code(x)) == [True] * 5 + [False] * 3
    assert values(texts, text.is_unusable_code(x)) == [True, True, False, False, False, False, True, True]


def test_resolve_suggestion(values):
    assert values([" keep CURRENT", "=G2", None], text.resolve_suggestion(x, F.lit("old"))) == ["old", "=G2", None]


def test_coerce_flag(values):
    texts = [None, "true", " Yes ", "0", "0.0", "maybe", " ", "None", "N"]
    assert values(texts, flags.coerce_flag(x)) == [False, True, True, False, True, True, False, False, False]
    assert values([None, True, False], flags.coerce_flag(x), "boolean") == [False, True, False]
    assert values([None, 0.0, 0.5], flags.coerce_number_flag(x), "double") == [False, False, True]


def test_is_unprocessed(values):
    assert values([None, "", " False", "0", "nan", "1", "done"], flags.is_unprocessed(x)) == [True] * 5 + [False] * 2


@pytest.mark.parametrize("gate, expected", [
    (Gate(), [True, False, False, False]),
    (Gate("Low"), [True, True, False, False]),
    (Gate("Bogus"), [True, False, False, False]),
    (Gate(None), [True, True, True, True]),
])
def test_gate(values, gate, expected):
    assert values(["High", "Low", "Certain", None], flags.passes(x, F.lit("no"), gate)) == expected


def test_gate_flags(values):
    assert values(["true", None], flags.passes(F.lit("High"), x, Gate())) == [False, True]
    assert values(["true"], flags.passes(F.lit("High"), x, Gate(allow_flags=True))) == [True]


def test_lower_confidence(spark):
    rows = spark.createDataFrame([("High", "High"), ("Low", "High"), ("High", None)], "a string, b string")
    assert [r[0] for r in rows.select(flags.lower_confidence(F.col("a"), F.col("b"))).collect()] == ["High", "Low", None]


def test_uninformative(values):
    assert values([None, "abcd", "abcde", "     ", " ab "], routing.is_uninformative(x)) == [
        True, True, False, True, True]


def test_non_failure(values):
    assert values(["Preventive", " Retrofit", "Reset", None], routing.is_non_failure(x, Rules())) == [
        True, True, False, False]
    assert values(["Preventive"], routing.is_non_failure(x, Rules(skip_non_failure=False))) == [False]


def test_strip_fence(values):
    texts = ['```json\n{"a":1}\n```', " {} ", "```{}```", None, "json {}"]
    assert values(texts, text.strip_fence(x)) == ['{"a":1}', "{}", "{}", None, "json {}"]


def test_redaction_groups_and_literal_dollars(values):
    rules = Redaction(True, (r"call (?P<who>\w+)",), r"[\g<who>$]")
    assert values(["call Bob 12"], text.redact(x, rules)) == ["[Bob$] 12"]
    assert values(["a1"], text.redact(x, Redaction(False, ("a",), "b"))) == ["a1"]


def test_bad_redaction_patterns(spark):
    assert [p for p, _ in text.usable_patterns(Redaction(True, ("(unclosed", r"\d+"), "#"))] == [r"(?U)\d+"]
    # a conditional group is a regular expression in Python and none in the JVM
    with pytest.raises(ConfigError):
        text.usable_patterns(Redaction(True, (r"(a)?(?(1)b|c)",), "y"))


def test_custom_redactor_failure_keeps_text(values):
    def custom(t):
        if "boom" in t:
            raise RuntimeError("no")
        return t.upper()

    rules = Redaction(True, ("B",), "#", custom)
    assert values(["ab", "boom", None, ""], hooks.redact_text(x, rules)) == ["A#", "boom", None, ""]
