"""Response contracts: which keys an answer must hold, of which JSON type, with which values.

A check yields NULL for a good answer, else '<path>: <reason>' for the first problem: field
types and values in declared order, then missing keys, then keys nobody asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import MAINTENANCE_TYPES
from faultline.functions.text import strip_fence


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    allowed: tuple[str, ...] = ()
    members: tuple[Field, ...] = ()


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]


# The response contracts.
QA_FIELDS = (
    Field("Reasoning", "string"),
    Field("Confidence_Score", "string", ("High", "Medium", "Low")),
    Field("Review_Flag", "boolean"),
)
MODE_FIELDS = tuple(Field(n, "string") for n in ("Failure_Mode", "Mechanism", "Cause", "Symptom"))
EXTRACTED_MODE_FIELDS = (
    Field("Failure_Mode", "string"),
    Field("Mechanism", "string"),
    Field("Cause", "string"),
    Field("Symptom_Effect", "string"),
    Field("Frequency_in_Logs", "integer"),
)
CLASSIFICATION = Contract(
    "system_code_classification", (Field("Suggested_Code", "string"), *QA_FIELDS))
AUDIT = Contract("system_code_audit", QA_FIELDS)
EXTRACTION = Contract("fmea_dictionary_extraction", (
    Field("System_Code", "string"),
    Field("System_Name", "string"),
    Field("Topology", "string or null"),
    Field("Total_Logs_Analyzed", "integer"),
    Field("Unclassified_Logs_Count", "integer"),
    Field("Empirical_Actions_Taken", "array of strings"),
    Field("Failure_Modes", "array of objects", members=EXTRACTED_MODE_FIELDS),
    *QA_FIELDS,
))
OPERATIONAL = Contract("operational_labelling", (
    Field("System_Code", "string"),
    Field("Maintenance_Type", "string", MAINTENANCE_TYPES),
    Field("Action_Taken", "string"),
    *QA_FIELDS,
))
SEMANTIC = Contract("semantic_fmea_labelling", (
    Field("System_Code", "string"),
    Field("Failure_Mode_Selection", "object", members=MODE_FIELDS),
    *QA_FIELDS,
))
ACTION_CLUSTERING = Contract(
    "action_clustering", (Field("Standardized_New_Actions", "array of strings"), *QA_FIELDS))
NOVEL_FAILURE = Contract("novel_failure_generation", (
    Field("Action_Taken", "string"), *MODE_FIELDS, *QA_FIELDS))

CONTRACTS = {c.name: c for c in (
    CLASSIFICATION, AUDIT, EXTRACTION, OPERATIONAL, SEMANTIC, ACTION_CLUSTERING, NOVEL_FAILURE)}


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _as(v: Column, target: str) -> Column:
    return F.try_variant_get(v, "$", target)


def _object(v: Column) -> Column:
    return _as(v, "map<string,variant>")


def _is_integer(v: Column) -> Column:
    number = _as(v, "double")
    return (_type(v) == "BIGINT") | _type(v).rlike(r"^DECIMAL\(\d+,0\)$") | (
        _type(v).isin("DOUBLE", "FLOAT") & (number == F.floor(number)))


_KINDS: dict[str, Callable[[Column], Column]] = {
    "string": lambda v: _type(v) == "STRING",
    "string or null": lambda v: _type(v).isin("STRING", "VOID"),
    "boolean": lambda v: _type(v) == "BOOLEAN",
    "integer": _is_integer,
    "array of strings": lambda v: F.coalesce(
        F.forall(_as(v, "array<variant>"), lambda x: _type(x) == "STRING"), F.lit(False)),
}


def _key_problems(obj: Column, fields: Sequence[Field], path: str) -> list[Column]:
    names = F.array(*[F.lit(f.name) for f in fields])
    keys = F.map_keys(obj)
    missing, extra = F.array_except(names, keys), F.array_sort(F.array_except(keys, names))
    return [
        F.when(F.size(found) > 0,
               F.concat(F.lit(f"{path}: {word} "), F.array_join(found, ", ")))
        for found, word in ((missing, "missing"), (extra, "unexpected"))
    ]


def _matches(obj: Column, fields: Sequence[Field]) -> Column:
    """Whole-object test for members, where only yes or no is needed."""
    tests = [F.size(obj) == len(fields)]
    for f in fields:
        tests.append(_KINDS[f.kind](F.try_element_at(obj, F.lit(f.name))))
    result = tests[0]
    for t in tests[1:]:
        result = result & t
    return F.coalesce(result, F.lit(False))


def _field_problems(obj: Column, f: Field) -> list[Column]:
    v = F.try_element_at(obj, F.lit(f.name))
    expected = F.lit(f"{f.name}: expected {f.kind}")
    if f.kind == "object":
        inner = _object(v)
        return [F.when(v.isNotNull() & inner.isNull(), expected),
                *[p for m in f.members for p in _member_problems(inner, m, f.name)],
                *[F.when(inner.isNotNull(), p) for p in _key_problems(inner, f.members, f.name)]]
    if f.kind == "array of objects":
        items = _as(v, "array<variant>")
        good = F.transform(items, lambda x: _matches(_object(x), f.members))
        first_bad = F.array_position(good, False) - 1
        return [F.when(v.isNotNull() & items.isNull(), expected),
                F.when(first_bad >= 0, F.concat(F.lit(f"{f.name}."), first_bad.cast("string"),
                                                F.lit(": not a valid item")))]
    problems = [F.when(v.isNotNull() & ~_KINDS[f.kind](v), expected)]
    if f.allowed:
        problems.append(F.when(v.isNotNull() & ~_as(v, "string").isin(*f.allowed),
                               F.lit(f"{f.name}: not an allowed value")))
    return problems


def _member_problems(inner: Column, m: Field, path: str) -> list[Column]:
    v = F.try_element_at(inner, F.lit(m.name))
    return [F.when(v.isNotNull() & ~_KINDS[m.kind](v),
                   F.lit(f"{path}.{m.name}: expected {m.kind}"))]


def parse_response(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Adds `answer`, the response as VARIANT; NULL when it is not JSON."""
    return df.withColumn("answer", F.try_parse_json(strip_fence(F.col(raw))))


def check_response(df: DataFrame, contract: Contract, raw: str = "raw_response") -> DataFrame:
    """Adds `answer`, `status` (ok / invalid) and `reason`. Each response is parsed once."""
    parsed = parse_response(df, raw).withColumn("_object", _object(F.col("answer")))
    obj = F.col("_object")
    problems = [
        F.when(F.col(raw).isNull(), F.lit("<root>: empty response")),
        F.when(F.col("answer").isNull(), F.lit("<root>: not valid JSON")),
        F.when(obj.isNull(), F.lit("<root>: expected object")),
    ]
    for f in contract.fields:
        problems += _field_problems(obj, f)
    problems += _key_problems(obj, contract.fields, "<root>")
    return (parsed.withColumn("reason", F.coalesce(*problems))
            .withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("invalid"))
            .drop("_object"))


def also_require(df: DataFrame, ok: Column, reason: str) -> DataFrame:
    """Turns answers that passed so far into invalid ones where `ok` is not true."""
    bad = (F.col("status") == "ok") & ~F.coalesce(ok, F.lit(False))
    return (df.withColumn("reason", F.when(bad, F.lit(reason)).otherwise(F.col("reason")))
            .withColumn("status", F.when(bad, "invalid").otherwise(F.col("status"))))


def text_at(path: str, v: str = "answer") -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def flag_at(path: str, v: str = "answer") -> Column:
    return F.try_variant_get(v, f"$.{path}", "boolean")


def failure_selection(member: str, v: str = "answer") -> Column:
    """One of the four failure fields: from the nested selection object, else flat.

    Presence of the object decides, not of the field in it.
    """
    nested = F.try_variant_get(v, "$.Failure_Mode_Selection", "map<string,variant>")
    return F.when(nested.isNotNull(), text_at(f"Failure_Mode_Selection.{member}", v)).otherwise(
        text_at(member, v))


def exactly_one(listed: Column, escapes: Column, name: Column) -> Column:
    """A listed four-field mode, or the name of an escape mode with free fields; not both."""
    return listed != F.coalesce(F.array_contains(escapes, name), F.lit(False))


def check_action(options: Column, action: Column) -> Column:
    """Against a short list; long ones are joined (`plans.labels.check_operational`)."""
    return F.array_contains(options, action)


def check_mode(modes: Column, escapes: Column, selection: Column) -> Column:
    """Against a short list; long ones are joined (`plans.labels.check_semantic`)."""
    return exactly_one(F.coalesce(F.array_contains(modes, selection), F.lit(False)), escapes, selection["failure_mode"])
