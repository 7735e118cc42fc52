"""Which rows each phase handles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import (
    AUDIT_SKIPPED_REASON, ROUTE_BYPASSED, ROUTE_MISSING, ROUTE_PITCH, Rules, TaxonomyRules,
)
from faultline.functions.flags import coerce_flag
from faultline.functions.text import is_missing_code, mentions_word, strip


def route(description: Column, code: Column, rules: TaxonomyRules) -> Column:
    return (F.when(mentions_word(description, rules.pitch_keywords), ROUTE_PITCH)
            .when(is_missing_code(code), ROUTE_MISSING)
            .otherwise(ROUTE_BYPASSED))


def with_route(rows: DataFrame, rules: TaxonomyRules) -> DataFrame:
    """Adds `route` and `P1_Audit_Exempt`."""
    return (rows.withColumn("route", route(F.col("descriptions"), F.col("system_code"), rules))
            .withColumn("P1_Audit_Exempt", F.col("route") != ROUTE_BYPASSED))


def needs_audit() -> Column:
    return ~coerce_flag(F.col("P1_Audit_Exempt"))


def audit_defaults(confidence: Column, reasoning: Column, flag: Column, complete: Column) -> dict[str, Column]:
    """Audit columns: fixed values on exempt rows, the audit's own elsewhere."""
    audit = needs_audit()
    return {
        "P2_Audit_Complete": F.when(audit, complete).otherwise(F.lit(True)),
        "P2_Reasoning": F.when(audit, reasoning).otherwise(AUDIT_SKIPPED_REASON),
        "P2_Confidence": F.when(audit, confidence).otherwise("High"),
        "P2_Requires_Relabel": F.when(audit, flag).otherwise(F.lit(False)),
    }


def needs_relabel() -> Column:
    """Flagged by the audit and not exempt; the audit's confidence plays no part."""
    return coerce_flag(F.col("P2_Requires_Relabel")) & needs_audit()


def is_uninformative(description: Column) -> Column:
    """Fewer than five characters after trimming."""
    return F.length(strip(F.coalesce(description, F.lit("")))) < 5


def is_non_failure(maintenance_type: Column, rules: Rules) -> Column:
    """A maintenance type for which no failure is looked for."""
    types = [t.strip() for t in rules.non_failure_types if t and t.strip()]
    if not rules.skip_non_failure or not types:
        return F.lit(False)
    return F.coalesce(strip(maintenance_type).isin(*types), F.lit(False))
