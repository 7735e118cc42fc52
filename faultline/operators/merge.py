"""Merges that accept a label only when it passed its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import QA_FLAGGED, QA_LOW, QA_PASS, Gate, Rules
from faultline.functions.flags import coerce_flag, passes, reaches
from faultline.functions.text import is_unusable_code, normalise

MODE_COLUMNS = ("Failure_Mode", "Mechanism", "Cause", "Symptom")


def _changed(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after) & after.isNotNull()


def merge_codes(rows: DataFrame, gate: Gate) -> DataFrame:
    """Legacy_System_Code, Merged_System_Code and System_Code_Corrected_Flag.

    An exempt row's P1 code comes first, then the relabelled code, then P1, then the old code.
    """
    c = F.col
    legacy, p1, p2 = (normalise(c(n)) for n in ("system_code", "P1_System_Code", "P2_Relabel_System_Code"))

    def good(code: Column, source: str) -> Column:
        return ~is_unusable_code(code) & passes(c(f"{source}_Confidence"), c(f"{source}_Review_Flag"), gate)

    p1_good = good(p1, "P1")
    merged = F.coalesce(
        F.when(coerce_flag(c("P1_Audit_Exempt")) & p1_good, p1)
        .when(good(p2, "P2_Relabel"), p2).when(p1_good, p1), legacy)
    earlier = c("Legacy_System_Code") if "Legacy_System_Code" in rows.columns else c("system_code")
    return rows.withColumns({
        "Legacy_System_Code": earlier,
        "Merged_System_Code": merged,
        "System_Code_Corrected_Flag": _changed(legacy, merged),
    })


def merge_labels(rows: DataFrame, rules: Rules) -> DataFrame:
    """Maintenance type and action, each behind its own gate on the operational pair."""
    c = F.col
    added = {}
    for label, legacy, gate in (
        ("Maintenance_Type", "maintenance_type", rules.type_gate),
        ("Action_Taken", "action_type", rules.action_gate),
    ):
        kept = f"Legacy_{label}"
        merged = F.when(
            passes(c("P4_Operational_Confidence"), c("P4_Operational_Review_Flag"), gate), c(f"P4_{label}")
        ).otherwise(c(legacy))
        added[kept] = F.coalesce(c(kept), c(legacy)) if kept in rows.columns else c(legacy)
        added[f"Merged_{label}"] = merged
        added[f"{label}_Corrected_Flag"] = _changed(normalise(c(legacy)), normalise(merged))
    return rows.withColumns(added)


def merge_failures(rows: DataFrame, rules: Rules) -> DataFrame:
    """The four failure fields, gated on the semantic pair only when that is switched on."""
    ok = F.lit(True)
    if rules.enforce_mode_gate:
        ok = passes(F.col("P4_Semantic_Confidence"), F.col("P4_Semantic_Review_Flag"), rules.mode_gate)
    return rows.withColumns({f"Merged_{n}": F.when(ok, F.col(f"P4_{n}")) for n in MODE_COLUMNS})


def with_qa_status(rows: DataFrame, gate: Gate) -> DataFrame:
    flagged = F.lit(False) if gate.allow_flags else coerce_flag(F.col("P4_Review_Flag"))
    return rows.withColumn(
        "QA_Status",
        F.when(~reaches(F.col("P4_Confidence"), gate.required), QA_LOW)
        .when(flagged, QA_FLAGGED).otherwise(QA_PASS))
