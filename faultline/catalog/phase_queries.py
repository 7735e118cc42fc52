"""Prompts, response contracts and the phases, fed with ledger views instead of a labeller."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog import sql as S
from faultline.catalog.dictionary_queries import entries, grouped
from faultline.catalog.labeller import prompt_hashes
from faultline.catalog.registry import query
from faultline.catalog.row_queries import wo
from faultline.catalog.taxonomy_queries import members
from faultline.catalog.views import CONFIG, view
from faultline.config import ROUTE_BYPASSED
from faultline.functions import contract as C
from faultline.operators import hooks, merge, prompts, routing, taxonomy
from faultline.operators.dictionary import long_entries, mode_lines
from faultline.operators.sizes import broadcast_if_small
from faultline.plans import codes, labels
from faultline.sources.scratch import stored

c = F.col
RULES = CONFIG.rules


# ---- contracts

def checked(spark, d, name, contract, **frames):
    return C.check_response(view(spark, d, name, **frames), contract)


def _contract_query(name, view_name, contract, fields, keep="row_id", **frames):
    keys = [k.strip() for k in keep.split(",")]
    query(name, f"SELECT {keep}, status, reason FROM ({S.checked(view_name, fields, keep)})")(
        lambda s, d: checked(s, d, view_name, contract, **{n: f(s, d) for n, f in frames.items()}).select(
            *keys, "status", "reason"))


_contract_query("check_response", "ledger", C.CLASSIFICATION, S.CLASSIFY, "row_id, phase")
query("check_classify", "SELECT row_id, " + ", ".join([
    f"CASE WHEN status = 'ok' THEN {S.s_(k)} END AS {a}" for k, a in
    (("Suggested_Code", "code"), ("Reasoning", "reasoning"), ("Confidence_Score", "confidence"))])
    + f", CASE WHEN status = 'ok' THEN {S.b_('Review_Flag')} END AS flag FROM checked_p1 WHERE status = 'ok'")(
    lambda s, d: checked(s, d, "ledger", C.CLASSIFICATION).where("phase = 'P1' AND status = 'ok'").select(
        "row_id", C.text_at("Suggested_Code").alias("code"), C.text_at("Reasoning").alias("reasoning"),
        C.text_at("Confidence_Score").alias("confidence"), C.flag_at("Review_Flag").alias("flag")))
_contract_query("check_audit", "audit_ledger", C.AUDIT, S.AUDIT)
_contract_query("check_dictionary", "batch_ledger", C.EXTRACTION, S.EXTRACTION, "code, topology, piece", grouped=grouped)
query("check_response_extra", "SELECT row_id, n.reason AS novel_reason, k.reason AS clustering_reason FROM "
      f"({S.checked('op_ledger', S.NOVEL)}) n JOIN ({S.checked('op_ledger', S.CLUSTERING)}) k USING (row_id)")(
    lambda s, d: C.check_response(
        checked(s, d, "op_ledger", C.NOVEL_FAILURE).withColumnRenamed("reason", "novel_reason").drop("status", "answer"),
        C.ACTION_CLUSTERING).select("row_id", "novel_reason", c("reason").alias("clustering_reason")))


def named_rows(spark, d, known):
    return labels.operational_rows(labels.with_label_parts(grouped(spark, d), CONFIG), known, CONFIG)


def option_inputs(spark, d):
    """Rows with their options hash, and what answers may say for each, both computed once."""
    known = stored(entries(spark, d), "entries")
    may = labels.allowed(stored(long_entries(known), "long"), known, RULES)
    return (stored(named_rows(spark, d, known).select("row_id", "code", "skip", "options_key"), "rows"),
            broadcast_if_small(may, CONFIG.limits.broadcast_bytes))


def with_key(answers, rows):
    return answers.join(rows.select("row_id", "options_key"), "row_id")


def checked_first(spark, d, rows, options):
    return labels.check_operational(with_key(view(spark, d, "op_ledger"), rows), options)


def checked_second(spark, d, rows, options):
    return labels.check_semantic(with_key(view(spark, d, "sem_ledger"), rows), options, RULES)


query("check_action", "SELECT row_id, reason FROM op_ok")(
    lambda s, d: checked_first(s, d, *option_inputs(s, d)).select("row_id", "reason"))
query("check_mode", "SELECT row_id, reason FROM sem_ok")(
    lambda s, d: checked_second(s, d, *option_inputs(s, d)).select("row_id", "reason"))
query("failure_selection", "SELECT row_id, " + ", ".join(
    f"CASE WHEN json_type(j, '$.Failure_Mode_Selection') = 'OBJECT' THEN CASE WHEN json_type(j, '$.Failure_Mode_Selection.{m}') <> 'NULL' THEN {S.s_('Failure_Mode_Selection.' + m)} END ELSE {S.s_(m)} END AS {m.lower()}"
    for m in S.MODE_KEYS) + f" FROM ({S.checked('sem_ledger', S.SEMANTIC)})")(
    lambda s, d: checked(s, d, "sem_ledger", C.SEMANTIC).select(
        "row_id", *[C.failure_selection(m).alias(m.lower()) for m in S.MODE_KEYS]))


# ---- phases over ledger views

def p1_rows(spark, d):
    answers = checked(spark, d, "ledger", C.CLASSIFICATION).where("phase = 'P1'")
    return codes.apply_correction(routing.with_route(wo(spark, d), CONFIG.taxonomy), answers, "row_id", "row_id")


def p2_rows(spark, d):
    return codes.apply_audit(p1_rows(spark, d), checked(spark, d, "audit_ledger", C.AUDIT), "row_id", "row_id")


def p2b_rows(spark, d):
    answers = checked(spark, d, "ledger", C.CLASSIFICATION).where("phase = 'P2_RELABEL'")
    return codes.apply_relabel(p2_rows(spark, d), answers, "row_id", "row_id")


query("phase1", """SELECT row_id, p1_status AS status, p1_done AS complete, exempt, p1_code AS code, p1_suggested AS suggested, p1_reasoning AS reasoning,
  p1_confidence AS confidence, p1_flag AS flag, CASE WHEN p1_done THEN route END AS workflow FROM p1x""")(
    lambda s, d: p1_rows(s, d).select(
        "row_id", c("P1_Status").alias("status"), F.coalesce("P1_Complete", F.lit(False)).alias("complete"),
        c("P1_Audit_Exempt").alias("exempt"), c("P1_System_Code").alias("code"), c("P1_Suggested_Code").alias("suggested"),
        c("P1_Reasoning").alias("reasoning"), c("P1_Confidence").alias("confidence"), c("P1_Review_Flag").alias("flag"),
        c("P1_Workflow").alias("workflow")))
query("audit_select", "SELECT row_id, NOT exempt AS to_audit, CASE WHEN exempt THEN p2_reasoning END AS fixed_reason FROM p2")(
    lambda s, d: p2_rows(s, d).select(
        "row_id", routing.needs_audit().alias("to_audit"),
        F.when(~routing.needs_audit(), c("P2_Reasoning")).alias("fixed_reason")))
query("phase2", "SELECT row_id, p2_complete AS complete, p2_reasoning AS reasoning, p2_confidence AS confidence, p2_relabel AS relabel FROM p2")(
    lambda s, d: p2_rows(s, d).select(
        "row_id", c("P2_Audit_Complete").alias("complete"), c("P2_Reasoning").alias("reasoning"),
        c("P2_Confidence").alias("confidence"), c("P2_Requires_Relabel").alias("relabel")))
query("relabel_select", "SELECT row_id FROM p2b WHERE to_relabel")(
    lambda s, d: p2_rows(s, d).where(routing.needs_relabel()).select("row_id"))
query("phase2b", "SELECT row_id, CASE WHEN NOT coalesce(to_relabel, false) THEN 'not_needed' WHEN p2b_complete THEN 'ok' ELSE 'other' END AS status, p2b_complete AS complete, p2b_code AS code, p2b_suggested AS suggested, p2b_reasoning AS reasoning, p2b_confidence AS confidence, p2b_flag AS flag FROM p2bx")(
    lambda s, d: p2b_rows(s, d).select("row_id", F.when(c("P2_Relabel_Status").isin("ok", "not_needed"), c("P2_Relabel_Status")).otherwise("other").alias("status"),
        c("P2_Relabel_Complete").alias("complete"), *[
        c(f"P2_Relabel_{n}").alias(a) for n, a in (("System_Code", "code"), ("Suggested_Code", "suggested"),
                                                 ("Reasoning", "reasoning"), ("Confidence", "confidence"), ("Review_Flag", "flag"))]))
query("merge_codes", f"SELECT wo_id, row_id, system_code AS legacy_system_code, merged_code AS merged_system_code, "
      f"{S.norm('system_code')} IS DISTINCT FROM merged_code AND merged_code IS NOT NULL AS corrected FROM merged")(
    lambda s, d: merge.merge_codes(p2b_rows(s, d), RULES.code_gate).select(
        "wo_id", "row_id", c("Legacy_System_Code").alias("legacy_system_code"),
        c("Merged_System_Code").alias("merged_system_code"), c("System_Code_Corrected_Flag").alias("corrected")))


def p4_half(spark, d, rows, options):
    return labels.apply_operational(rows, checked_first(spark, d, rows, options), RULES, "row_id", "row_id")


def p4_rows(spark, d):
    rows, options = option_inputs(spark, d)
    return labels.apply_semantic(
        p4_half(spark, d, rows, options), checked_second(spark, d, rows, options), RULES, "row_id", "row_id")


query("phase4", """SELECT row_id, CASE WHEN done THEN code END AS code, CASE WHEN done THEN m_type END AS maintenance_type, CASE WHEN done THEN action END AS action,
  failure_mode, mechanism, cause, symptom, reasoning, conf AS confidence, review AS flag, CASE WHEN done THEN op_conf END AS op_confidence,
  CASE WHEN done THEN op_flag END AS op_review, sem_conf AS sem_confidence, sem_flag AS sem_review FROM p4x""")(
    lambda s, d: p4_rows(s, d).select("row_id", *[c(f"P4_{n}").alias(a) for n, a in (
        ("System_Code", "code"), ("Maintenance_Type", "maintenance_type"), ("Action_Taken", "action"),
        ("Failure_Mode", "failure_mode"), ("Mechanism", "mechanism"), ("Cause", "cause"), ("Symptom", "symptom"),
        ("Reasoning", "reasoning"), ("Confidence", "confidence"), ("Review_Flag", "flag"),
        ("Operational_Confidence", "op_confidence"), ("Operational_Review_Flag", "op_review"),
        ("Semantic_Confidence", "sem_confidence"), ("Semantic_Review_Flag", "sem_review"))]))
query("code_guard", f"SELECT row_id, CASE WHEN skip OR op_good THEN code END AS code, op_done AND {S.strip(S.s_('System_Code', 'oj'))} <> code AS mismatch FROM op_half")(
    lambda s, d: p4_half(s, d, *option_inputs(s, d)).select(
        "row_id", c("P4_System_Code").alias("code"), c("code_mismatch").alias("mismatch")))


# ---- prompts

AUDIT_PARTS = {"legacy_system_name": S.unknown("system_name"), "legacy_system_code": S.unknown("system_code"),
          "log_description": "descriptions", "topology_context_block": S.block(S.topo_context("spec"))}
WITH_SPEC = f"(SELECT *, {S.topo_column('system_code', 'system_name', 'descriptions')} AS spec FROM routed)"


CLASSIFIED = f"""(SELECT w.row_id, {S.render(prompts.CLASSIFY, {**AUDIT_PARTS, 'taxonomy_text': 'b.text'})} AS prompt
  FROM {WITH_SPEC} w JOIN row_branches r ON w.row_id = r.row_id JOIN branches b ON r.branch = b.branch WHERE w.route <> 'Bypassed')"""


@query("prompt_classify", f"SELECT row_id, md5(prompt) AS prompt_md5 FROM {CLASSIFIED}")
def _prompt_classify(spark, d):
    """The prompts' pieces, hashed beside the texts of the branches that rows ask for. Rows are dealt by their own number:
    branches are few, and dealt by branch most rows would meet their text in a handful of tasks."""
    asking = stored(routing.with_route(wo(spark, d), CONFIG.taxonomy), "routed").where(c("route") != ROUTE_BYPASSED)
    wanted = asking.select(taxonomy.row_branch(c("system_code"), c("descriptions"), CONFIG.taxonomy).alias("branch"))
    texts = stored(taxonomy.branch_texts(members(spark, d), CONFIG.limits, wanted), "texts")
    named = codes.correction_rows(codes.with_prompt_parts(asking, CONFIG), texts, CONFIG).where("P1_branch_problem IS NULL")
    asked = named.select(c("row_id").cast("string").alias("row_id"), c("P1_branch").alias("shared"), codes.classify_pieces(CONFIG).alias("pieces"))
    dealt = hooks.deal_shared(asked, texts.select(c("branch").alias("shared"), "text"), c("row_id"),
                              int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInPandas(prompt_hashes, "row_id string, prompt_md5 string").withColumn(
        "row_id", c("row_id").cast(named.schema["row_id"].dataType))


query("prompt_audit", f"SELECT row_id, md5({S.render(prompts.AUDIT, AUDIT_PARTS)}) AS prompt_md5 FROM {WITH_SPEC} WHERE route = 'Bypassed'")(
    lambda s, d: codes.with_prompt_parts(routing.with_route(wo(s, d), CONFIG.taxonomy), CONFIG).where(
        routing.needs_audit()).select("row_id", F.md5(codes.audit_prompt(CONFIG)).alias("prompt_md5")))
_OP = {"system_name": S.unknown("system_name"), "system_code": "code", "topology_context_block": S.key_block("topology"),
       "log_description": S.strip("descriptions")}
_LISTED = "array_to_string(list_transform(mode_choices, lambda m: '- ' || CAST(to_json(m) AS VARCHAR)), chr(10))"
_MODE_TEXT = f"CASE WHEN len(mode_choices) > 0 THEN {_LISTED} || chr(10) || 'or one of: Other Novel Failure, Not Enough Information' ELSE 'Other Novel Failure, Not Enough Information' END"


def option_rows(spark, d):
    known = stored(entries(spark, d), "entries")
    rows = stored(named_rows(spark, d, known).drop("P4_OPERATIONAL_call"), "rows")
    options = broadcast_if_small(labels.option_sets(known, RULES), CONFIG.limits.broadcast_bytes)
    return rows.join(options, "options_key").withColumns(labels.prompt_parts(CONFIG))


query("prompt_operational", f"SELECT row_id, {S.render(prompts.OPERATIONAL, {**_OP, 'valid_actions_list': 'array_to_string(action_choices, chr(44) || chr(32))'})} AS prompt FROM row_options")(
    lambda s, d: option_rows(s, d).select("row_id", labels.operational_prompt(CONFIG).alias("prompt")))
query("prompt_semantic", f"SELECT row_id, {S.render(prompts.SEMANTIC, {**_OP, 'valid_failure_modes_list': _MODE_TEXT, 'maintenance_type': 'maintenance_type', 'action_taken': 'action_type'})} AS prompt FROM row_options")(
    lambda s, d: option_rows(s, d).withColumn("action_taken", c("action_type")).select(
        "row_id", labels.semantic_prompt(CONFIG).alias("prompt")))
query("format_modes", f"SELECT row_id, {_LISTED} AS value FROM row_options")(
    lambda s, d: option_rows(s, d).select("row_id", mode_lines(c("mode_choices")).alias("value")))
