"""Row-wise operators: text, codes, topology, routing, flags, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog import sql as S
from faultline.catalog.registry import query
from faultline.catalog.views import CONFIG, view
from faultline.config import Gate, Redaction, Rules
from faultline.functions import flags, text, topology
from faultline.operators import hooks, merge, prompts, routing
from faultline.operators.topology import with_topology
from faultline.sources.tables import load_work_orders, map_columns, write_csv
from faultline.sources.scratch import new_folder

c = F.col
COLUMNS = ("wo_id", "descriptions", "system_code", "system_name", "maintenance_type", "action_type",
           "manufacturer", "turbine_model", "drive_type", "generator_type", "pitch_type", "yaw_brake_type")


def wo(spark, d):
    return view(spark, d, "wo")


def per_row(name, sql_value, column, value="value"):
    """One value per work order."""
    query(name, f"SELECT row_id, {sql_value} AS {value} FROM wo")(
        lambda spark, d: wo(spark, d).select("row_id", column().alias(value)))


_na = ", ".join(map(S.q, text.NA_TOKENS))


@query("load_work_orders", "SELECT " + ", ".join(
    f"CASE WHEN {x} NOT IN ({_na}) THEN {x} END AS {x}" for x in COLUMNS) + " FROM wo")
def _load(spark, d):
    folder = new_folder(spark, "work-orders")
    write_csv(wo(spark, d).drop("row_id"), folder)
    return load_work_orders(spark, folder, required=["wo_id", "descriptions"])


@query("file_order", "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, wo_id FROM wo")
def _file_order(spark, d):
    """Files that hold the work orders in their order, read and numbered; names of files rise with the ranges."""
    folder = new_folder(spark, "work-orders")
    wo(spark, d).repartitionByRange(8, "row_id").sortWithinPartitions("row_id").drop("row_id").write.parquet(f"{folder}/first.parquet")
    return load_work_orders(spark, f"{folder}/first.parquet", numbered=True).select("row_id", "wo_id")


@query("map_columns", "SELECT wo_id AS row_id, " + ", ".join(COLUMNS[:-1]) + ", CAST(NULL AS VARCHAR) AS yaw_brake_type FROM wo")
def _map(spark, d):
    return map_columns(wo(spark, d).drop("row_id", "yaw_brake_type"), CONFIG.columns)


per_row("normalise_code", S.norm("system_code"), lambda: text.normalise(c("system_code")))
per_row("normalise_label", S.norm("maintenance_type"), lambda: text.normalise(c("maintenance_type")))
per_row("active_code", S.active("CASE WHEN row_id % 3 = 0 THEN ' ' WHEN row_id % 3 = 1 THEN ' =G001 MDA10 ' END", "system_code"),
        lambda: text.active_code(F.when(c("row_id") % 3 == 0, " ").when(c("row_id") % 3 == 1, " =G001 MDA10 "), c("system_code")))
per_row("system_prefix", S.prefix("system_code"), lambda: text.system_prefix(c("system_code")))
per_row("prefix_match", S.prefix_match("system_code", ("MDA", "=G002")),
        lambda: text.prefix_match(c("system_code"), [" MDA", " ", "=G002", ""]))
per_row("contains_any", S.contains("descriptions", ("yaw brake", "converter")),
        lambda: text.contains_any(c("descriptions"), ["yaw brake", "converter"]))
per_row("keyword_mention", S.mentions("descriptions"),
        lambda: text.mentions_word(c("descriptions"), CONFIG.taxonomy.pitch_keywords))


def located(spark, d):
    return with_topology(wo(spark, d), c("system_code"), CONFIG, hints=True)


_spec = S.topo_column("system_code", "system_name", "descriptions")
_wo_spec = f"(SELECT *, {_spec} AS spec FROM wo)"
query("topology_column", f"SELECT row_id, {_spec} AS value FROM wo")(
    lambda s, d: located(s, d).select("row_id", c("spec").alias("value")))
query("topology_value", f"SELECT row_id, {S.topo_value('spec')} AS value FROM {_wo_spec}")(
    lambda s, d: located(s, d).select("row_id", c("spec_value").alias("value")))
query("topology_key", f"SELECT row_id, coalesce({S.topo_context('spec')}, 'Standard Topology') AS value FROM {_wo_spec}")(
    lambda s, d: located(s, d).select("row_id", topology.topology_key(c("context")).alias("value")))
query("topology_block", f"SELECT row_id, {S.block(S.topo_context('spec'))} AS value FROM {_wo_spec}")(
    lambda s, d: located(s, d).select("row_id", topology.topology_block(c("context")).alias("value")))

# flags as they come back from text: the event types stand for texts of every kind
_flag_text = "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'TRUE' WHEN 2 THEN ' no ' WHEN 3 THEN '0' WHEN 4 THEN '0.0' WHEN 5 THEN ' ' WHEN 6 THEN 'NaN' ELSE event_type END"


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").withColumn("flag", F.expr(_flag_text))


query("coerce_flag", f"SELECT event_id, {S.flag(f'({_flag_text})')} AS value FROM events")(
    lambda s, d: _events(s, d).select("event_id", flags.coerce_flag(c("flag")).alias("value")))
query("is_unprocessed", f"SELECT event_id, ({_flag_text}) IS NULL OR lower({S.strip(f'({_flag_text})')}) IN ('', 'false', '0', 'nan', 'none') AS value FROM events")(
    lambda s, d: _events(s, d).select("event_id", flags.is_unprocessed(c("flag")).alias("value")))
_conf = "CASE event_type WHEN 'click' THEN 'High' WHEN 'view' THEN 'Medium' WHEN 'error' THEN 'Low' WHEN 'signup' THEN 'Sure' END"
query("threshold_gate", f"SELECT event_id, {S.gate('conf', 'flag')} AS strict_gate, {S.gate('conf', 'flag', 2, True)} AS loose_gate, "
      f"{S.gate('conf', 'flag', 3)} AS unknown_level FROM (SELECT event_id, {_conf} AS conf, {_flag_text} AS flag FROM events)")(
    lambda s, d: _events(s, d).withColumn("conf", F.expr(_conf)).select(
        "event_id", flags.passes(c("conf"), c("flag"), Gate()).alias("strict_gate"),
        flags.passes(c("conf"), c("flag"), Gate("Medium", True)).alias("loose_gate"),
        flags.passes(c("conf"), c("flag"), Gate("Certain")).alias("unknown_level")))

_suggested = "CASE row_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' KEEP current ' WHEN 2 THEN 'Not Enough Information' WHEN 3 THEN '  ' ELSE ' =G002 MKY10 ' END"
per_row("invalid_code", S.unusable(f"({_suggested})"), lambda: text.is_unusable_code(F.expr(_suggested)))
per_row("missing_code", S.missing_code("system_code"), lambda: text.is_missing_code(c("system_code")))
per_row("resolve_suggestion", f"CASE WHEN lower({S.strip(f'({_suggested})')}) = 'keep current' THEN system_code ELSE {_suggested} END",
        lambda: text.resolve_suggestion(F.expr(_suggested), c("system_code")))

query("route_p1", "SELECT row_id, route, route <> 'Bypassed' AS exempt FROM routed")(
    lambda s, d: routing.with_route(wo(s, d), CONFIG.taxonomy).select("row_id", "route", c("P1_Audit_Exempt").alias("exempt")))

@query("redact", f"SELECT row_id, regexp_replace(regexp_replace(descriptions, {S.q(chr(92) + 'b' + chr(92) + 'd{4}-' + chr(92) + 'd{3}' + chr(92) + 'b')}, '[X]', 'g'), "
       "'(?i)motor replaced', '[X]', 'g') AS value FROM wo")
def _redact(spark, d):
    rules = Redaction(True, (r"\b\d{4}-\d{3}\b", "(unclosed", r"(?i)motor replaced"), "[X]")
    return wo(spark, d).select("row_id", text.redact(c("descriptions"), rules).alias("value"))


@query("redact_custom", f"SELECT row_id, regexp_replace(replace(descriptions, 'Pitch', 'P.'), {S.q(chr(92) + 'd+')}, '#', 'g') AS value FROM wo")
def _redact_custom(spark, d):
    rules = Redaction(True, (r"\d+",), "#", custom=lambda t: t.replace("Pitch", "P."))
    return wo(spark, d).select("row_id", hooks.redact_text(c("descriptions"), rules).alias("value"))


query("skip_uninformative", f"SELECT row_id, skip, CASE WHEN skip THEN 'Not Enough Information' END AS label FROM (SELECT row_id, {S.uninformative('descriptions')} AS skip FROM wo)")(
    lambda s, d: wo(s, d).withColumn("skip", routing.is_uninformative(c("descriptions"))).select(
        "row_id", "skip", F.when(c("skip"), CONFIG.rules.uninformative_label).alias("label")))
per_row("skip_non_failure", f"coalesce({S.strip('maintenance_type')} IN ('Preventive', 'Retrofit'), false)",
        lambda: routing.is_non_failure(c("maintenance_type"), CONFIG.rules))

query("combine_qa", f"""SELECT event_id, CASE WHEN ({S.score('a')}) < ({S.score('b')}) THEN a ELSE b END AS confidence, {S.flag('flag')} OR value > 10 AS flag
  FROM (SELECT event_id, value, {_conf} AS a, CASE WHEN event_id % 3 = 0 THEN 'Medium' WHEN event_id % 3 = 1 THEN 'Low' END AS b, {_flag_text} AS flag FROM events)""")(
    lambda s, d: _events(s, d).select("event_id", flags.lower_confidence(
        F.expr(_conf), F.expr("CASE WHEN event_id % 3 = 0 THEN 'Medium' WHEN event_id % 3 = 1 THEN 'Low' END")).alias("confidence"),
        (flags.coerce_flag(c("flag")) | (c("value") > 10)).alias("flag")))

query("strip_fence", f"SELECT row_id, phase, {S.unfence('raw_response')} AS value FROM ledger")(
    lambda s, d: view(s, d, "ledger").select("row_id", "phase", text.strip_fence(c("raw_response")).alias("value")))

_template = "Order {wo} of {maker}: {text} {{{code}}}\n{text}"
query("render_prompt", "SELECT row_id, 'Order ' || wo_id || ' of ' || '{wo} ' || manufacturer || ': ' || coalesce(descriptions, '') || ' {' || coalesce(system_code, '') || '}' || chr(10) || coalesce(descriptions, '') AS prompt FROM wo")(
    lambda s, d: wo(s, d).select("row_id", prompts.render(_template, {
        "wo": c("wo_id"), "maker": F.concat(F.lit("{wo} "), c("manufacturer")), "text": c("descriptions"), "code": c("system_code")}).alias("prompt")))


# ---- merges of labels that came back

_P4 = f"""SELECT row_id, maintenance_type, action_type,
  CASE row_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Reset' WHEN 2 THEN ' Corrective' ELSE 'Retrofit' END AS t, CASE WHEN row_id % 4 = 1 THEN NULL ELSE 'Replace' END AS a,
  CASE row_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Sure' END AS oc, CASE WHEN row_id % 6 = 0 THEN 'yes' ELSE 'False' END AS ofl,
  CASE row_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' END AS sc, CASE WHEN row_id % 7 = 0 THEN 'true' END AS sf,
  turbine_model AS m, manufacturer AS s FROM wo"""


def _labelled(spark, d):
    wo(spark, d).createOrReplaceTempView("wo")
    names = {"t": "P4_Maintenance_Type", "a": "P4_Action_Taken", "oc": "P4_Operational_Confidence",
             "ofl": "P4_Operational_Review_Flag", "sc": "P4_Semantic_Confidence", "sf": "P4_Semantic_Review_Flag",
             "m": "P4_Failure_Mode", "s": "P4_Symptom"}
    return spark.sql(_P4).withColumnsRenamed(names).withColumns({
        "P4_Mechanism": c("P4_Failure_Mode"), "P4_Cause": c("P4_Symptom"),
        "P4_Confidence": c("P4_Semantic_Confidence"), "P4_Review_Flag": c("P4_Operational_Review_Flag")})


def _changed(before, after):
    return f"({S.norm(before)} IS DISTINCT FROM {S.norm(after)} AND {S.norm(after)} IS NOT NULL)"


@query("merge_labels", f"""SELECT row_id, maintenance_type AS legacy_type, action_type AS legacy_action, mt, ma,
  {_changed('maintenance_type', 'mt')} AS type_corrected, {_changed('action_type', 'ma')} AS action_corrected
  FROM (SELECT *, CASE WHEN {S.gate('oc', 'ofl')} THEN t ELSE maintenance_type END AS mt,
    CASE WHEN {S.gate('oc', 'ofl', 2)} THEN a ELSE action_type END AS ma FROM ({_P4}))""")
def _merge_labels(spark, d):
    rules = Rules(action_gate=Gate("Medium"))
    return merge.merge_labels(_labelled(spark, d), rules).select(
        "row_id", c("Legacy_Maintenance_Type").alias("legacy_type"), c("Legacy_Action_Taken").alias("legacy_action"),
        c("Merged_Maintenance_Type").alias("mt"), c("Merged_Action_Taken").alias("ma"),
        c("Maintenance_Type_Corrected_Flag").alias("type_corrected"), c("Action_Taken_Corrected_Flag").alias("action_corrected"))


@query("merge_failures", f"""SELECT row_id, m AS plain_mode, CASE WHEN {S.gate('sc', 'sf')} THEN m END AS gated_mode,
  CASE WHEN {S.gate('sc', 'sf')} THEN s END AS gated_symptom FROM ({_P4})""")
def _merge_failures(spark, d):
    rows = _labelled(spark, d)
    plain = merge.merge_failures(rows, Rules()).withColumnRenamed("Merged_Failure_Mode", "plain_mode")
    return merge.merge_failures(plain, Rules(enforce_mode_gate=True)).select(
        "row_id", "plain_mode", c("Merged_Failure_Mode").alias("gated_mode"), c("Merged_Symptom").alias("gated_symptom"))


QA_SQL = f"""SELECT row_id, CASE WHEN ({S.score('sc')}) < 3 THEN 'Requires Human Review (Low Confidence)'
  WHEN {S.flag('ofl')} THEN 'Requires Human Review (Flagged by Model)' ELSE 'Pass' END AS status FROM ({_P4})"""


def with_status(spark, d):
    return merge.with_qa_status(_labelled(spark, d), CONFIG.rules.qa)


query("qa_status", QA_SQL)(lambda s, d: with_status(s, d).select("row_id", c("QA_Status").alias("status")))
