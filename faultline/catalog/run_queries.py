"""Merges of tables, reports, the ledger and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog import sql as S
from faultline.catalog.labeller import failing_labeller, keyword_labeller
from faultline.catalog.dictionary_queries import grouped
from faultline.catalog.registry import query
from faultline.catalog.phase_queries import AUDIT_PARTS, CLASSIFIED, WITH_SPEC
from faultline.catalog.row_queries import QA_SQL, with_status, wo
from faultline.catalog.views import CONFIG, table, view
from faultline.functions.contract import AUDIT, check_response
from faultline.operators import hooks, ledger, metrics, prompts, routing
from faultline.operators.dictionary import gather_entries
from faultline.operators.joins import merge_tables
from faultline.plans import codes, extraction
from faultline.plans.full import Run, full_run, report, run_codes, run_dictionary, with_codes
from faultline.sources.scratch import delete_folder, new_folder, stored
from faultline.sources.tables import export_final
from faultline.streaming.incremental import label_stream

c = F.col

# ---- key merges: orders and events meet on a customer key that is missing on both sides at times

_L = "(SELECT nullif(o_custkey % 97, 13) AS k, o_orderkey, o_orderstatus AS status FROM orders)"
_R = "(SELECT nullif(user_id, 5) AS k, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2)"


def _sides(spark, d):
    left = table(spark, d, "orders").select(
        F.nullif(c("o_custkey") % 97, F.lit(13)).alias("k"), "o_orderkey", c("o_orderstatus").alias("status"))
    right = table(spark, d, "events").groupBy(
        F.nullif(c("user_id"), F.lit(5)).alias("k"), c("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return left, right


for _how, _join in (("left", "LEFT"), ("inner", "INNER"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    query(f"merge_{_how}", f"""SELECT coalesce(l.k, r.k) AS k, l.o_orderkey, l.status AS status_x, r.status AS status_y, r.n
      FROM {_L} l {_join} JOIN {_R} r ON l.k IS NOT DISTINCT FROM r.k""")(
        lambda s, d, how=_how: merge_tables(*_sides(s, d), "k", how))


# ---- reports

_COST = "(CAST(input_tokens AS DECIMAL(18,0)) * 2.5 + CAST(output_tokens AS DECIMAL(18,0)) * 15)"
query("call_cost", f"SELECT batch_id, rows_processed, input_tokens, output_tokens, CAST({_COST} AS DOUBLE) / 1000000 AS cost FROM perf")(
    lambda s, d: view(s, d, "perf").select(
        "batch_id", "rows_processed", "input_tokens", "output_tokens",
        metrics.call_cost(c("input_tokens"), c("output_tokens"), CONFIG.pricing).cast("double").alias("cost")))
_METRICS = """SELECT phase, batch_id, sum(rows_processed) AS rows_processed, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
  sum(seconds) AS seconds, round((CAST(sum(input_tokens) AS DECIMAL(18,0)) * 2.5 + CAST(sum(output_tokens) AS DECIMAL(18,0)) * 15) * 0.000001, 6) AS cost FROM perf GROUP BY phase, batch_id"""
query("call_metrics", f"SELECT phase, batch_id, CAST(rows_processed AS BIGINT) AS rows_processed, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, CAST(seconds AS BIGINT) AS seconds, CAST(cost AS DOUBLE) AS cost FROM ({_METRICS})")(
    lambda s, d: metrics.call_metrics(view(s, d, "perf"), CONFIG.pricing).select(
        "phase", "batch_id", "rows_processed", "input_tokens", "output_tokens", c("seconds").cast("bigint").alias("seconds"),
        c("cost_usd").cast("double").alias("cost")))
query("run_totals", f"SELECT CAST(sum(rows_processed) AS BIGINT) AS rows_processed, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(seconds) AS BIGINT) / 60 AS minutes FROM ({_METRICS})")(
    lambda s, d: metrics.run_totals(metrics.call_metrics(view(s, d, "perf"), CONFIG.pricing)).select(
        "rows_processed", "input_tokens", "output_tokens", c("cost_usd").cast("double").alias("cost"), "minutes"))
query("qa_distribution", f"SELECT status AS QA_Status, count(*) AS n FROM ({QA_SQL}) GROUP BY status")(
    lambda s, d: metrics.qa_distribution(with_status(s, d)))
query("phase_counts", f"""SELECT route AS what, count(*) AS n FROM routed GROUP BY route UNION ALL SELECT 'passed', count(*) FILTER (status = 'Pass') FROM ({QA_SQL})
  UNION ALL SELECT 'total', count(*) FROM ({QA_SQL})""")(
    lambda s, d: metrics.route_counts(routing.with_route(wo(s, d), CONFIG.taxonomy)).withColumnRenamed("route", "what").unionByName(
        metrics.pass_count(with_status(s, d)).unpivot([], ["passed", "total"], "what", "n")))
query("preview", "SELECT row_id, wo_id, system_code FROM wo ORDER BY wo_id LIMIT 5")(
    lambda s, d: metrics.preview(wo(s, d), 5).select("row_id", "wo_id", "system_code"))


# ---- ledger

query("latest_attempt", "SELECT call_id, attempt, error, status FROM attempts QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY attempt DESC) = 1")(
    lambda s, d: ledger.latest_attempt(view(s, d, "attempts").drop("ts")).select("call_id", "attempt", "error", "status"))
_STATE = """SELECT call_id, count(*) AS attempts, bool_or(status = 'ok') AS done, arg_max(error, attempt) FILTER (status <> 'ok') AS last_reason FROM attempts GROUP BY call_id"""
query("attempt_state", f"SELECT *, NOT done AND attempts >= 150 AS failed FROM ({_STATE})")(
    lambda s, d: ledger.attempt_state(
        view(s, d, "attempts"), order=("ts", "attempt"), max_attempts=150))
query("pending_rows", f"SELECT c_custkey AS call_id, CAST(coalesce(m, 0) + 1 AS INTEGER) AS attempt FROM customer LEFT JOIN (SELECT call_id, max(attempt) AS m, bool_or(status = 'ok') AS done FROM attempts GROUP BY call_id) ON call_id = c_custkey WHERE NOT coalesce(done, false) AND coalesce(m, 0) < 9900")(
    lambda s, d: ledger.pending_calls(
        table(s, d, "customer").select(c("c_custkey").alias("call_id")),
        view(s, d, "attempts").withColumn("status", c("status")), 9900))


def _compacted(spark, d):
    """A ledger of the attempts that was compacted after its first and its second third."""
    path, rows = new_folder(spark, "ledger"), view(spark, d, "attempts").select(
        c("call_id").cast("string").alias("call_id"), c("attempt").cast("int").alias("attempt"), F.lit("b").alias("batch_id"),
        F.concat(F.lit("answer "), "attempt").alias("raw_response"), "status", "error", F.lit(0).cast("bigint").alias("input_tokens"),
        F.lit(0).cast("bigint").alias("output_tokens"), F.lit(0.0).alias("seconds"), c("ts").cast("timestamp").alias("ts"))
    last = rows.agg(F.max("attempt")).first()[0] or 0
    third = F.least((c("attempt") * 3 / F.lit(last + 1)).cast("int"), F.lit(2))
    for number in range(3):
        ledger.append(rows.where(third == number), path, codes.P2)
        if number < 2:
            ledger.compact(spark, path, codes.P2)
    return path


query("compacted_state", """SELECT call_id, max(attempt) AS attempts, bool_or(status = 'ok') AS done, arg_max(error, attempt) FILTER (status <> 'ok') AS last_reason,
  arg_max(status, attempt) AS status, 'answer ' || max(attempt) AS raw_response FROM attempts GROUP BY call_id""")(
    lambda s, d: ledger.call_states(s, _compacted(s, d), codes.P2).withColumn("call_id", c("call_id").cast("bigint")))


@query("pending_after_compaction", "SELECT c_custkey AS call_id, CAST(coalesce(m, 0) + 1 AS INTEGER) AS attempt FROM customer LEFT JOIN (SELECT call_id, max(attempt) AS m, bool_or(status = 'ok') AS done FROM attempts GROUP BY call_id) ON call_id = c_custkey WHERE NOT coalesce(done, false) AND coalesce(m, 0) < 9900")
def _pending_after_compaction(spark, d):
    path = _compacted(spark, d)
    calls = table(spark, d, "customer").select(c("c_custkey").cast("string").alias("call_id"))
    pending = ledger.pending_calls(calls, ledger.attempts_since(spark, path, codes.P2), 9900,
                                   before=ledger.compacted_state(spark, path, codes.P2),
                                   buckets=ledger.generation(spark, path, codes.P2).buckets)
    return pending.select(c("call_id").cast("bigint").alias("call_id"), "attempt")


query("pending_groups", "SELECT DISTINCT g.code, g.topology FROM grouped g LEFT JOIN (SELECT DISTINCT code, topology FROM (" + S.checked("batch_ledger", S.EXTRACTION, "code, topology, piece") + ") WHERE status = 'ok') b ON b.code = g.code AND b.topology = g.topology WHERE b.code IS NULL")(
    lambda s, d: _pending_groups(s, d))


def _pending_groups(spark, d):
    """Groups without a valid extraction answer."""
    name = F.concat_ws("|", "code", "topology")
    answered = check_response(view(spark, d, "batch_ledger", grouped=grouped(spark, d)), extraction.EXTRACTION)
    attempts = answered.select(name.alias("call_id"), F.lit(1).alias("attempt"), "status", c("reason").alias("error"))
    calls = grouped(spark, d).select("code", "topology").distinct().withColumn("call_id", name)
    return ledger.pending_calls(calls, attempts, 2).select("code", "topology")


# ---- hooks and the whole run, with the deterministic labeller

_AUDITED = f"""(SELECT row_id, {S.render(prompts.AUDIT, AUDIT_PARTS)} AS prompt, contains(lower({S.render(prompts.AUDIT, AUDIT_PARTS)}), 'yaw brake inspected')
  AND NOT contains(lower({S.render(prompts.AUDIT, AUDIT_PARTS)}), 'yaw,') AS flag FROM {WITH_SPEC} WHERE route = 'Bypassed')"""
_AUDIT_ANSWER = """'{"Reasoning": "keyword match", "Confidence_Score": "High", "Review_Flag": ' || CAST(flag AS VARCHAR) || '}'"""


def _audit_rows(spark, d):
    rows = codes.with_prompt_parts(routing.with_route(wo(spark, d), CONFIG.taxonomy), CONFIG)
    return codes.audit_rows(rows, CONFIG)


def _named_audits(spark, d):
    """The same rows with what audits need of them, computed once for all steps of the ledger. Over the given tables the
    test on the route would be pushed to their scan and build every text many times, at every step."""
    return stored(_audit_rows(spark, d).select("row_id", "route", "P1_Audit_Exempt", "P2_call", *codes.PARTS.values()), "named")


@query("label_calls", f"SELECT CAST(row_id AS VARCHAR) AS call_id, {_AUDIT_ANSWER} AS raw_response, length(prompt) // 4 AS input_tokens, CAST(40 AS BIGINT) AS output_tokens FROM {_AUDITED}")
def _label_calls(spark, d):
    calls = _audit_rows(spark, d).where(routing.needs_audit()).select(
        c("row_id").cast("string").alias("call_id"), F.lit(None).cast("string").alias("options_key"),
        codes.audit_prompt(CONFIG).alias("prompt"),
        F.lit(prompts.AUDITOR).alias("system_prompt"), F.lit(AUDIT.name).alias("contract"))
    return hooks.label_calls(calls, keyword_labeller).select("call_id", "raw_response", "input_tokens", "output_tokens")


def label_audits(rows, path, labeller=keyword_labeller):
    """Asks the audit of every row that needs one; equal questions once."""
    ledger.label_pending(
        codes.audit_calls(rows), path, codes.P2, AUDIT, prompts.AUDITOR, labeller,
        lambda calls: calls.withColumn("prompt", codes.audit_prompt(CONFIG)), lambda df: check_response(df, AUDIT))


@query("label_pending", f"SELECT row_id, 1 AS attempt, 'ok' AS status, {_AUDIT_ANSWER} AS raw_response FROM {_AUDITED}")
def _label_pending(spark, d):
    path = new_folder(spark, "ledger")
    rows = _named_audits(spark, d)
    label_audits(rows, path)
    answers = ledger.read_ledger(spark, path, codes.P2).select("call_id", "attempt", "status", "raw_response")
    asked = rows.where(routing.needs_audit()).select("row_id", c("P2_call").alias("call_id"))
    return asked.join(answers, "call_id").drop("call_id")


@query("attempts_of_a_run", f"""SELECT row_id, CASE WHEN bad THEN 2 ELSE 1 END AS attempts, NOT bad AS done, bad AS failed, kind AS last_reason FROM (
  SELECT row_id, n % 5 = 0 OR n % 7 = 0 AS bad, CASE WHEN n % 5 = 0 THEN 'TimeoutError: no answer' WHEN n % 7 = 0 THEN 'invalid' END AS kind FROM (SELECT row_id, length(prompt) AS n FROM {_AUDITED}))""")
def _attempts_of_a_run(spark, d):
    """The ledger of a run whose labeller fails for some questions, twice: state by the branch that runs use."""
    path = new_folder(spark, "ledger")
    rows = _named_audits(spark, d)
    label_audits(rows, path, failing_labeller)
    state = ledger.attempt_state(ledger.read_ledger(spark, path, codes.P2), max_attempts=2)
    reason = F.when(c("last_reason").startswith("TimeoutError"), c("last_reason")).when(c("last_reason").isNotNull(), "invalid")
    asked = rows.where(routing.needs_audit()).select("row_id", c("P2_call").alias("call_id"))
    return asked.join(state, "call_id").select(
        "row_id", c("attempts").cast("int").alias("attempts"), "done", "failed", reason.alias("last_reason"))


@query("export_final", f"SELECT q.row_id, w.maintenance_type, q.status AS \"QA_Status\" FROM ({QA_SQL}) q JOIN wo w ON w.row_id = q.row_id")
def _export_final(spark, d):
    folder = new_folder(spark, "export")
    export_final(with_status(spark, d).select("row_id", "maintenance_type", "QA_Status"), folder, by_status=True)
    return spark.read.parquet(folder)


# the labeller suggests the first code of the branch it is shown
_FIRST_CODE = "regexp_extract(b.text, '^ *- ([^:]*):', 1)"


_KIND = f"CASE WHEN {S.uninformative('t.descriptions')} THEN 'none' WHEN contains(lower(t.descriptions), 'annual service') THEN 'healthy' ELSE 'failure' END"
_MERGED = f"""SELECT t.row_id, {S.norm('t.system_code')} AS legacy_code, {S.norm('t.maintenance_type')} AS legacy_type, {_KIND} AS kind, coalesce(a.flag, false) AS relabel,
  CASE WHEN t.route = 'Bypassed' THEN 'bypassed' WHEN b.branch IS NULL THEN 'config_error' ELSE 'ok' END AS p1_status,
  CASE WHEN t.route <> 'Bypassed' AND b.branch IS NOT NULL THEN {_FIRST_CODE} WHEN a.flag THEN (SELECT {_FIRST_CODE} FROM branches b WHERE b.branch = 'all')
    ELSE {S.norm('t.system_code')} END AS merged_code
  FROM routed t JOIN row_branches r ON r.row_id = t.row_id LEFT JOIN branches b ON b.branch = r.branch LEFT JOIN {_AUDITED} a ON a.row_id = t.row_id"""
_FAILURE = "CASE kind WHEN 'none' THEN 'Not Enough Information' WHEN 'healthy' THEN 'Not Applicable' ELSE '{}' END AS {}"
_FULL_RUN = f"""SELECT row_id, p1_status, merged_code, maintenance_type, relabel, {_FAILURE.format('Wear', 'failure_mode')}, {_FAILURE.format('Abrasion', 'mechanism')},
  {_FAILURE.format('Friction', 'cause')}, {_FAILURE.format('Noise', 'symptom')}, merged_code IS NOT NULL AND merged_code IS DISTINCT FROM legacy_code AS code_corrected,
  maintenance_type IS DISTINCT FROM legacy_type AS type_corrected, false AS failed, 'Pass' AS status
  FROM (SELECT *, CASE kind WHEN 'none' THEN 'Not Enough Information' WHEN 'healthy' THEN 'Preventive' ELSE 'Corrective' END AS maintenance_type FROM ({_MERGED}))"""


def _result(df, *more):
    return df.select(
        "row_id", c("P1_Status").alias("p1_status"), c("Merged_System_Code").alias("merged_code"),
        c("Merged_Maintenance_Type").alias("maintenance_type"), F.coalesce("P2_Requires_Relabel", F.lit(False)).alias("relabel"),
        *[c(f"Merged_{n}").alias(n.lower()) for n in ("Failure_Mode", "Mechanism", "Cause", "Symptom")],
        c("System_Code_Corrected_Flag").alias("code_corrected"), c("Maintenance_Type_Corrected_Flag").alias("type_corrected"),
        (~c("P4_Status").isin("ok", "skipped")).alias("failed"), c("QA_Status").alias("status"), *more)


@query("full_run", _FULL_RUN)
def _full_run(spark, d):
    run = Run(spark, new_folder(spark, "run"), CONFIG, keyword_labeller)
    return _result(full_run(run, wo(spark, d), view(spark, d, "components")))


@query("full_run_again", f"""SELECT f.*, legacy AS legacy_code, CAST(0 AS BIGINT) AS new_calls
  FROM ({_FULL_RUN}) f JOIN (SELECT row_id AS id, system_code AS legacy FROM wo) w ON w.id = f.row_id""")
def _full_run_again(spark, d):
    """A second pass over the result of the first: nothing is asked and legacy copies stay."""
    folder = new_folder(spark, "run")
    first = full_run(Run(spark, folder, CONFIG, keyword_labeller), wo(spark, d), view(spark, d, "components"))
    first = stored(first, "first")
    calls = ledger.read_ledger(spark, f"{folder}/ledger").count()
    second = stored(full_run(Run(spark, folder, CONFIG, keyword_labeller), first, view(spark, d, "components")), "second")
    more = ledger.read_ledger(spark, f"{folder}/ledger").count() - calls
    return _result(second).join(second.select("row_id", c("Legacy_System_Code").alias("legacy_code")), "row_id").withColumn(
        "new_calls", F.lit(more).cast("bigint"))


@query("label_stream", f"SELECT f.*, CAST(row_id % 2 AS INTEGER) AS batch FROM ({_FULL_RUN}) f")
def _label_stream(spark, d):
    """Work orders in two sets of files that arrive one after the other; the second batch is handed over once more."""
    rows, components = stored(wo(spark, d), "orders"), view(spark, d, "components")
    first = Run(spark, new_folder(spark, "run"), CONFIG, keyword_labeller)
    kept, coded = run_codes(first, rows, components)
    dictionary = gather_entries(run_dictionary(first, with_codes(first, kept, coded)))
    run = Run(spark, first.folder, CONFIG, keyword_labeller)
    source = new_folder(spark, "arriving")
    for half in range(2):
        rows.where(c("row_id") % 2 == half).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(rows.schema).parquet(source)
        label_stream(run, arriving, components, dictionary).awaitTermination()
    delete_folder(spark, f"{run.folder}/stream/commits/1")
    label_stream(run, arriving, components, dictionary).awaitTermination()
    labelled = spark.read.parquet(f"{run.folder}/labelled")
    return _result(labelled, "batch")


_ASKED = f"""SELECT 'P1' AS phase, prompt FROM {CLASSIFIED} UNION ALL SELECT 'P2', prompt FROM {_AUDITED}"""


@query("run_report", f"""SELECT CASE WHEN grouping(phase) = 1 THEN 'run' ELSE 'phase' END AS level, phase, CAST(sum(n) AS BIGINT) AS rows, count(*) AS calls,
  CAST(sum(length(prompt) // 4) AS BIGINT) AS input_tokens FROM (SELECT phase, prompt, count(*) AS n FROM ({_ASKED}) GROUP BY phase, prompt)
  GROUP BY GROUPING SETS ((phase), ())""")
def _run_report(spark, d):
    """What correction and audit of a run asked: rows, calls and tokens by phase and in all."""
    run = Run(spark, new_folder(spark, "run"), CONFIG, keyword_labeller)
    run_codes(run, wo(spark, d), view(spark, d, "components"))
    asked = report(run).where("level <> 'batch'").select("level", "phase", "rows", "calls", "input_tokens")
    found = asked.where(c("phase").isin(codes.P1, codes.P2))
    return found.unionByName(found.agg(F.lit("run").alias("level"), F.lit(None).cast("string").alias("phase"), *[
        F.sum(k).alias(k) for k in ("rows", "calls", "input_tokens")]))
