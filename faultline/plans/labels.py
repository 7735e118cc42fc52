"""Granular labels (P4): an operational call per row, then a semantic one where a failure is looked for.

The two calls have ledger entries of their own, so a failed semantic call does not repeat the
operational one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import LABEL_SKIPPED_REASON, SEMANTIC_SKIPPED_REASON, Config, Rules
from faultline.functions.contract import (
    MODE_FIELDS, OPERATIONAL, SEMANTIC, also_require, check_response, exactly_one,
    failure_selection, flag_at, text_at,
)
from faultline.functions.flags import coerce_flag, lower_confidence
from faultline.functions.text import active_code, or_unknown, strip
from faultline.functions.topology import block_of_key, topology_key
from faultline.operators.dictionary import (
    ENTRY_SCHEMA, MODE_TYPE, TEXT_FIELDS, action_list_text, action_options, allowed_values, attach_entry, escape_modes, group_code, mode_list_text,
    mode_options,
)
from faultline.operators.hooks import redact_text
from faultline.operators.ledger import call_id
from faultline.operators.prompts import render
from faultline.operators.routing import is_non_failure, is_uninformative
from faultline.operators.sizes import shuffled
from faultline.operators.topology import with_topology
from faultline.plans.codes import STATE, attempt_columns, join_answers

P4_OPERATIONAL, P4_SEMANTIC = "P4_OPERATIONAL", "P4_SEMANTIC"
MODE_NAMES = tuple(f.name for f in MODE_FIELDS)


def with_group(rows: DataFrame, config: Config) -> DataFrame:
    """Adds `code` (active code or Unknown) and `topology` (key); descriptions give no hints here."""
    merged = F.col("Merged_System_Code") if "Merged_System_Code" in rows.columns else F.lit(None).cast("string")
    code = group_code(active_code(merged, F.col("system_code")))
    rows = with_topology(rows.withColumn("code", code), F.col("code"), config, hints=False)
    return rows.withColumn("topology", topology_key(F.col("context"))).drop("spec", "spec_value", "context")


def with_label_parts(rows: DataFrame, config: Config) -> DataFrame:
    """Adds `skip` and `parts_hash`, one hash of everything a row's own text brings to its prompts.

    Stored beside the text, they let later steps name calls without reading texts again.
    """
    skip = is_uninformative(F.col("descriptions")) if config.rules.skip_uninformative else F.lit(False)
    parts = F.struct(*[c.alias(k) for k, c in prompt_parts(config).items()])
    return rows.withColumn("skip", skip).withColumn("parts_hash", F.sha2(F.to_json(parts), 256))


def _choices(actions: Column, modes: Column, rules: Rules) -> dict[str, Column]:
    return {"action_choices": action_options(actions, rules.action_escapes), "mode_choices": mode_options(modes)}


def _texts(action_choices: Column, mode_choices: Column, rules: Rules) -> dict[str, Column]:
    return {"actions_text": action_list_text(action_choices),
            "modes_text": mode_list_text(mode_choices, escape_modes(rules.mode_escapes))}


def _options_key(actions_text: Column, modes_text: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", actions_text, modes_text), 256)


def with_options(entries: DataFrame, rules: Rules) -> DataFrame:
    """Entries with what their answers may say, as lists, as prompt text and as a hash."""
    listed = entries.withColumns(_choices(F.col("actions"), F.col("modes"), rules))
    texts = listed.withColumns(_texts(F.col("action_choices"), F.col("mode_choices"), rules))
    return texts.withColumn("options_key", _options_key(F.col("actions_text"), F.col("modes_text")))


def no_entry_key(rules: Rules) -> Column:
    """Options hash of rows without an entry, a constant of the settings."""
    choices = _choices(F.array().cast("array<string>"), F.array().cast(f"array<{MODE_TYPE}>"), rules)
    return _options_key(**_texts(**choices, rules=rules))


def option_sets(entries: DataFrame, rules: Rules) -> DataFrame:
    """Distinct option sets by options_key, including that of rows without an entry."""
    none = entries.sparkSession.createDataFrame([(None, None, [], [])], ENTRY_SCHEMA)
    columns = ("options_key", "action_choices", "mode_choices", "actions_text", "modes_text")
    known = entries.select("code", "topology", "actions", "modes")
    return with_options(known.unionByName(none), rules).select(*columns).dropDuplicates(["options_key"])


def operational_rows(rows: DataFrame, entries: DataFrame, config: Config) -> DataFrame:
    """Adds options_key and P4_OPERATIONAL_call to rows with code, topology, skip and parts_hash.

    Skipped rows have no call.
    """
    rows = attach_entry(rows, with_options(entries, config.rules), ["options_key"], config.limits)
    rows = rows.withColumn("options_key", F.coalesce("options_key", no_entry_key(config.rules)))
    identity = call_id(P4_OPERATIONAL, OPERATIONAL, config.prompts.engineer, config.prompts.operational,
                       {"parts": F.col("parts_hash"), "options": F.col("options_key")})
    return rows.withColumn("P4_OPERATIONAL_call", F.when(~F.col("skip"), identity))


def prompt_parts(config: Config) -> dict[str, Column]:
    return {
        "system_name": or_unknown(F.col("system_name")),
        "system_code": F.col("code"),
        "topology_context_block": block_of_key(F.col("topology")),
        "log_description": redact_text(strip(F.coalesce("descriptions", F.lit(""))), config.redaction),
    }


def operational_calls(rows: DataFrame, config: Config) -> DataFrame:
    return rows.where(~F.col("skip")).select(
        F.col("P4_OPERATIONAL_call").alias("call_id"), "options_key",
        *[c.alias(k) for k, c in prompt_parts(config).items()]).dropDuplicates(["call_id"])


_TEXT_FIELDS = ("system_name", "system_code", "topology_context_block", "log_description")


def operational_prompt(config: Config) -> Column:
    fields = {n: F.col(n) for n in _TEXT_FIELDS}
    return render(config.prompts.operational, {**fields, "valid_actions_list": F.col("actions_text")})


def semantic_prompt(config: Config) -> Column:
    fields = {n: F.col(n) for n in (*_TEXT_FIELDS, "maintenance_type", "action_taken")}
    return render(config.prompts.semantic, {**fields, "valid_failure_modes_list": F.col("modes_text")})


def allowed(long: DataFrame, entries: DataFrame, rules: Rules) -> DataFrame:
    """Rows (options_key, action or mode) that answers are joined with; `entries` are the gathered form of `long`."""
    keys = with_options(entries, rules).select("code", "topology", "options_key")
    return allowed_values(long, keys, rules, no_entry_key(rules))


def _listed(checked: DataFrame, options: DataFrame, said: dict[str, Column]) -> DataFrame:
    """Adds `_listed`, whether the option set of the row has what the answer says. An option set lists a value once, so
    rows stay as many as they are; a value that many answers share is split by adaptive execution."""
    names = {f: f"_o_{f}" for f in said}
    first = next(iter(names.values()))
    side = options.select(F.col("options_key").alias("_o_key"), *[F.col(f).alias(n) for f, n in names.items()]).where(F.col(first).isNotNull())
    checked = checked.withColumns({f"_s_{f}": v for f, v in said.items()})
    on = F.col("options_key") == F.col("_o_key")
    for f, n in names.items():
        on = on & (F.col(f"_s_{f}") == F.col(n))
    joined = checked.join(side, on, "left").withColumn("_listed", F.col(first).isNotNull())
    return joined.drop("_o_key", *names.values(), *[f"_s_{f}" for f in said])


def check_operational(answers: DataFrame, options: DataFrame) -> DataFrame:
    """Contract, and an action that `options` (see `allowed`) lists for the row's options_key."""
    checked = _listed(check_response(answers, OPERATIONAL), options, {"action": text_at("Action_Taken")})
    return also_require(checked, F.col("_listed"), "Action_Taken: not an allowed value").drop("_listed")


def check_semantic(answers: DataFrame, options: DataFrame, rules: Rules) -> DataFrame:
    """Contract, and exactly one of the failure modes that `options` lists for the row's options_key, or an escape."""
    said = {f: text_at(f"Failure_Mode_Selection.{n}") for n, f in zip(MODE_NAMES, TEXT_FIELDS)}
    checked = _listed(check_response(answers, SEMANTIC), options, said)
    ok = exactly_one(F.col("_listed"), escape_modes(rules.mode_escapes), said["failure_mode"])
    return also_require(checked, ok, "Failure_Mode_Selection: not exactly one option").drop("_listed")


def apply_operational(
    rows: DataFrame, answers: DataFrame | None, rules: Rules, row_key: str = "P4_OPERATIONAL_call", key: str = "call_id"
) -> DataFrame:
    """First half of the P4 columns and `needs_semantic`. Rows carry `skip` and `code`."""
    fields = {"_type": strip(text_at("Maintenance_Type")), "_action": text_at("Action_Taken"),
              "_answered_code": strip(text_at("System_Code")), "_reasoning": text_at("Reasoning"),
              "_confidence": text_at("Confidence_Score"), "_flag": coerce_flag(flag_at("Review_Flag"))}
    joined = join_answers(rows, ~F.col("skip"), row_key, answers, key, fields)
    ok, skip = F.col("_status") == "ok", F.col("skip")
    label = F.lit(rules.uninformative_label)
    return joined.withColumns({
        "op_status": F.when(skip, "skipped").otherwise(F.coalesce("_status", F.lit("pending"))),
        "P4_System_Code": F.when(skip | ok, F.col("code")),
        "code_mismatch": F.coalesce(F.col("_answered_code") != F.col("code"), F.lit(False)),
        "P4_Maintenance_Type": F.when(skip, label).otherwise(F.col("_type")),
        "P4_Action_Taken": F.when(skip, label).otherwise(F.col("_action")),
        "op_reasoning": F.when(skip, LABEL_SKIPPED_REASON).otherwise(F.concat(F.lit("Operational: "), F.col("_reasoning"))),
        "P4_Operational_Confidence": F.when(skip, "High").otherwise(F.col("_confidence")),
        "P4_Operational_Review_Flag": F.when(skip, F.lit(False)).otherwise(F.col("_flag")),
    }).withColumn("non_failure", ~skip & is_non_failure(F.col("P4_Maintenance_Type"), rules)).withColumn(
        "needs_semantic", F.coalesce(~skip & ok & ~F.col("non_failure"), F.lit(False))
    ).withColumns(attempt_columns("P4_Operational")).drop("_status", *STATE, *fields)


def with_semantic_call(rows: DataFrame, config: Config) -> DataFrame:
    """The operational call names text, component and options; type and action come on top."""
    identity = call_id(P4_SEMANTIC, SEMANTIC, config.prompts.engineer, config.prompts.semantic, {
        "operational_call": F.col("P4_OPERATIONAL_call"),
        "maintenance_type": F.col("P4_Maintenance_Type"), "action_taken": F.col("P4_Action_Taken")})
    return rows.withColumn("P4_SEMANTIC_call", F.when(F.col("needs_semantic"), identity))


def semantic_calls(rows: DataFrame, operational: DataFrame) -> DataFrame:
    """Distinct semantic calls; `operational` are the calls their prompt fields come from."""
    wanted = rows.where("needs_semantic").select(
        F.col("P4_SEMANTIC_call").alias("_id"), F.col("P4_OPERATIONAL_call").alias("call_id"),
        F.col("P4_Maintenance_Type").alias("maintenance_type"),
        F.col("P4_Action_Taken").alias("action_taken")).dropDuplicates(["_id"])
    return wanted.join(shuffled(operational), "call_id").drop("call_id").withColumnRenamed("_id", "call_id")


def apply_semantic(
    rows: DataFrame, answers: DataFrame | None, rules: Rules, row_key: str = "P4_SEMANTIC_call", key: str = "call_id"
) -> DataFrame:
    """Second half of the P4 columns.

    A row whose semantic call failed has no P4 result at all, as its two calls make one label.
    """
    fields = {**{f"_{n}": failure_selection(n) for n in MODE_NAMES},
              "_answered_code": strip(text_at("System_Code")),
              "_reasoning": text_at("Reasoning"), "_confidence": text_at("Confidence_Score"),
              "_flag": coerce_flag(flag_at("Review_Flag"))}
    joined = join_answers(rows, F.col("needs_semantic"), row_key, answers, key, fields)
    c = F.col
    fixed = F.when(c("skip"), rules.uninformative_label).when(c("non_failure"), rules.healthy_label)
    ok = c("_status") == "ok"
    done = c("skip") | (c("op_status") == "ok") & (~c("needs_semantic") | F.coalesce(ok, F.lit(False)))
    skipped_type = F.concat(F.lit(SEMANTIC_SKIPPED_REASON),
                            c("P4_Maintenance_Type"), F.lit("."))
    fixed_rows = c("skip") | c("non_failure")
    confidence = F.when(fixed_rows, c("P4_Operational_Confidence")).otherwise(
        lower_confidence(c("P4_Operational_Confidence"), c("_confidence")))
    flag = F.when(fixed_rows, c("P4_Operational_Review_Flag")).otherwise(
        c("P4_Operational_Review_Flag") | c("_flag"))
    reasoning = F.when(c("skip"), c("op_reasoning")).when(
        c("non_failure"), F.concat(c("op_reasoning"), skipped_type)
    ).otherwise(F.concat(c("op_reasoning"), F.lit(" | FMEA: "), c("_reasoning")))
    result = {
        **{f"P4_{n}": F.coalesce(fixed, c(f"_{n}")) for n in MODE_NAMES},
        "P4_Reasoning": reasoning,
        "P4_Confidence": confidence,
        "P4_Review_Flag": flag,
        "P4_Semantic_Confidence": F.when(fixed_rows, "High").otherwise(c("_confidence")),
        "P4_Semantic_Review_Flag": F.when(fixed_rows, F.lit(False)).otherwise(c("_flag")),
    }
    first_half = ("P4_System_Code", "P4_Maintenance_Type", "P4_Action_Taken",
                  "P4_Operational_Confidence", "P4_Operational_Review_Flag")
    return (joined.withColumns({
        "P4_Status": F.when(c("op_status") != "ok", c("op_status")).when(~c("needs_semantic"), "ok").otherwise(
            F.coalesce("_status", F.lit("pending"))),
        "code_mismatch": c("code_mismatch") | F.coalesce(c("_answered_code") != c("code"), F.lit(False)),
        **{n: F.when(done, v) for n, v in result.items()},
        **attempt_columns("P4_Semantic"),
        **{n: F.when(done, c(n)) for n in first_half}})
        .drop("_status", "op_reasoning", *STATE, *fields))
