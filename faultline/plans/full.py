"""The whole job: correction, audit, relabelling, dictionaries, labels, merges, quality status.

Work-order texts are wide, so they are shuffled only where a step needs text and code together.
Everything about calls and answers runs on narrow tables keyed by row, and each phase's
result is a table below the run's folder. Runs never overwrite each other's tables; the ledger
they share is what makes a second run cheap: it asks only what is new.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import ROUTE_BYPASSED, Config
from faultline.functions.contract import (
    AUDIT, CLASSIFICATION, EXTRACTION, OPERATIONAL, SEMANTIC, Contract, check_response, parse_response,
)
from faultline.operators.dictionary import gather_entries, line_chars, long_entries
from faultline.operators.hooks import Labeller
from faultline.operators.ledger import call_states, label_pending, read_ledger
from faultline.operators.metrics import run_report
from faultline.operators.merge import merge_codes, merge_failures, merge_labels, with_qa_status
from faultline.operators.routing import needs_relabel, with_route
from faultline.operators.sizes import broadcast_if_small, shuffled
from faultline.operators.taxonomy import (
    branch_members, kept_branch_texts, members_version, require_pitch_prefixes, row_branch, taxonomy_nodes, with_order,
)
from faultline.plans import codes, extraction, labels


@dataclass(frozen=True)
class Run:
    """Where a run keeps its tables and how it asks. Runs with one folder share a ledger."""

    spark: SparkSession
    folder: str
    config: Config
    labeller: Labeller
    partitions: int = 10
    extraction_partitions: int = 5
    slices: int = 1
    #: A phase's attempts in more files than this are compacted before it asks; 0, never, where several runs write one ledger at once.
    compact_files: int = 2_000
    name: str = field(default_factory=lambda: uuid4().hex)
    batches: list[str] = field(default_factory=list)
    asked: list[str] = field(default_factory=list)

    @property
    def ledger(self) -> str:
        return f"{self.folder}/ledger"

    def path(self, table: str) -> str:
        return f"{self.folder}/tables/{self.name}/{table}"

    def table(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """Writes a step's result, in one folder per value of `by`, and goes on from the written table."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def ask(self, phase: str, contract: Contract, calls: DataFrame,
            prompt: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame] | None = None,
            system_prompt: str | None = None, shared: DataFrame | None = None) -> DataFrame:
        """Labels what is pending and returns (call_id, status, answer)."""
        self.asked.append(phase)
        self.batches.extend(label_pending(calls, self.ledger, phase, contract, system_prompt or self.config.prompts.engineer,
                      self.labeller, prompt,
                      check or (lambda df: check_response(df, contract)),
                      self.config.rules.max_attempts,
                      self.extraction_partitions if phase == extraction.P3 else self.partitions, self.slices, self.compact_files, shared))
        return self.answers(phase, calls.select("call_id"))

    def answers(self, phase: str, wanted: DataFrame | None = None) -> DataFrame:
        """Answers with their attempts; of those compacted before, the `wanted` ones only."""
        state = call_states(self.spark, self.ledger, phase, wanted)
        failed = ~F.col("done") & (F.col("attempts") >= self.config.rules.max_attempts)
        return parse_response(state.withColumn("failed", failed).drop("done"))


@dataclass(frozen=True)
class Branches:
    """A taxonomy's branch members, and where the texts of this version are kept."""

    members: DataFrame
    folder: str


def branches(run: Run, taxonomy: DataFrame) -> Branches:
    """Orders the taxonomy once, for as many calls of `run_codes` as follow. Runs with one folder share the texts."""
    members = run.table("branch_members", branch_members(with_order(taxonomy_nodes(taxonomy)), run.config.taxonomy))
    return Branches(members, f"{run.folder}/branches/{members_version(members)}")


def run_codes(run: Run, rows: DataFrame, taxonomy: DataFrame | Branches) -> tuple[DataFrame, DataFrame]:
    """The stored work orders, and row_key with P1, P2, P2b and merged code columns.

    Work orders are stored once, in one folder per route and with their call names, so texts
    are searched and hashed once and each phase reads only the folders it asks about.
    """
    config = run.config
    routed = with_route(rows, config.taxonomy)
    require_pitch_prefixes(routed, F.col("route") != ROUTE_BYPASSED, config.taxonomy)
    tree = taxonomy if isinstance(taxonomy, Branches) else branches(run, taxonomy)
    shown_to = row_branch(F.col("system_code"), F.col("descriptions"), config.taxonomy)
    wanted = routed.select(F.explode(F.array(F.when(F.col("route") != ROUTE_BYPASSED, shown_to), F.when(
        F.col("route") == ROUTE_BYPASSED, "all"))).alias("branch")).where("branch IS NOT NULL")
    texts = kept_branch_texts(tree.members, config.limits, wanted, tree.folder)
    named = codes.correction_rows(codes.with_prompt_parts(routed, config), texts, config)
    named = codes.relabel_rows(codes.audit_rows(named, config), texts, config)
    # work-order numbers may repeat, so rows get a key of their own, fixed once they are stored
    keyed = named.drop(*codes.PARTS.values(), "parts_hash").withColumn("row_key", F.monotonically_increasing_id())
    stored = run.table("work_orders", keyed, by="route")
    calls_of = codes.with_prompt_parts(stored, config)
    shown = texts.select(F.col("branch").alias("shared"), "text")

    def classify(calls: DataFrame) -> DataFrame:
        return calls.withColumn("pieces", codes.classify_pieces(config)).withColumnRenamed("branch", "shared")

    p1 = run.ask(codes.P1, CLASSIFICATION, codes.classification_calls(calls_of, codes.P1), classify, shared=shown)
    p2 = run.ask(codes.P2, AUDIT, codes.audit_calls(calls_of),
                 lambda calls: calls.withColumn("prompt", codes.audit_prompt(config)), system_prompt=config.prompts.auditor)
    kept = [c for c in ("Legacy_System_Code",) if c in rows.columns]
    plan = stored.select("row_key", "row_id", "system_code", "route", "P1_Audit_Exempt", "P1_branch_problem",
                         "P2_RELABEL_branch_problem", "P1_call", "P2_call", "P2_RELABEL_call", *kept)
    asked, bypassed = plan.where(F.col("route") != ROUTE_BYPASSED), plan.where(F.col("route") == ROUTE_BYPASSED)
    audited = run.table("audited", codes.apply_audit(codes.apply_correction(asked, p1), None).unionByName(
        codes.apply_audit(codes.apply_correction(bypassed, None), p2)))
    flagged = audited.where(needs_relabel()).select(F.col("P2_RELABEL_call").alias("call_id")).distinct()
    p2b = run.ask(codes.P2B, CLASSIFICATION,
                  codes.classification_calls(calls_of, codes.P2B).join(shuffled(flagged), "call_id", "left_semi"),
                  classify, shared=shown)
    relabelled = codes.apply_split(audited, needs_relabel(), p2b, codes.apply_relabel)
    merged = merge_codes(relabelled, config.rules.code_gate).drop(
        "row_id", "system_code", "route", "P1_branch_problem", "P2_RELABEL_branch_problem", "P1_call", "P2_call", "P2_RELABEL_call")
    return stored.select("row_key", *rows.columns), run.table("codes", merged)


def with_codes(run: Run, rows: DataFrame, coded: DataFrame) -> DataFrame:
    """Texts beside active code and topology key: the one wide shuffle before P3 and P4."""
    config = run.config
    grouped = labels.with_group(rows.join(shuffled(coded.select("row_key", "Merged_System_Code")), "row_key"), config)
    grouped = labels.with_label_parts(grouped, config).withColumn(
        "n_chars", line_chars(extraction.row_line(config)))
    return run.table("coded", grouped.select(
        "row_key", "row_id", "system_name", "descriptions", "code", "topology", "skip", "parts_hash", "n_chars"))


def run_dictionary(run: Run, grouped: DataFrame) -> DataFrame:
    """The long dictionary; only groups that are new or changed are asked about."""
    calls = run.table("batches", extraction.extraction_calls(grouped, run.config))
    answered = run.ask(extraction.P3, EXTRACTION, calls.dropDuplicates(["call_id"]),
                       lambda df: df.withColumn("prompt", extraction.extraction_prompt(run.config)))
    return run.table("dictionary_long", extraction.long_from_answers(calls, answered))


def run_labels(run: Run, grouped: DataFrame, dictionary: DataFrame) -> DataFrame:
    """row_key with the P4 columns. Prompts show gathered lists; answers are joined with the long dictionary."""
    config = run.config
    entries = run.table("dictionary", gather_entries(dictionary))
    allowed = broadcast_if_small(labels.allowed(dictionary, entries, config.rules), config.limits.broadcast_bytes)
    named = labels.operational_rows(grouped, entries, config)
    plan = run.table("label_plan", named.select("row_key", "row_id", "code", "skip", "P4_OPERATIONAL_call"))
    options = broadcast_if_small(labels.option_sets(entries, config.rules).select("options_key", "actions_text", "modes_text"), config.limits.broadcast_bytes)

    def prompt_with(column):
        return lambda calls: calls.join(options, "options_key").withColumn("prompt", column)

    calls = labels.operational_calls(named, config)
    first = run.ask(labels.P4_OPERATIONAL, OPERATIONAL, calls, prompt_with(labels.operational_prompt(config)),
                    lambda df: labels.check_operational(df, allowed))
    halfway = run.table("operational", labels.with_semantic_call(codes.apply_split(
        plan, ~F.col("skip"), first, lambda rows, got: labels.apply_operational(rows, got, config.rules)), config))
    second = run.ask(labels.P4_SEMANTIC, SEMANTIC, labels.semantic_calls(halfway, calls),
                     prompt_with(labels.semantic_prompt(config)),
                     lambda df: labels.check_semantic(df, allowed, config.rules))
    done = codes.apply_split(halfway, F.col("needs_semantic"), second,
                             lambda rows, got: labels.apply_semantic(rows, got, config.rules))
    return run.table("labels", done.select("row_key", "P4_Status", "code_mismatch", *sorted(
        c for c in done.columns if c.startswith("P4_") and c not in (
            "P4_Status", "P4_OPERATIONAL_call", "P4_SEMANTIC_call"))))


#: Where the rows of a phase and the names of their calls are kept.
CALLS = {codes.P1: ("work_orders", "P1_call"), codes.P2: ("work_orders", "P2_call"), codes.P2B: ("work_orders", "P2_RELABEL_call"),
         extraction.P3: ("batches", "call_id"), labels.P4_OPERATIONAL: ("operational", "P4_OPERATIONAL_call"),
         labels.P4_SEMANTIC: ("operational", "P4_SEMANTIC_call")}


def report(run: Run) -> DataFrame:
    """What this run asked so far, by batch, phase and in all, from its own tables; see `run_report`."""
    asked = read_ledger(run.spark, run.ledger).where(F.col("batch_id").isin(run.batches))
    sides = run.spark.createDataFrame([], "call_id string, rows long, phase string")
    for phase in run.asked:
        table, call = CALLS[phase]
        # a group's call stands for all its rows
        rows = F.sum("n_rows") if phase == extraction.P3 else F.count(F.lit(1))
        # a table of no rows may have no file to take columns from
        named = run.spark.read.schema(f"{call} string, n_rows bigint").parquet(run.path(table)).where(F.col(call).isNotNull())
        sides = sides.unionByName(named.groupBy(F.col(call).alias("call_id")).agg(rows.alias("rows")).withColumn("phase", F.lit(phase)))
    return run_report(asked, sides, run.config.pricing)


def finish(rows: DataFrame, coded: DataFrame, labelled: DataFrame, config: Config) -> DataFrame:
    """Merged labels and quality status on the full rows."""
    produced = ({*coded.columns} | {*labelled.columns}) - {"row_key"}
    joined = rows.drop(*produced).join(shuffled(coded), "row_key").join(shuffled(labelled), "row_key").drop("row_key")
    return with_qa_status(merge_failures(merge_labels(joined, config.rules), config.rules), config.rules.qa)


#: Names of the job's own results. Those of an earlier pass are made anew; legacy copies, which are not among them, stay.
RESULTS = re.compile(r"(P1|P2|P2_Relabel|P4|Merged)_\w+|\w+_Corrected_Flag|QA_Status|code_mismatch", re.I)


def full_run(run: Run, rows: DataFrame, taxonomy: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Everything in order, also on the result of an earlier pass. Pass an edited `dictionary` to label with that instead."""
    rows = rows.drop(*[c for c in rows.columns if RESULTS.fullmatch(c)])
    rows, coded = run_codes(run, rows, taxonomy)
    grouped = with_codes(run, rows, coded)
    entries = run.table("dictionary_long", long_entries(dictionary)) if dictionary is not None else run_dictionary(run, grouped)
    labelled = run_labels(run, grouped, entries)
    run.table("report", report(run))
    return finish(rows, coded, labelled, run.config)
