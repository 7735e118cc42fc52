"""Failure dictionaries: group texts, extraction results, lookup and answer options.

A dictionary has two forms. Long: one row per action and mode (LONG_SCHEMA), which is what answers are summed into
and checked against, whatever its length. As entries: one row per (code, topology) with `actions array<string>` and `modes
array<struct<failure_mode,mechanism,cause,symptom,frequency>>`, gathered only for texts that list them all: prompts and
JSON. Topology NULL stands for an entry that holds for every variant of the code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import (
    DEFAULT_ACTION_ESCAPES, DEFAULT_MODE_ESCAPES, NOT_ENOUGH, STANDARD_TOPOLOGY, UNKNOWN, Limits, Rules,
)
from faultline.functions.text import normalise, strip
from faultline.operators.sizes import broadcast_if_small

MODE_TYPE = "struct<failure_mode:string,mechanism:string,cause:string,symptom:string,frequency:bigint>"
ENTRY_SCHEMA = f"code string, topology string, actions array<string>, modes array<{MODE_TYPE}>"
#: A row is an action (`action` set), a mode (`failure_mode` set), or neither for an entry that lists nothing.
LONG_SCHEMA = ("code string, topology string, piece bigint, pos int, action string, failure_mode string, mechanism string, "
               "cause string, symptom string, frequency bigint")
TEXT_FIELDS = ("failure_mode", "mechanism", "cause", "symptom")


# ---- groups and their texts

def group_code(code: Column) -> Column:
    return F.coalesce(code, F.lit(UNKNOWN))


def group_sizes(lines: DataFrame, limits: Limits) -> DataFrame:
    """(code, topology, n_rows, n_chars, n_pieces, system_name) per group.

    `system_name` is that of the group's first row.
    """
    return lines.groupBy("code", "topology").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_chars").alias("n_chars"),
        F.min_by("system_name", F.struct("row_id", "system_name")).alias("system_name"),
    ).withColumn("n_pieces", F.greatest(
        F.ceil(F.col("n_chars") / limits.batch_chars).cast("bigint"), F.lit(1).cast("bigint")))


def batch_line(description: Column) -> Column:
    """List entry for an (already redacted) description, NULL for a blank one."""
    return F.concat(F.lit("- "), normalise(description))


def line_chars(line: Column) -> Column:
    """Room a line takes in its group's text."""
    return F.coalesce(F.length(line).cast("bigint") + 1, F.lit(0).cast("bigint"))


def salt(row_id: Column, line: Column, n: Column) -> Column:
    """Even spread of lines over n pieces, the same in every run; rows without a number differ by their text."""
    known = F.concat_ws("\u001f", row_id.cast("string"), line)
    return F.conv(F.substring(F.md5(known), 1, 8), 16, 10).cast("bigint") % n


def group_batches(lines: DataFrame, limits: Limits) -> DataFrame:
    """(code, topology, piece, n_pieces, system_name, n_rows, batch_text), text in order of row_id and line.

    A group within `limits.batch_chars` is one piece with its whole text. A larger one is
    spread over as many pieces as it needs, each line in exactly one, so no task ever gathers
    a hot group; the dictionary built from the pieces is merged again. Lines that are alike in
    number and text are counted first and dealt to the pieces in turn, so that copies are spread
    as well and a second run makes the same pieces.
    """
    sizes = group_sizes(lines, limits)
    head = broadcast_if_small(
        sizes.select("code", "topology", "n_pieces", "system_name"), limits.broadcast_bytes)
    keys = ["code", "topology", "n_pieces", "system_name"]
    placed = lines.select("code", "topology", "row_id", "line").join(head, ["code", "topology"])
    whole = placed.where("n_pieces = 1").select(*keys, "row_id", "line", F.lit(0).cast("bigint").alias("piece"),
                                                F.lit(1).cast("bigint").alias("times"))
    alike = placed.where("n_pieces > 1").groupBy(*keys, "row_id", "line").agg(F.count(F.lit(1)).alias("n"))
    turn = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("n", "n_pieces") - 1))
    dealt = alike.withColumn("k", turn).select(
        *keys, "row_id", "line", ((salt(F.col("row_id"), F.col("line"), F.col("n_pieces")) + F.col("k")) % F.col("n_pieces")).alias("piece"),
        F.floor((F.col("n") - F.col("k") - 1) / F.col("n_pieces") + 1).cast("bigint").alias("times"))
    gathered = F.sort_array(F.collect_list(
        F.when(F.col("line").isNotNull(), F.struct("row_id", "line", "times"))))
    repeated = F.flatten(F.transform(gathered, lambda x: F.array_repeat(x["line"], x["times"].cast("int"))))
    return whole.unionByName(dealt).groupBy("code", "topology", "piece", "n_pieces", "system_name").agg(
        F.sum("times").alias("n_rows"), F.array_join(repeated, "\n").alias("batch_text"))


# ---- extraction results

def extracted_modes(answer: str = "answer") -> Column:
    """Modes of a valid extraction answer, trimmed, blank ones dropped."""
    raw = F.try_variant_get(
        answer, "$.Failure_Modes",
        "array<struct<Failure_Mode:string,Mechanism:string,Cause:string,"
        "Symptom_Effect:string,Symptom:string,Frequency_in_Logs:decimal(18,0)>>")
    cleaned = F.transform(raw, lambda m: F.struct(
        strip(F.coalesce(m["Failure_Mode"], F.lit(""))).alias("failure_mode"),
        strip(F.coalesce(m["Mechanism"], F.lit(""))).alias("mechanism"),
        strip(F.coalesce(m["Cause"], F.lit(""))).alias("cause"),
        strip(F.coalesce(F.nullif(m["Symptom_Effect"], F.lit("")), m["Symptom"], F.lit(""))).alias("symptom"),
        m["Frequency_in_Logs"].cast("bigint").alias("frequency")))
    return F.filter(cleaned, lambda m: m["failure_mode"] != "")


def extracted_actions(answer: str = "answer") -> Column:
    return F.try_variant_get(answer, "$.Empirical_Actions_Taken", "array<string>")


def long_lists(lists: DataFrame) -> DataFrame:
    """The long dictionary (LONG_SCHEMA) of rows (code, topology, piece, actions, modes).

    One rule for any number of pieces: equal actions once, equal modes once with their frequencies
    summed, each at its first place. Sums are made before anything is sent, so neither a long
    list nor a hot key gathers anywhere.
    """
    keys = ["code", "topology"]
    items = [f for f in ("action", *TEXT_FIELDS)]

    def rows(name: str, fields: dict[str, Column]) -> DataFrame:
        found = lists.select(*keys, F.col("piece").cast("bigint").alias("piece"), F.posexplode(name).alias("pos", "item"))
        return found.select(*keys, "piece", "pos", *[fields.get(f, F.lit(None).cast("string")).alias(f) for f in items],
                            fields.get("frequency", F.lit(None).cast("bigint")).alias("frequency"))

    actions = rows("actions", {"action": F.col("item")})
    modes = rows("modes", {f: F.col(f"item.{f}") for f in (*TEXT_FIELDS, "frequency")})
    nothing = lists.select(*keys).distinct().select(*keys, F.lit(None).cast("bigint").alias("piece"), F.lit(None).cast("int").alias("pos"), *[
        F.lit(None).cast("string").alias(f) for f in items], F.lit(None).cast("bigint").alias("frequency"))
    place = F.min(F.when(F.col("piece").isNotNull(), F.struct("piece", "pos"))).alias("place")
    found = actions.unionByName(modes).unionByName(nothing).groupBy(*keys, *items).agg(place, F.sum("frequency").alias("frequency"))
    return found.select(*keys, "place.piece", "place.pos", *items, "frequency")


def gather_entries(long: DataFrame) -> DataFrame:
    """Entries of a long dictionary, lists in order of place: for texts that show them all."""
    place = F.struct("piece", "pos")

    def listed(present: str, value: Column) -> Column:
        # what is alike in place is told apart by value, so a list comes out the same in every run
        held = F.when(F.col("piece").isNotNull() & F.col(present).isNotNull(), F.struct(place.alias("place"), value.alias("value")))
        return F.transform(F.sort_array(F.collect_list(held)), lambda x: x["value"])

    modes = listed("failure_mode", F.struct(*TEXT_FIELDS, "frequency"))
    return long.groupBy("code", "topology").agg(
        listed("action", F.col("action")).cast("array<string>").alias("actions"), modes.cast(f"array<{MODE_TYPE}>").alias("modes"))


def merge_lists(lists: DataFrame) -> DataFrame:
    """One entry per (code, topology) from rows (code, topology, piece, actions, modes)."""
    return gather_entries(long_lists(lists))


def long_dictionary(answers: DataFrame) -> DataFrame:
    """The long dictionary of valid extraction answers (code, topology, piece, answer)."""
    return long_lists(answers.select(
        "code", "topology", "piece", extracted_actions().alias("actions"), extracted_modes().alias("modes")))


def build_dictionary(answers: DataFrame) -> DataFrame:
    """Entries from valid extraction answers (code, topology, piece, answer)."""
    return gather_entries(long_dictionary(answers))


def long_entries(entries: DataFrame) -> DataFrame:
    """The long dictionary of entries that may list a key more than once, merged by the rule of pieces."""
    return long_lists(entries.select("code", "topology", F.lit(0).alias("piece"), "actions", "modes"))


def one_per_key(entries: DataFrame) -> DataFrame:
    """Entries of a dictionary that may list a key more than once, merged by the rule of pieces."""
    return gather_entries(long_entries(entries))


def mode_frequency(entries: DataFrame) -> DataFrame:
    """How many work orders each failure mode accounts for."""
    return (entries.select("code", "topology", F.inline("modes"))
            .groupBy("code", "topology", "failure_mode")
            .agg(F.sum("frequency").alias("frequency")))


# ---- lookup

def lookup_entries(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(code, topology, entry_topology, found) for distinct pairs of rows.

    Order of preference: an entry for every variant, the exact variant, the standard variant,
    the only variant there is. Every join is at most one to one, so nothing fans out; only keys
    travel, the lists stay behind.
    """
    keys = entries.select("code", "topology").distinct()
    flat = keys.where(F.col("topology").isNull()).select("code", F.lit(True).alias("flat")).distinct()
    named = keys.where(F.col("topology").isNotNull())
    exact = named.select("code", "topology", F.lit(True).alias("exact"))
    per_code = named.groupBy("code").agg(
        F.bool_or(F.col("topology") == STANDARD_TOPOLOGY).alias("standard"),
        F.count(F.lit(1)).alias("n"), F.min("topology").alias("only"))
    choice = (F.when(F.col("flat"), F.lit(None).cast("string"))
              .when(F.col("exact"), F.col("topology"))
              .when(F.col("standard"), F.lit(STANDARD_TOPOLOGY))
              .when(F.col("n") == 1, F.col("only")))
    return (pairs.join(exact, ["code", "topology"], "left")
            .join(flat, "code", "left").join(per_code, "code", "left")
            .select("code", "topology", choice.alias("entry_topology"),
                    (F.coalesce("flat", F.lit(False)) | choice.isNotNull()).alias("found")))


def attach_entry(rows: DataFrame, entries: DataFrame, columns: Sequence[str], limits: Limits) -> DataFrame:
    """Adds `columns` of the entry each row resolves to; NULL where there is none."""
    pairs = rows.select("code", "topology").distinct()
    found = lookup_entries(pairs, entries).where("found")
    # a key that is listed again must not multiply rows: the greatest of its values holds
    side = entries.groupBy(F.col("code").alias("_code"), F.col("topology").alias("_topology")).agg(
        F.max(F.struct(*columns)).alias("_entry")).select("_code", "_topology", "_entry.*")
    resolved = found.join(
        side, (F.col("code") == F.col("_code")) & F.col("entry_topology").eqNullSafe(F.col("_topology")))
    resolved = broadcast_if_small(resolved.select("code", "topology", *columns), limits.broadcast_bytes)
    return rows.join(resolved, ["code", "topology"], "left")


# ---- options an answer may choose from

def clean_modes(modes: Column) -> Column:
    """Trimmed modes, blank ones dropped; fields of a bare mode name say 'Not Enough Information'."""
    def text(m: Column, f: str) -> Column:
        return strip(F.coalesce(m[f], F.lit("")))

    return F.filter(
        F.transform(modes, lambda m: F.struct(*[text(m, f).alias(f) for f in TEXT_FIELDS])),
        lambda m: m["failure_mode"] != "")


def bare_mode(name: Column, placeholder: str = NOT_ENOUGH) -> Column:
    """Full mode for a dictionary that lists only names."""
    return F.struct(name.alias("failure_mode"),
                    *[F.lit(placeholder).alias(f) for f in TEXT_FIELDS[1:]],
                    F.lit(None).cast("bigint").alias("frequency"))


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def distinct_texts(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x != ""))


def action_options(actions: Column, escapes: Sequence[str]) -> Column:
    known = F.coalesce(actions, _literals(()))
    return distinct_texts(F.concat(known, _literals(escapes or DEFAULT_ACTION_ESCAPES)))


def mode_options(modes: Column) -> Column:
    """Distinct four-field modes in order."""
    return F.array_distinct(F.coalesce(
        clean_modes(modes),
        F.array().cast("array<struct<failure_mode:string,mechanism:string,cause:string,symptom:string>>")))


def escape_modes(escapes: Sequence[str]) -> Column:
    return distinct_texts(_literals(escapes or DEFAULT_MODE_ESCAPES))


def allowed_values(long: DataFrame, keys: DataFrame, rules: Rules, no_entry: Column) -> DataFrame:
    """What answers may say, one distinct row (options_key, action or the four mode fields) each.

    `keys` names the options_key of each (code, topology); `no_entry` is that of rows without an entry. Blank actions
    and modes are no options; escape actions hold everywhere.
    """
    # a name of their own, so that sides of one table can be joined
    named = keys.select(F.col("code").alias("_code"), F.col("topology").alias("_topology"), "options_key")
    of = long.join(named, F.col("code").eqNullSafe(F.col("_code")) & F.col("topology").eqNullSafe(F.col("_topology")))
    none = [F.lit(None).cast("string").alias(f) for f in TEXT_FIELDS]
    texts = [strip(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in TEXT_FIELDS]
    actions = of.where(F.col("action").isNotNull()).select("options_key", strip("action").alias("action"), *none).where("action <> ''")
    modes = of.where(F.col("failure_mode").isNotNull()).select("options_key", F.lit(None).cast("string").alias("action"), *texts).where(
        "failure_mode <> ''")
    every = keys.select("options_key").unionByName(keys.sparkSession.range(1).select(no_entry.alias("options_key"))).distinct()
    escapes = every.select("options_key", F.explode(distinct_texts(_literals(rules.action_escapes or DEFAULT_ACTION_ESCAPES))).alias("action"), *none)
    return actions.unionByName(modes).unionByName(escapes).distinct()


def action_list_text(options: Column) -> Column:
    """Allowed actions as shown in a prompt: exactly what the contract accepts."""
    return F.array_join(options, ", ")


def mode_lines(modes: Column) -> Column:
    """Modes as '- {json}' lines."""
    def named(m: Column) -> Column:
        return F.struct(m["failure_mode"].alias("Failure_Mode"), m["mechanism"].alias("Mechanism"),
                        m["cause"].alias("Cause"), m["symptom"].alias("Symptom"))

    return F.array_join(F.transform(modes, lambda m: F.concat(F.lit("- "), F.to_json(named(m)))), "\n")


def mode_list_text(options: Column, escapes: Column) -> Column:
    """Allowed modes as shown in a prompt: the listed ones, then the escapes."""
    tail = F.array_join(escapes, ", ")
    return F.when(F.size(options) > 0, F.concat(mode_lines(options), F.lit("\nor one of: "), tail)).otherwise(tail)
