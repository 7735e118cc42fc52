"""Failure dictionaries (P3): one extraction call per (code, topology) group or piece of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import Config
from faultline.functions.contract import EXTRACTION
from faultline.functions.text import or_unknown
from faultline.functions.topology import block_of_key
from faultline.operators.dictionary import batch_line, gather_entries, group_batches, line_chars, long_dictionary
from faultline.operators.hooks import redact_text
from faultline.operators.ledger import call_id
from faultline.operators.prompts import render
from faultline.operators.sizes import shuffled

P3 = "P3"


def row_line(config: Config) -> Column:
    return batch_line(redact_text(F.col("descriptions"), config.redaction))


def batch_lines(rows: DataFrame, config: Config) -> DataFrame:
    """(code, topology, row_id, system_name, line, n_chars) of rows that carry code and topology.

    A stored `n_chars` is used as it is, so that sizing groups reads no text.
    """
    chars = F.col("n_chars") if "n_chars" in rows.columns else line_chars(row_line(config))
    return rows.select("code", "topology", "row_id", "system_name",
                       row_line(config).alias("line"), chars.alias("n_chars"))


def _fields() -> dict[str, Column]:
    return {"system_name": or_unknown(F.col("system_name")), "system_code": F.col("code"),
            "topology_context_block": block_of_key(F.col("topology")), "log_batch_text": F.col("batch_text")}


def extraction_calls(rows: DataFrame, config: Config) -> DataFrame:
    """Groups and pieces with their text and call_id; a changed group asks again, others do not."""
    batches = group_batches(batch_lines(rows, config), config.limits)
    identity = {**_fields(), "log_batch_text": F.sha2("batch_text", 256)}
    return batches.withColumn(
        "call_id", call_id(P3, EXTRACTION, config.prompts.engineer, config.prompts.extract, identity))


def extraction_prompt(config: Config) -> Column:
    return render(config.prompts.extract, _fields())


def long_from_answers(calls: DataFrame, answers: DataFrame, key: str = "call_id") -> DataFrame:
    """The long dictionary of all groups whose pieces all have a valid answer; others are left out and stay pending."""
    good = answers.where(F.col("status") == "ok").select(key, "answer")
    answered = calls.select("code", "topology", "piece", "n_pieces", key).join(shuffled(good), key)
    whole = answered.groupBy("code", "topology").agg(
        F.count_distinct("piece").alias("_have"), F.max("n_pieces").alias("_need")).where("_have = _need")
    return long_dictionary(answered.join(whole.select("code", "topology"), ["code", "topology"], "left_semi"))


def dictionary_from_answers(calls: DataFrame, answers: DataFrame, key: str = "call_id") -> DataFrame:
    """The same as entries with their lists."""
    return gather_entries(long_from_answers(calls, answers, key))
