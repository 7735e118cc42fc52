"""Failure dictionaries as JSON: {code: {topology: {Actions, Failure_Modes}}} and older shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import NOT_ENOUGH
from faultline.operators.dictionary import MODE_TYPE, TEXT_FIELDS, bare_mode
from faultline.functions.text import strip


def _mode(v: Column, placeholder: str) -> Column:
    """A mode given as an object (Symptom or Symptom_Effect) or as a bare name."""
    def text(name: str) -> Column:
        return F.coalesce(strip(F.try_variant_get(v, f"$.{name}", "string")), F.lit(""))

    symptom = F.coalesce(F.nullif(text("Symptom"), F.lit("")), text("Symptom_Effect"))
    full = F.struct(
        text("Failure_Mode").alias("failure_mode"), text("Mechanism").alias("mechanism"),
        text("Cause").alias("cause"), symptom.alias("symptom"),
        F.try_variant_get(v, "$.Frequency_in_Logs", "bigint").alias("frequency"))
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    bare = bare_mode(strip(F.try_variant_get(v, "$", "string")), placeholder)
    return F.when(is_object, full).when(F.schema_of_variant(v) == "STRING", bare)


def parse_dictionary(texts: DataFrame, column: str, placeholder: str = NOT_ENOUGH) -> DataFrame:
    """Entries (code, topology, actions, modes) from JSON objects keyed by code.

    A value that itself holds Actions or Failure_Modes is valid for every topology.
    """
    def members(v: str) -> Column:
        return F.explode(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))

    codes = (texts.select(F.try_parse_json(column).alias("_doc"))
             .select(members("_doc").alias("_c"))
             .select(F.col("_c.key").alias("code"), F.col("_c.value").alias("_value"))
             .where(F.schema_of_variant("_value").startswith("OBJECT")))
    flat = F.exists(F.map_keys(F.try_variant_get("_value", "$", "map<string,variant>")),
                    lambda k: k.isin("Actions", "Failure_Modes"))
    codes = codes.withColumn("_flat", flat)
    whole = codes.where("_flat").select("code", F.lit(None).cast("string").alias("topology"),
                                        F.col("_value").alias("_entry"))
    split = (codes.where(~F.col("_flat")).select("code", members("_value").alias("_t"))
             .select("code", F.col("_t.key").alias("topology"), F.col("_t.value").alias("_entry")))
    entries = whole.unionByName(split).where(F.schema_of_variant("_entry").startswith("OBJECT"))
    modes = F.filter(
        F.transform(F.try_variant_get("_entry", "$.Failure_Modes", "array<variant>"),
                    lambda v: _mode(v, placeholder)),
        lambda m: m["failure_mode"] != "")
    return entries.select(
        "code", "topology",
        F.coalesce(F.try_variant_get("_entry", "$.Actions", "array<string>"),
                   F.array().cast("array<string>")).alias("actions"),
        F.coalesce(modes, F.array().cast(f"array<{MODE_TYPE}>")).alias("modes"))


def read_dictionary(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Entries from JSON files: one document per file, or one per line as written here."""
    return parse_dictionary(spark.read.text(path, wholetext=not per_line), "value")


def dictionary_json(entries: DataFrame) -> DataFrame:
    """(code, json): one single-key document per code, so a big dictionary stays splittable."""
    names = {"failure_mode": "Failure_Mode", "mechanism": "Mechanism", "cause": "Cause", "symptom": "Symptom"}
    modes = F.transform("modes", lambda m: F.struct(
        *[m[f].alias(names[f]) for f in TEXT_FIELDS], m["frequency"].alias("Frequency_in_Logs")))
    entry = F.struct(F.col("actions").alias("Actions"), modes.alias("Failure_Modes"))
    shaped = entries.select("code", "topology", entry.alias("entry"))
    flat = shaped.where(F.col("topology").isNull()).select(
        "code", F.to_json(F.create_map("code", "entry")).alias("json"))
    named = (shaped.where(F.col("topology").isNotNull()).groupBy("code")
             .agg(F.sort_array(F.collect_list(F.struct("topology", "entry"))).alias("pairs"))
             .select("code", F.to_json(F.create_map("code", F.map_from_entries("pairs"))).alias("json")))
    return flat.unionByName(named)


def write_dictionary(entries: DataFrame, path: str) -> None:
    """One JSON document per line; `read_dictionary(..., per_line=True)` reads it back."""
    dictionary_json(entries).select("json").write.mode("overwrite").text(path)
