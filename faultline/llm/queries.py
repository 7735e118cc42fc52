"""Registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    backoff_lm, byte_cnn, html_text, jaccard_join, line_dedup, mixing, neighbours, packing, quality_rules, secrets, suffix_dedup,
    vector_codes, whitening,
)
from faultline.llm.common import share_library, table
from faultline.llm.sql import ORACLE

QUERIES = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_library(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, how many bytes are left, and the text they make; what a cut leaves of a character reads U+FFFD."""
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.withColumn("text", F.expr("make_valid_utf8(CAST(kept AS STRING))")).drop("kept")


@query
def op2_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines and what is left of each text once later copies of line runs of 50 words or more, and of whole
    shorter texts, are gone."""
    left = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"), whole_texts=True)
    return left.select("row.doc_id", "n_lines", "n_removed", F.octet_length("row.text").cast("long").alias("n_bytes_kept"),
                       F.sha2("row.text", 256).alias("kept_sha256"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, domains weighted 4:3:2:1 and English twice as heavy as any other language."""
    weights = {(f"domain{i}",): 4 - i for i in range(4)} | {(f"domain{i}", "en"): 2 for i in range(4)}
    chosen = mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.Mix(weights))
    return chosen.select("row.doc_id", "domain", "row.lang", "row.source", "n_tokens", "epoch")


@query
def op6_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "row.doc_id", *[f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept")


@query
def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))


@query
def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


@query
def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op12_adaptive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    if codes is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return vector_codes.with_label_errors(codes.rows, "label").select(
        "row.vec_id", hexed.alias("code"), "error", "label_error", F.lit(vector_codes.digest(codes.codebooks)).alias("codebooks_sha256"))


@query
def op13_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents"))
