"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from faultline.llm.common import WORD, share_library
from faultline.sources.scratch import stored

#: Domains by weight and English twice as heavy as another language; sources of one language alike.
WEIGHTS = {(f"domain{i}",): 4 - i for i in range(4)} | {(f"domain{i}", "en"): 2 for i in range(4)}
#: Part of all tokens that is taken, each document once at most.
SHARE = 0.8


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, `n_chars` counted anew."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs and of whole short texts go, and with them documents of which no word is left."""
    cut = line_dedup.remove_repeated_lines(docs, whole_texts=True)
    left = cut.where((F.col("n_removed") == 0) | F.col("row.text").rlike(WORD)).select("row.*")
    return _with_length(left, docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest id."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of all tokens in the target weights."""
    return mixing.mix_sources(docs, mixing.Mix(WEIGHTS, share=SHARE, epochs=1)).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: Hash orders, fingerprints and token ids have no counterpart in SQL; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_library(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
