"""Cost and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import QA_PASS, Pricing
from faultline.operators.sizes import shuffled


def call_cost(input_tokens: Column, output_tokens: Column, pricing: Pricing) -> Column:
    """Exact USD as DECIMAL."""
    def part(tokens: Column, price) -> Column:
        return tokens.cast("decimal(18,0)") * F.lit(price).cast("decimal(10,4)")

    total = part(input_tokens, pricing.input) + part(output_tokens, pricing.output)
    return (total / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(28,10)")


def call_metrics(calls: DataFrame, pricing: Pricing) -> DataFrame:
    """Rows, tokens, seconds and cost per phase and batch.

    `calls` holds phase, batch_id, rows_processed, input_tokens, output_tokens, seconds.
    """
    totals = calls.groupBy("phase", "batch_id").agg(
        F.sum(F.col("rows_processed").cast("bigint")).alias("rows_processed"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("seconds"), 2).alias("seconds"))
    return totals.withColumn(
        "cost_usd", F.round(call_cost(F.col("input_tokens"), F.col("output_tokens"), pricing), 6))


def run_report(ledger: DataFrame, rows_of_calls: DataFrame, pricing: Pricing) -> DataFrame:
    """What was asked, by batch, by phase and in all: (level, phase, batch_id, rows, calls, tokens, seconds, cost_usd).

    `rows_of_calls` (phase, call_id, rows) says how many rows share a call: equal questions are asked once, and an answer
    counts for all of them. A call that is asked again counts again.
    """
    asked = ledger.join(shuffled(rows_of_calls), ["phase", "call_id"], "left")
    sets = asked.groupingSets([["phase", "batch_id"], ["phase"], []], "phase", "batch_id").agg(
        F.grouping_id("phase", "batch_id").alias("_id"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 2).alias("seconds"))
    level = F.when(F.col("_id") == 0, "batch").when(F.col("_id") == 1, "phase").otherwise("run")
    return sets.select(level.alias("level"), "phase", "batch_id", "rows", "calls", "input_tokens", "output_tokens", "seconds",
                       F.round(call_cost(F.col("input_tokens"), F.col("output_tokens"), pricing), 6).alias("cost_usd"))


def ledger_metrics(ledger: DataFrame, pricing: Pricing) -> DataFrame:
    return call_metrics(ledger.withColumn("rows_processed", F.lit(1)), pricing)


def run_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.sum("rows_processed").alias("rows_processed"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        (F.sum("seconds") / 60).alias("minutes"))


def qa_distribution(rows: DataFrame) -> DataFrame:
    """Statuses with their counts, NULL included, most frequent first."""
    return (rows.groupBy("QA_Status").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "QA_Status"))


def pass_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("QA_Status") == QA_PASS).alias("passed"),
                    F.count(F.lit(1)).alias("total"))


def route_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def preview(rows: DataFrame, n: int = 5, key: str = "wo_id") -> DataFrame:
    """First n rows in key order, found per partition before anything is merged."""
    return rows.orderBy(key).limit(n)
