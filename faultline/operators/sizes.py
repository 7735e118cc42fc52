"""Broadcast only what was measured, and number rows without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.sources.scratch import stored


def broadcast_if_small(df: DataFrame, limit_bytes: int) -> DataFrame:
    """A lookup side, computed once; with a broadcast hint when it measures under the limit.

    The frame is stored first, so measuring it costs no second pass over what it was made from.
    Its rows are measured as JSON text. Beyond the limit the join shuffles, whatever its files
    suggest, and adaptive execution splits the partitions of a hot key.
    """
    kept = stored(df, "lookup")
    width = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in kept.columns])))
    total = kept.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(kept) if 2 * total <= limit_bytes else shuffled(kept)


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the input, for a join that shuffles it.

    Left to itself Spark broadcasts what its files make look small. Columns that hardly vary are stored in
    a few bits a row, so a table of millions of rows can look so, and be built in the driver as a map of 100 bytes a row.
    """
    return df.hint("merge")


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position of every row in the total order of the frame.

    Range-partitioned sort, stored once so that partition and offset of a row stay what they
    are; then each partition's start is added. The only thing gathered, and broadcast, is one
    row per partition.
    """
    placed = stored(df.orderBy(*order)
                    .withColumn("_place", F.monotonically_increasing_id())
                    .withColumn("_part", F.shiftright("_place", 33)), "placed")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    offset = F.col("_place") - F.shiftleft(F.col("_part"), 33)
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + offset)
            .drop("_place", "_part", "_start"))
