"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.sources.scratch import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b); the label is the smallest node reachable.

    A round hands each node the smallest label among its neighbours, and the node it was named after takes that
    label too; then every label is replaced by its own label. Sums are combined before they are shuffled, a hot
    node is only ever the large side of a join, and each round's labels are stored, so lineage stays short.
    """
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(
        "a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        named = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        found = both.join(named, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        moved = labels.join(found, "node").select("node", "label", F.least("label", "near").alias("near"))
        hooks = moved.where("near < label").groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        step = moved.join(hooks, "node", "left").select(
            "node", F.col("label").alias("was"), F.least("near", "hook").alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        after = stored(step.join(up, "label", "left").select(
            "node", "was", F.least("label", "top").alias("label")), "labels")
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
