"""Mixing sources to target weights: budgets passed down a domain - language - source tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import SPACE_SPLIT
from faultline.operators.sizes import broadcast_if_small, number_rows
from faultline.sources.scratch import stored

#: Rows of a leaf that are ordered together when its boundary is looked for.
BUCKET_ROWS = 4_000
#: What is known of all leaves is broadcast below this size, as JSON text.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Mix:
    """`weights` of tree nodes by path, such as ("web",) or ("web", "en"); a node not named weighs `default`.

    `tokens` is the whole budget, `share` of all tokens where it is None. No leaf gives more than `epochs` times what it has.
    """

    weights: Mapping[tuple, float] = ()
    tokens: int | None = None
    share: float = 0.5
    epochs: int = 2
    seed: int = 17
    default: float = 1.0


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> list[Column]:
    return [a[n].eqNullSafe(b[n]) for n in names]


def _beside(frame: DataFrame, other: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """`frame` with the other columns of `other`; names that are null are equal."""
    return frame.join(other, _same(frame, other, names), how).drop(*[other[n] for n in names])


def budgets(leaves: DataFrame, names: Sequence[str], mix: Mix, total: int) -> DataFrame:
    """(names, n, given): tokens to take from each leaf, whole numbers that sum to `total` or to all there is.

    `leaves` has one row per path of `names` and `n`, its tokens. A node shares its budget among its children by
    weight. What a child cannot supply goes to its siblings, again by weight, and only what no sibling can supply
    goes up to the parent's siblings. The tree is passed down a level at a time. Children that are used up are those
    whose limit by weight lies below a line that running sums over the parent's distinct values find; whole numbers are
    rounded down, and what that leaves goes by one to the largest fractions, ranked in one distributed sort.
    No step gathers a parent's children: distinct limits that sum to T are fewer than the root of 2 T.

    A null name is a path of its own, nodes of weight 0 and leaves without tokens are given nothing, no leaves give
    none, and equal fractions go by name.
    """
    spark = leaves.sparkSession
    tree = leaves.withColumn("_root", F.lit(0))
    limit = (F.sum("n") * mix.epochs).alias("_limit")
    there = leaves.agg(F.sum("n")).first()[0] or 0
    nodes = None
    for depth in range(1, len(names) + 1):
        parent, path = ["_root", *names[:depth - 1]], ["_root", *names[:depth]]
        weight = F.lit(float(mix.default))
        kids = tree.groupBy(*path).agg(limit)
        kids = kids.withColumn("_budget", F.lit(min(total, there * mix.epochs)).cast("long")) if nodes is None else _beside(kids, nodes, parent)
        named = [(*p, float(w)) for p, w in dict(mix.weights).items() if len(p) == depth]
        if named:
            kinds = ", ".join(f"{n} {leaves.schema[n].dataType.simpleString()}" for n in names[:depth])
            known = spark.createDataFrame(named, f"{kinds}, _named double")
            kids, weight = _beside(kids, known, names[:depth], "left"), F.coalesce("_named", weight)
        kids = kids.withColumn("_weight", weight).withColumn("_ratio", F.when(
            (F.col("_weight") > 0) & (F.col("_limit") > 0), F.col("_limit") / F.col("_weight")))
        kids = stored(kids.select(*path, "_limit", "_budget", "_weight", "_ratio"), "nodes")

        # the used-up ones come first in order of limit by weight, so each is judged as if all before it were
        groups = kids.where("_ratio IS NOT NULL").groupBy(*parent, "_ratio").agg(
            F.sum("_limit").alias("_limit"), F.sum("_weight").alias("_weight"), F.first("_budget").alias("_budget"))
        upward, downward = (Window.partitionBy(*parent).orderBy(o) for o in (F.asc("_ratio"), F.desc("_ratio")))
        judged = groups.withColumn("_before", F.sum("_limit").over(upward) - F.col("_limit")).withColumn(
            "_used", F.col("_ratio") <= (F.col("_budget") - F.col("_before")) / F.sum("_weight").over(downward))
        line = stored(judged.groupBy(*parent).agg(
            F.max(F.when(F.col("_used"), F.col("_ratio"))).alias("_line"),
            (F.first("_budget") - F.coalesce(F.sum(F.when(F.col("_used"), F.col("_limit"))), F.lit(0))).alias("_left"),
            F.sum(F.when(~F.col("_used"), F.col("_weight"))).alias("_whole")), "lines")

        used = F.coalesce(F.col("_ratio") <= F.col("_line"), F.lit(False))
        want = F.when(~used & F.col("_ratio").isNotNull(), F.col("_left") * F.col("_weight") / F.col("_whole"))
        shared = _beside(kids, line, parent, "left").withColumn("_want", want).withColumn(
            "_sure", F.when(used, F.col("_limit")).otherwise(F.least(F.coalesce(F.floor("_want"), F.lit(0)), F.col("_limit")))).withColumn(
            "_fraction", F.col("_want") - F.floor("_want"))
        ranked = number_rows(
            shared, [*parent, F.desc_nulls_last("_fraction"), F.asc_nulls_first(names[depth - 1])], "_at")
        rests = ranked.groupBy(*parent).agg(
            F.min("_at").alias("_first"),
            (F.first("_left") - F.sum(F.when(F.col("_want").isNotNull(), F.col("_sure")))).alias("_rest"))
        more = F.when(F.col("_want").isNotNull() & (F.col("_at") - F.col("_first") < F.col("_rest")),
                      F.least(F.lit(1), F.col("_limit") - F.col("_sure"))).otherwise(0)
        nodes = _beside(ranked, rests, parent).select(*path, (F.col("_sure") + more).alias("_budget"))
    return _beside(leaves, nodes.drop("_root"), names).withColumnRenamed("_budget", "given")


def count_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_SPLIT), "")).cast("long")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), levels: Sequence[Column] | None = None, text: str = "text",
                identity: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(row, domain, n_tokens, epoch): each row of `docs`, its columns in `row`, once for each epoch that selects it.

    Each epoch of a leaf is a seeded order of its rows; epochs follow each other and the leaf gives the longest
    prefix of rows within its budget, so no row is cut. Orders come from hashes, so a leaf is found by bucket sums
    and only the bucket with the boundary is sorted: a leaf of any size is spread over many tasks.

    Null levels are a branch of their own; null and empty texts have no tokens and come along with the prefix
    before them; rows alike are taken each; a tie in the order is broken by the identity and then the text.
    An empty table gives none. Leaves may be many: their budgets are made in Spark, the driver reads their sum alone, and
    what is known of leaves is broadcast where it measures under `BROADCAST_BYTES` and joined by exchange beyond.
    """
    levels = list(levels) if levels is not None else default_levels()
    names = [f"_l{i}" for i in range(len(levels))]
    counted = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in zip(names, levels, strict=True)],
        count_tokens(F.col(f"`{text}`").cast("string")).alias("_tokens"),
        F.xxhash64(*[F.col(f"`{c}`") for c in identity], F.col(f"`{text}`")).alias("_key"))
    keyed = stored(counted.select(*names, "_tokens", "_key"), "mix")
    leaves = stored(keyed.groupBy(*names).agg(F.sum("_tokens").alias("n"), F.count("*").alias("rows")), "leaves")
    total = mix.tokens if mix.tokens is not None else int(mix.share * (leaves.agg(F.sum("n")).first()[0] or 0))
    part = lambda e: F.when(F.col("n") > 0, F.expr(e)).otherwise(F.lit(0)).cast("long")
    leaf = broadcast_if_small(budgets(leaves, names, mix, total).select(
        *names, part("given div n").alias("full"), part("given % n").alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long").alias("buckets")), BROADCAST_BYTES)

    def with_leaf(frame: DataFrame) -> DataFrame:
        joined = _beside(frame, leaf, names)
        place = F.xxhash64(F.lit(mix.seed), F.col("full"), F.col("_key"))
        return joined.withColumn("_place", place).withColumn(
            "_bucket", F.floor((F.col("_place") / F.lit(2.0 ** 64) + 0.5) * F.col("buckets")))

    placed = with_leaf(keyed).where("rest > 0")
    sums = placed.groupBy(*names, "_bucket").agg(F.sum("_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy(*names).orderBy("_bucket")) - F.col("n")
    edge = sums.withColumn("before", before).where("before <= rest and before + n > rest").select(
        *[F.col(n).alias(f"e{n}") for n in names], F.col("_bucket").alias("edge"), "before")
    edge = broadcast_if_small(edge, BROADCAST_BYTES)
    here = placed.join(edge, [placed[n].eqNullSafe(F.col(f"e{n}")) for n in names]
                       + [F.col("_bucket") == F.col("edge")])
    order = Window.partitionBy(*names).orderBy("_place", "_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = here.withColumn("upto", F.col("before") + F.sum("_tokens").over(order)).where("upto <= rest").groupBy(
        *[F.col(n).alias(f"c{n}") for n in names]).agg(F.max(F.struct("_place", "_key")).alias("cut"))
    cut = broadcast_if_small(edge.join(last, [F.col(f"e{n}").eqNullSafe(F.col(f"c{n}")) for n in names], "left").select(
        *[f"e{n}" for n in names], "edge", "cut"), BROADCAST_BYTES)

    rowed = with_leaf(counted)
    marked = rowed.join(cut, [rowed[n].eqNullSafe(F.col(f"e{n}")) for n in names], "left")
    chosen = (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("_bucket") < F.col("edge")) | (
        (F.col("_bucket") == F.col("edge")) & F.coalesce(F.struct("_place", "_key") <= F.col("cut"), F.lit(False))))
    epochs = F.when(F.col("full") + chosen.cast("long") > 0, F.sequence(
        F.lit(0).cast("long"), F.col("full") + chosen.cast("long") - 1))
    return marked.withColumn("_epoch", F.explode(epochs)).select(
        "row", F.col(names[0]).alias("domain"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def default_levels(domains: int = 4) -> list[Column]:
    """Domain, language and source of `documents`; a source's domain is its number modulo `domains`."""
    number = F.try_to_number(F.regexp_extract("source", r"(\d+)$", 1), F.lit("999999999"))
    return [F.concat(F.lit("domain"), F.pmod(number.cast("long"), F.lit(domains)).cast("string")), F.col("lang"),
            F.col("source")]
