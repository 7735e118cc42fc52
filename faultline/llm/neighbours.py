"""Approximate nearest neighbours over learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts, and a small network learns which parts hold a
vector's neighbours. Every vector is filed under its most probable part; a query looks into its most
probable ones and ranks what it finds by the exact inner product. How many parts those are is measured: the fewest
that reach the target recall for rows of the sample that the network has not seen, so well separated data need
few and data without structure most of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.sources.scratch import stored

SAMPLE_ROWS = 6000
PARTS = 32
#: Recall that the number of probed parts must reach on held-out rows of the sample.
TARGET_RECALL = 0.95
HELD_OUT = 500
NEIGHBOURS = 12
HIDDEN = 128
TOP = 20
#: Candidates and queries that meet in one task; larger parts are dealt to more tasks.
TASK_CANDIDATES, TASK_QUERIES = 20_000, 4_000


def usable(vector: str) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    v = F.col(f"`{vector}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def neighbour_graph(vectors: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k largest inner products of each row, itself left out."""
    out = np.empty((len(vectors), min(k, len(vectors) - 1)), np.int64)
    for at in range(0, len(vectors), 1024):
        score = vectors[at: at + 1024] @ vectors.T
        score[np.arange(len(score)), at + np.arange(len(score))] = -np.inf
        out[at: at + 1024] = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size, each grown along the edges that tie a node most to it; then nodes swap places while
    that keeps more edges inside."""
    n = len(graph)
    edges: list[set[int]] = [set(row.tolist()) for row in graph]
    for a, row in enumerate(graph.tolist()):
        for b in row:
            edges[b].add(a)
    part = np.full(n, -1, np.int64)
    for p in range(parts):
        room = n * (p + 1) // parts - n * p // parts
        ties, front = {}, []
        while room:
            node = -1
            while front:
                tie, node = heapq.heappop(front)
                if part[node] < 0 and ties[node] == -tie:
                    break
                node = -1
            if node < 0:
                free = np.flatnonzero(part < 0)
                node = int(free[np.argmin([sum(part[e] < 0 for e in edges[i]) for i in free[:64]])])
            part[node], room = p, room - 1
            for e in edges[node]:
                if part[e] < 0:
                    ties[e] = ties.get(e, 0) + 1
                    heapq.heappush(front, (-ties[e], e))
    for _ in range(5):
        held = np.zeros((n, parts))
        for a, near in enumerate(edges):
            np.add.at(held[a], part[list(near)], 1)
        gain = held - held[np.arange(n), part][:, None]
        best = gain.argmax(axis=1)
        waiting: dict[tuple[int, int], list[int]] = {}
        for a in np.argsort(-gain.max(axis=1)):
            if gain[a, best[a]] <= 0:
                break
            back = waiting.get((best[a], part[a]))
            if back:
                b = back.pop()
                part[a], part[b] = part[b], part[a]
            else:
                waiting.setdefault((part[a], best[a]), []).append(int(a))
    return part


@dataclass
class Router:
    """vector -> probability of each part; one hidden layer."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def order(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts, most probable first."""
        z = np.maximum(vectors * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def fit_router(vectors: np.ndarray, parts: int = PARTS, epochs: int = 60, seed: int = 3) -> Router:
    """Learns each sample row's share of neighbours per part, its own part included (Adam, cross entropy)."""
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, len(vectors) // 8))
    graph = neighbour_graph(vectors) if len(vectors) > 1 else np.zeros((len(vectors), 0), np.int64)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(vectors), parts))
    for k in range(graph.shape[1]):
        target[np.arange(len(vectors)), part[graph[:, k]]] += 1
    target[np.arange(len(vectors)), part] += 1
    target /= target.sum(axis=1, keepdims=True)
    scale = 1 / max(float(np.sqrt((vectors ** 2).mean())), 1e-12) if len(vectors) else 1.0
    dim = vectors.shape[1]
    values = [rng.standard_normal((dim, HIDDEN)) * dim ** -0.5, np.zeros(HIDDEN),
              rng.standard_normal((HIDDEN, parts)) * HIDDEN ** -0.5, np.zeros(parts)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(vectors)), max(1, len(vectors) // 128)):
            x = vectors[rows] * scale
            h = np.maximum(x @ values[0] + values[1], 0)
            z = h @ values[2] + values[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (p / p.sum(axis=1, keepdims=True) - target[rows]) / max(1, len(rows))
            dh = dz @ values[2].T * (h > 0)
            grads = [x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]
            step += 1
            for value, grad, (m, v) in zip(values, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= 0.003 * 0.1 ** (epoch / epochs) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Router(scale, *values)


def probes_needed(router: Router, known: np.ndarray, asked: np.ndarray, target: float, top: int = TOP) -> int:
    """Fewest parts that hold `target` of the nearest `top` among `known` for the rows `asked`."""
    parts = len(router.b2)
    if not len(asked) or len(known) <= top:
        return parts
    near = np.argpartition(-(asked @ known.T), top - 1, axis=1)[:, :top]
    home = router.order(known, 1)[:, 0]
    rank = np.argsort(router.order(asked, parts), axis=1)
    share = np.cumsum(np.bincount(np.take_along_axis(rank, home[near], axis=1).ravel(), minlength=parts)) / near.size
    return int(np.searchsorted(share, target, "left")) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(queries: pa.Table, candidates: pa.Table, top: int) -> pa.Table:
    """The nearest `top` of these candidates for each query, ties to the smaller id. Scores that decide are summed
    in one order for all rows, so equal vectors score alike."""
    ids, vectors = candidates["vec_id"].to_numpy(), _matrix(candidates["v"])
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    out: list[list] = [[], [], []]
    asked, wanted = queries["vec_id"].to_numpy(), _matrix(queries["v"])
    for at in range(0, len(asked), 128):
        rough = wanted[at: at + 128] @ vectors.T
        for q, own, row in zip(asked[at: at + 128], wanted[at: at + 128], rough, strict=True):
            row[ids == q] = -np.inf
            count = min(top, int(np.count_nonzero(row > -np.inf)))
            if not count:
                continue
            last = np.partition(row, len(row) - count)[len(row) - count]
            near = np.flatnonzero(row >= last - 1e-9 * (abs(last) + 1e-300) - 1e-12 * np.abs(own).sum() * abs(vectors).max())
            score = (vectors[near] * own).sum(axis=1)
            first = np.lexsort((ids[near], -score))[:count]
            out[0].append(np.full(count, q))
            out[1].append(ids[near][first])
            out[2].append(score[first])
    return pa.table({"query_id": pa.array(np.concatenate(out[0]) if out[0] else [], pa.int64()),
                     "vec_id": pa.array(np.concatenate(out[1]) if out[1] else [], pa.int64()),
                     "score": pa.array(np.concatenate(out[2]) if out[2] else [], pa.float64())})


def search(vectors: DataFrame, queries: Column, id_column: str = "vec_id", vector_column: str = "embedding",
           top: int = TOP, recall: float = TARGET_RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` largest inner products found for each row that meets `queries`.

    Rows of an unusable vector or another dimension than most of the sample take no part; a null id neither. Rows
    of one id are not each other's neighbours; equal vectors under other ids are. A query that finds fewer than
    `top` in its parts searches all the rest. An empty table gives no rows. Parts of any size are dealt to tasks in
    chunks of candidates and queries; only the sample and one count per part reach the driver.
    """
    spark = vectors.sparkSession
    own = vectors.where(usable(vector_column) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"), queries.alias("asked"))
    order = F.xxhash64(F.lit("sample"), "vec_id")
    sample = [r.v for r in own.orderBy(order, "vec_id").limit(sample_rows).select("v").collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    sizes = np.bincount([len(v) for v in sample])
    dim = int(sizes.argmax())
    rows = np.array([v for v in sample if len(v) == dim], np.float64)
    held = min(HELD_OUT, len(rows) // 8)
    router = fit_router(rows[held:])
    parts = len(router.b2)
    probes = min(parts, probes_needed(router, rows[held:], rows[:held], recall, top))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = router.order(_matrix(batch.column(1)), parts) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found.astype(np.int32)), pa.list_(pa.int32()))],
                                             ["vec_id", "v", "asked", "parts"])

    kind = own.schema["v"].dataType.simpleString()
    filed = stored(own.where(F.size("v") == dim).mapInArrow(
        file, f"vec_id long, v {kind}, asked boolean, parts array<int>"), "filed")
    filed = filed.withColumn("part", F.get("parts", F.lit(0)))

    def meet(asked: DataFrame) -> DataFrame:
        """Queries with an array `look` of parts, against all vectors filed there."""
        looks = asked.withColumn("part", F.explode("look"))
        counts = filed.groupBy("part").agg(F.count("*").alias("n")).join(
            looks.groupBy("part").agg(F.count("*").alias("q")), "part").select(
            "part", F.ceil(F.col("n") / TASK_CANDIDATES).cast("int").alias("cs"),
            F.ceil(F.col("q") / TASK_QUERIES).cast("int").alias("qs"))
        chunks = F.broadcast(spark.createDataFrame(counts.collect(), "part int, cs int, qs int"))   # one row per part
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.col(n).cast("long")).cast("int")
        left = looks.select("vec_id", "v", "part").join(chunks, "part").withColumn("c", every("cs")).withColumn("q", mine("qs"))
        right = filed.select("vec_id", "v", "part").join(chunks, "part").withColumn("q", every("qs")).withColumn("c", mine("cs"))
        keys = ("part", "c", "q")
        # both sides come from one table, so their columns need identities of their own
        fresh = lambda side: side.select(*[F.col(c).alias(c) for c in (*keys, "vec_id", "v")]).toDF(
            *keys, "vec_id", "v")
        return fresh(left).groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInArrow(
            lambda a, b: _best(a, b, top), "query_id long, vec_id long, score double")

    asked = filed.where("asked")
    found = stored(meet(asked.withColumn("look", F.slice("parts", 1, probes))), "found")
    if probes < parts:
        full = found.groupBy("query_id").count().where(F.col("count") >= top).select(F.col("query_id").alias("vec_id"))
        short = stored(asked.join(full, "vec_id", "left_anti"), "short")
        if not short.isEmpty():
            found = found.unionAll(meet(short.withColumn("look", F.slice("parts", probes + 1, parts))))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")
