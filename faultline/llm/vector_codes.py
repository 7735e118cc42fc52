"""Vector code compression: product codebooks by exact integer Lloyd rounds with Drake-Hamerly adaptive bounds.

Each vector is cut into parts; every part keeps, from round to round, its b closest entries in order with a lower bound of
the distance to each, and one outer bound of the distance to all others. When entries move, bounds shrink by their moves. A
part whose own entry is certainly nearer than the next bound keeps it unseen; otherwise only the entries up to the first
bound that is certainly farther are measured, or all of them if the outer bound is reached. Distances that decide are
whole numbers, so the codes are those of the plain method. b falls to what nearly all parts needed in the round before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import record_batches
from faultline.llm.whitening import main_size, usable, whole_numbers
from faultline.operators.sizes import broadcast_if_small
from faultline.sources.scratch import delete_folder, new_folder, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, which one task has in memory at a time.
BLOCK_ROWS = 2048
#: Bounds kept by part at first and at least; and the share of parts whose need decides how many are kept on.
MOST_KEPT, LEAST_KEPT, COVERED = 32, 2, 0.95
#: Sums of labels that are sent to all tasks, at most.
BROADCAST_BYTES = 64 << 20
_LONG = 2 ** 63 - 1
_UP, _DOWN = 1 + 1e-6, 1 - 1e-6


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries, as whole numbers: in doubles where all sums stay below 2^53, which
    are exact then, else in integers of any length."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 0)
    if 0 <= reach < 2 ** 26 and 4 * x.shape[1] * reach * reach < 2 ** 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), object)
    for j, e in enumerate(entries.astype(object)):
        gap = x.astype(object) - e
        out[:, j] = (gap * gap).sum(axis=1)
    return out


def squared_pairs(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the entries beside it: (n, w) and (n, m, w) to (n, m)."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 0)
    if not (0 <= reach < 2 ** 26 and 4 * x.shape[1] * reach * reach < 2 ** 53):
        x, entries = x.astype(object), entries.astype(object)
    gap = entries - x[:, None, :]
    return (gap * gap).sum(axis=2)


def _root(square: np.ndarray, slack: float) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * slack


@dataclass
class Bounds:
    """The closest entries of each row in order, lower bounds of their distances, and one of all others."""

    near: np.ndarray                         # (n, b) uint16
    low: np.ndarray                          # (n, b) float32, rising
    outer: np.ndarray                        # (n,) float32

    def moved(self, by: np.ndarray) -> Bounds:
        """After the entries moved: each bound less its entry's move, the outer one less the largest; rising again."""
        low = self.low.astype(np.float64) * _DOWN - by[self.near] * _UP
        outer = self.outer.astype(np.float64) * _DOWN - by.max(initial=0) * _UP
        low = np.minimum.accumulate(np.concatenate([low, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        return Bounds(self.near, low[:, :-1], outer)

    def kept(self, b: int) -> Bounds:
        """The first b; the next bound holds for all that are left out."""
        if b >= self.near.shape[1]:
            return self
        return Bounds(self.near[:, :b], self.low[:, :b], np.minimum(self.low[:, b], self.outer))


def search_all(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """(the b closest of all entries, the squared distance to the closest); ties go to the smaller number."""
    square = squared(x, entries)
    order = np.argsort(square, axis=1, kind="stable")
    b = min(b, len(entries))
    ranked = np.take_along_axis(square, order[:, : b + 1], axis=1)
    low = _root(ranked, _DOWN)
    outer = low[:, b] if len(entries) > b else np.full(len(x), np.inf)
    return Bounds(order[:, :b].astype(np.uint16), low[:, :b], outer), ranked[:, 0]


def assign(x: np.ndarray, entries: np.ndarray, old: Bounds | None, b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """(bounds whose first entry is the nearest one, its squared distance, bounds that were needed)."""
    if old is None:
        new, best = search_all(x, entries, b)
        return new, best, np.zeros(len(x), np.int64)
    best = squared_pairs(x, entries[old.near[:, :1]])[:, 0]
    own = _root(best, _UP)
    # the first bound belongs to the own entry, whose distance is known now
    need = 1 + (old.low[:, 1:] <= own[:, None]).sum(axis=1)
    everything = old.outer <= own
    near, low, outer = old.near.copy(), old.low.copy(), old.outer.copy()
    low[:, 0] = _root(best, _DOWN)
    for width in sorted({int(w) for w in np.unique(need[~everything]) if w > 1}):
        rows = np.flatnonzero((need == width) & ~everything)
        tried = near[rows, :width]
        square = squared_pairs(x[rows], entries[tried])
        by_number = np.argsort(tried, axis=1)
        order = np.take_along_axis(by_number, np.argsort(np.take_along_axis(square, by_number, 1), axis=1, kind="stable"), 1)
        square = np.take_along_axis(square, order, axis=1)
        near[rows, :width], best[rows] = np.take_along_axis(tried, order, axis=1), square[:, 0]
        low[rows, :width] = _root(square, _DOWN)
    rows = np.flatnonzero(everything)
    if len(rows):
        new, best[rows] = search_all(x[rows], entries, near.shape[1])
        near[rows], low[rows], outer[rows] = new.near, new.low, new.outer
    # a measured entry may lie beyond the next bound: bounds rise again
    low = np.minimum.accumulate(np.concatenate([low, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :-1]
    return Bounds(near, low, outer), best, np.where(everything, near.shape[1] + 1, need)


# --- blocks and rounds --------------------------------------------------------------------------------------------
def _blocks(rows: DataFrame, dim: int, width: int) -> DataFrame:
    """Rows in blocks: (rows, x); the last part is filled up with zeros."""
    kept = rows.schema["row"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.zeros((batch.num_rows, PARTS * width), np.int64)
            x[:, :dim] = flat.reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)),
                                              pa.array([x.tobytes()], pa.binary())], ["rows", "x"])

    with record_batches(rows.sparkSession, BLOCK_ROWS):
        return stored(rows.select("row", "x").mapInArrow(pack, f"rows array<{kept}>, x binary"), "vectors")


def _low32(a: np.ndarray) -> bytes:
    """As 32-bit floats, rounded down."""
    return np.nextafter(a.astype(np.float32), np.float32(-np.inf)).tobytes()


def _round(blocks: DataFrame, codebooks: np.ndarray, moves: np.ndarray | None, b: int, width: int) -> DataFrame:
    """Every block with each part's bounds and squared distance, and how many parts needed how many bounds."""
    kind = blocks.schema["rows"].dataType.simpleString()
    names = ("near", "low", "outer", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i] for name in batch.schema.names}
                x = np.frombuffer(cell["x"].as_py(), np.int64).reshape(-1, PARTS * width)
                out: dict[str, list[bytes]] = {k: [] for k in names}
                needs = np.zeros(MOST_KEPT + 2, np.int64)
                for p in range(PARTS):
                    old = None
                    if moves is not None:
                        near, low, outer = (np.frombuffer(cell[k][p].as_py(), t) for k, t in zip(
                            names, (np.uint16, np.float32, np.float32), strict=False))
                        old = Bounds(near.reshape(len(x), -1), low.reshape(len(x), -1), outer).kept(b).moved(moves[p])
                    new, best, need = assign(x[:, p * width: (p + 1) * width], codebooks[p], old, b)
                    needs += np.bincount(need, minlength=MOST_KEPT + 2)
                    out["near"].append(new.near.astype(np.uint16).tobytes())
                    out["low"].append(_low32(new.low))
                    out["outer"].append(_low32(new.outer))
                    out["best"].append(np.minimum(best, _LONG).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column("rows").slice(i, 1), batch.column("x").slice(i, 1),
                    *[pa.array([v], pa.list_(pa.binary())) for v in out.values()],
                    pa.array([needs.tolist()], pa.list_(pa.int64()))], ["rows", "x", *out, "needs"])

    return blocks.mapInArrow(run, f"rows {kind}, x binary, {', '.join(f'{k} array<binary>' for k in names)}, needs array<long>")


def _sums(state: DataFrame, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(exact sums by part, entry and place, parts by part and entry). Each task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.int64).reshape(-1, PARTS * width)
                reach = max(int(x.max(initial=0)), -int(x.min(initial=0)))
                own = np.zeros((PARTS, entries, width + 1), np.int64 if reach < 1 << 32 else object)
                for p in range(PARTS):
                    nearest = np.frombuffer(near[p], np.uint16).reshape(len(x), -1)[:, 0]
                    order = np.argsort(nearest, kind="stable")
                    which, first = np.unique(nearest[order], return_index=True)
                    part = x[order, p * width: (p + 1) * width].astype(own.dtype)
                    own[p, which, :width] = np.add.reduceat(part, first, axis=0)
                    own[p, which, width] = np.diff(np.append(first, len(x)))
                total = own if total is None else total + own
        if total is not None:
            part, entry = np.nonzero(total[:, :, width] > 0)
            sums = [[Decimal(int(v)) for v in row] for row in total[part, entry]]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)),
                                              pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "sums"])

    rows = state.select("x", "near").mapInArrow(run, "part int, entry int, sums array<decimal(38,0)>")
    totals = rows.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width + 1)]).collect()
    sums, counts = np.zeros((PARTS, entries, width), object), np.zeros((PARTS, entries), np.int64)
    for r in totals:
        sums[r.part, r.entry] = [int(v) for v in r[2:-1]]
        counts[r.part, r.entry] = int(r[-1])
    return sums, counts


def _next_kept(state: DataFrame, b: int) -> int:
    """The fewest bounds that were enough for COVERED of the parts; never more than now."""
    rows = state.select(F.posexplode("needs").alias("need", "n")).groupBy("need").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(MOST_KEPT + 2)
    for r in rows:
        count[r.need] = r.n
    enough = int(np.searchsorted(np.cumsum(count), COVERED * count.sum()))
    return max(LEAST_KEPT, min(b, enough))


@dataclass
class Codes:
    """What `compress` gives: a row (row, code, error) for each kept row, the codebooks, and the bounds kept by round."""

    rows: DataFrame
    codebooks: np.ndarray
    kept: list[int]


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codes of all rows: `row` holds the columns but the vector, `code` one entry number (int) by part, `error` the sum of
    the parts' squared distances (the largest long, if more).

    Vectors that are null or hold null or non-finite components are dropped, as are those of another size than most. A size
    that is no multiple of PARTS is filled up with zeros. Whole numbers beyond a long become the nearest long. Fewer rows
    than entries give smaller codebooks; equal vectors get equal codes; of rows with one id the smaller vector comes first
    in the codebook, null ids last. None for a table without vectors.
    """
    spark = vectors.sparkSession
    others = [F.col(f"`{c}`").alias(c) for c in vectors.columns if c != vector_column]
    rows = vectors.where(usable(vector_column)).select(F.struct(*others).alias("row"), whole_numbers(vector_column, scale).alias("x"))
    dim = main_size(rows, "x")
    if dim <= 0:
        return None
    rows = rows.where(F.size("x") == dim)
    width = -(-dim // PARTS)
    first = rows.orderBy(F.col(f"row.`{id_column}`").asc_nulls_last(), "x").limit(entries).select("x").collect()
    codebooks = np.zeros((PARTS, len(first), width), np.int64)
    start = np.zeros((len(first), PARTS * width), np.int64)
    start[:, :dim] = [r.x for r in first]
    for p in range(PARTS):
        codebooks[p] = start[:, p * width: (p + 1) * width]
    blocks = _blocks(rows, dim, width)
    b, moves, kept, before = MOST_KEPT, None, [], None
    state = blocks
    for step in range(rounds + 1):
        folder = new_folder(spark, "bounds")
        ahead = _round(state, codebooks, moves, b, width)
        ahead.write.parquet(folder)
        state = spark.read.schema(ahead.schema).parquet(folder)
        if before:
            delete_folder(spark, before)                     # the new bounds stand; nothing reads the old ones again
        before = folder
        kept.append(b)
        if step == rounds:
            break
        sums, counts = _sums(state, len(first), width)
        new = codebooks.copy()
        for p, e in zip(*np.nonzero(counts), strict=True):
            new[p, e] = [int(v) // int(counts[p, e]) for v in sums[p, e]]
        gap = new.astype(object) - codebooks.astype(object)
        moves = np.sqrt((gap * gap).sum(axis=2).astype(np.float64)) * _UP
        codebooks = new
        if step:
            b = _next_kept(state, b)
    kind = blocks.schema["rows"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                near, best = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                error = sum(np.frombuffer(v, np.int64).astype(object) for v in best)
                n = len(error)
                code = np.stack([np.frombuffer(v, np.uint16).reshape(n, -1)[:, 0] for v in near], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1).flatten(), pa.array(list(code), pa.list_(pa.int32())),
                    pa.array([min(int(v), _LONG) for v in error], pa.int64())], ["row", "code", "error"])

    done = state.select("rows", "near", "best").mapInArrow(unpack, f"row {kind}, code array<int>, error long")
    return Codes(done, codebooks, kept)


def digest(codebooks: np.ndarray) -> str:
    """Of all entries' components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for v in codebooks.ravel().tolist()).encode()).hexdigest()


def with_label_errors(rows: DataFrame, label_column: str) -> DataFrame:
    """`rows` with `label_error`, the errors summed over rows of the same label, nulls together; null beyond a long.

    Sums are made before anything is joined; the join reads one row for each label and splits a hot one.
    """
    rows = stored(rows.withColumn("_label", F.col(f"row.`{label_column}`")), "codes")
    sums = rows.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select(
        F.col("_label").alias("_l"), F.expr("try_cast(s AS bigint)").alias("label_error"))
    sums = broadcast_if_small(sums, BROADCAST_BYTES)
    return rows.join(sums, rows["_label"].eqNullSafe(sums["_l"])).drop("_label", "_l")
