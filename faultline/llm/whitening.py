"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows are A, n by d. From a unit vector v1 each step takes u_k from A v_k and the next v from Aᵀ u_k, so that in the
bases of the u and the v the matrix A is upper bidiagonal; the singular values and right vectors of that small matrix give
the deviations and components of A. Both bases are orthogonalised against all earlier vectors in every step.
A u vector is as long as the table and is not kept: it is always the image A p of a short vector p, and one scan of the
rows gives A q, its inner products with all earlier u, and Aᵀ (A q). What a step gathers is d + k + 1 sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.sources.scratch import stored

SCALE = 256
COMPONENTS = 4
#: Rows of a stored block.
BLOCK_ROWS = 2048
#: A triplet stands when what the other side leaves of it is this small a part of the largest singular value.
EXACT = 4 * np.finfo(float).eps
_SMALL = 1 << 31


def usable(vector: str) -> Column:
    """Vectors that are not null and hold finite entries only."""
    v = F.col(f"`{vector}`")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def whole_numbers(vector: str, scale: int) -> Column:
    """floor(scale * entry) of all entries; what a long cannot hold becomes the nearest long."""
    return F.transform(F.col(f"`{vector}`"), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column as int64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def main_size(vectors: DataFrame, column: str) -> int:
    """The most frequent number of entries, the larger of two alike; 0 for an empty table."""
    sizes = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return sizes.d if sizes else 0


# --- what the scans of the rows give ------------------------------------------------------------------------------
def _blocks(distinct: DataFrame, dim: int) -> DataFrame:
    """Distinct vectors as stored blocks of int64."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dim)
            cut = [x[i: i + BLOCK_ROWS].tobytes() for i in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["x"])

    return stored(distinct.mapInArrow(pack, "x binary"), "vectors")


def _summed(blocks: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what `work` makes of one; each task adds up its own before anything is sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(0):
                own = work(np.frombuffer(cell.as_py(), np.int64).reshape(-1, dim))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    rows = blocks.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    sums = {r.i: r.s for r in rows.groupBy("i").agg(F.sum("v").alias("s")).collect()}
    return np.array([sums[i] for i in range(len(sums))])


def _column_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sums by dimension)."""
    one = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count("*").alias("n")).collect()
    sums = {r.i: int(r.s) for r in one}
    return (one[0].n if one else 0), [sums[i] for i in range(len(sums))]


def _against(basis: list[np.ndarray], v: np.ndarray) -> np.ndarray:
    """What is left of v once its parts along the basis are gone; twice, so that rounding leaves none."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


Scan = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]]
"""(q, earlier p as columns) -> (Aᵀ A q, earlier uᵀ A q, |A q|²)."""


def bidiagonalise(scan: Scan, dim: int, wanted: int, known: list[np.ndarray], seed: int = 11) -> tuple[
        np.ndarray, np.ndarray, bool]:
    """(singular values, right vectors as rows, whether all directions were seen) of A on what is orthogonal to `known`.

    Ends when the `wanted` largest triplets leave nothing, or all directions are used. Where the bidiagonal matrix falls
    apart, the next v is a fresh random direction.
    """
    rng = np.random.default_rng(seed)
    fresh = lambda: _against(known + vs, rng.standard_normal(dim))
    vs: list[np.ndarray] = []
    ps: list[np.ndarray] = []
    back: list[np.ndarray] = []                              # Aᵀ u of every step
    alphas: list[float] = []
    betas: list[float] = []                                  # betas[k] ties step k to step k + 1
    size = 0.0
    v = fresh()
    v = v / np.linalg.norm(v)
    while True:
        q = v - (betas[-1] * ps[-1] if ps else 0)            # A q = A v_k - beta u_(k-1)
        held = np.array(ps).T if ps else np.zeros((dim, 0))
        z, along, square = scan(q, held)
        if ps:                                               # the parts along earlier u go, in all three
            q, z = q - held @ along, z - np.array(back).T @ along
            square -= along @ along
        alpha = float(np.sqrt(max(square, 0.0)))
        size = max(size, alpha)
        vs.append(v)
        if alpha <= EXACT * size or not size:
            alpha = 0.0
            ps.append(np.zeros(dim))
            back.append(np.zeros(dim))
        else:
            ps.append(q / alpha)
            back.append(z / alpha)
        alphas.append(alpha)
        b = np.diag(alphas) + np.diag(betas, 1)
        if len(vs) + len(known) == dim:
            _, s, right = np.linalg.svd(b)
            return s, right @ np.array(vs), True
        nxt = _against(known + vs, back[-1])
        beta = float(np.linalg.norm(nxt))
        left, s, right = np.linalg.svd(b)
        if len(s) >= wanted and beta and s[0] and np.all(beta * np.abs(left[-1, :wanted]) <= EXACT * s[0]):
            return s, right @ np.array(vs), False
        if beta <= EXACT * size:
            beta, nxt = 0.0, fresh()
        betas.append(beta)
        v = nxt / np.linalg.norm(nxt)


def leading(scan: Scan, dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest singular values, falling, and their right vectors as rows.

    One start sees one direction of each singular value only. Unless all directions were seen, further starts look
    for a larger value among what is orthogonal to all found, until there is none.
    """
    wanted = min(wanted, dim)
    values, rows, complete = bidiagonalise(scan, dim, wanted, [])
    values, rows = values[:wanted], rows[:wanted]
    start = 12
    while not complete and len(rows) < dim:
        more, along, _ = bidiagonalise(scan, dim, 1, list(rows), start)
        if more[0] <= values[wanted - 1] * (1 + 1e-12):
            break
        values, rows, start = np.append(values, more[0]), np.vstack([rows, along[:1]]), start + 1
        order = np.argsort(-values, kind="stable")
        values, rows = values[order], rows[order]
    return values[:wanted], rows[:wanted]


# --- the operator -------------------------------------------------------------------------------------------------
@dataclass
class Whitening:
    """What was learned: rows n and sums S of the fit list, components by falling variance, and the check of it."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None
    mean: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.mean = np.array([s / max(self.n, 1) for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)², exact."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if reach < _SMALL and reach * reach * x.shape[1] < 2 ** 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        wide = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(v) for v in (wide * wide).sum(axis=1)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; null (nan) along a component without variance."""
        scale = np.where(self.variances > 0, np.sqrt(np.maximum(self.variances, 0)), np.nan)
        # one order of summing for all rows, so that equal vectors come out equal
        parts = [((x - self.mean) * c).sum(axis=1) / s for c, s in zip(self.components, scale, strict=True)]
        return np.stack(parts, axis=1) if parts else np.zeros((len(x), 0))


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Learns from the distinct vectors of `rows` (column x)."""
    distinct = stored(rows.select("x").distinct(), "distinct")
    n, sums = _column_sums(distinct)
    blocks = _blocks(distinct, dim)
    out = Whitening(n, sums, np.zeros((0, dim)), np.zeros(0), 0.0, None)
    mean = out.mean

    def scan(q: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def work(x: np.ndarray) -> np.ndarray:
            a = x - mean
            w = a @ q
            return np.concatenate([w @ a, (a @ held).T @ w, [w @ w]])

        got = _summed(blocks, dim, work)
        return got[:dim], got[dim:-1], float(got[-1])

    total = float(_summed(blocks, dim, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    values, rows_ = leading(scan, dim, components)
    out.components, out.trace = rows_, total
    out.variances = np.where(values ** 2 / n > dim * EXACT * total, values ** 2 / n, 0.0)
    held = np.flatnonzero(out.variances > 0)
    if len(held):
        def products(x: np.ndarray) -> np.ndarray:
            w = out.whitened(x)[:, held]
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        got = _summed(blocks, dim, products) / n
        means, square = got[: len(held)], got[len(held):].reshape(len(held), -1)
        out.identity_error = float(np.abs(square - np.outer(means, means) - np.eye(len(held))).max())
    return out


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Vectors that are null or hold null or non-finite entries take no part, nor do those of another number of entries than
    most; fewer entries than components give as many components. Rows alike count once in the fit and each get their
    rows; null and repeated ids are passed on; other columns are not read; an empty table gives no rows. Along a component
    without variance `whitened` is null, `explained` 0 (null where nothing varies), and `identity_error` leaves it out.
    `deviation` is decimal(38,0), null beyond that.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = (f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    rows = stored(vectors.where(usable(vector_column)).select(
        F.col(f"`{id_column}`").alias("id"), whole_numbers(vector_column, scale).alias("x")), "whole")
    dim = main_size(rows, "x")
    if not dim:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    rows = rows.where(F.size("x") == dim)
    model = fit(rows, dim, components)
    count = len(model.components)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.variances]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            flat = model.whitened(x).ravel()
            each = np.repeat(np.arange(len(x)), count)
            deviations = [Decimal(v) if v < 10 ** 38 else None for v in model.deviations(x)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n)), pa.array(deviations, pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(explained * len(x), pa.float64()),
                pa.array([model.identity_error] * len(each), pa.float64())],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
