"""Embedding whitening by matrix-free block Lanczos.

Vectors are put on an integer grid, and each distinct grid vector counts once. With
their number n and their sums S, the deviation n * x - S of a grid vector x is an
exact integer; the covariance V is never formed. A block of directions goes to every
task, which multiplies its centred rows by it and by their transpose; Spark adds the
partial products, so one pass gives V times the block. The driver holds only the
Krylov basis, a few dozen vectors as wide as the embedding.

The basis is kept orthonormal by reorthogonalising every new block against all of it,
twice. Directions of a block that vanish (a breakdown) are restarted with random ones
orthogonal to the basis. A basis at its largest size is restarted with its best Ritz
vectors and the block that was to come next. The iteration ends when the residual of
every wanted pair is at rounding level, or the basis spans the whole space. The trace
of V comes from the squared deviations, so shares need no further eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm.storage import Workspace
from docscore.llm.vectors import rows_of, slices, usable, width_of

GRID = 64
OFFSET = 1_000_000
LARGEST = float(1 << 56)
COMPONENTS = 16
EXTRA = 8
BASIS_BLOCKS = 12
TOLERANCE = 1e-13
PASSES = 1000
LEAST_SHARE = 1e-11
EXACT = 1 << 62
DIGITS = 10**38


def grid(vector: Column) -> Column:
    """``floor(64 * c) + 1000000`` of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c * GRID) + F.lit(OFFSET).cast("long"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs where they hold it, else in Python integers."""
    fits = n * int(np.abs(x).max(initial=0)) < EXACT and max(map(abs, sums), default=0) < EXACT
    kind = np.int64 if fits else object
    return x.astype(kind) * n - np.array(sums, kind)


def squared(apart: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    most = int(np.abs(apart).max(initial=0))
    if most * most * max(1, apart.shape[1]) >= EXACT:
        apart = apart.astype(object)
    return (apart * apart).sum(axis=1).tolist()


def orthonormal(block: np.ndarray, basis: np.ndarray, size: float, rng: np.random.Generator) -> np.ndarray:
    """Unit columns orthogonal to the basis and each other that span what ``block`` adds to it.

    Directions below the rounding level of ``size`` are replaced by random ones; there
    are no more columns than the space has room for.
    """
    room = min(block.shape[1], basis.shape[0] - basis.shape[1])
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, found, _ = np.linalg.svd(block, full_matrices=False)
    fresh = left[:, found > 64 * np.finfo(float).eps * size][:, :room]
    while fresh.shape[1] < room:  # breakdown
        fresh = np.hstack([fresh, rng.standard_normal((basis.shape[0], room - fresh.shape[1]))])
        fresh = fresh - basis @ (basis.T @ fresh)
        fresh = np.linalg.qr(fresh)[0]
    for _ in range(2):
        fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]
    return fresh


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], width: int, count: int, extra: int = EXTRA, blocks: int = BASIS_BLOCKS, tolerance: float = TOLERANCE, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    ``multiply`` applies a symmetric matrix without negative eigenvalues to a block of
    ``count + extra`` columns. At most ``blocks`` blocks are held. Fails if residuals are
    not at ``tolerance`` times the largest eigenvalue after ``PASSES`` passes.
    """
    rng = np.random.default_rng(seed)
    count = min(count, width)
    step = min(count + extra, width)
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    block = orthonormal(rng.standard_normal((width, step)), basis, 0.0, rng)
    for _ in range(PASSES):
        fresh = multiply(block)
        basis, image = np.hstack([basis, block]), np.hstack([image, fresh])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, :count]
        residual = np.linalg.norm(image @ turn[:, :count] - ritz * values[:count], axis=0)
        if basis.shape[1] == width or (residual <= tolerance * values[0]).all():
            return values[:count], ritz / np.linalg.norm(ritz, axis=0)
        block = orthonormal(fresh, basis, values[0], rng)
        if basis.shape[1] + step > blocks * step:
            basis, image = basis @ turn[:, :step], image @ turn[:, :step]
    raise RuntimeError(f"no convergence in {PASSES} passes: residuals of {residual.max() / values[0]:.2g} of the largest eigenvalue")


class Fit:
    """Distinct grid vectors (column ``x``): their number, exact sums and centred products."""

    def __init__(self, x: DataFrame, width: int):
        self.x, self.width = x, width
        self.n, self.sums = self._totals()

    def _totals(self) -> tuple[int, list[int]]:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, sums = 0, [0] * width
            for batch in batches:
                for part in slices(batch, width):
                    x = rows_of(part.column(0), width)
                    fits = len(x) * int(np.abs(x).max(initial=0)) < EXACT
                    sums = [a + b for a, b in zip(sums, (x if fits else x.astype(object)).sum(axis=0).tolist(), strict=True)]
                    rows += len(x)
            values = [Decimal(v) for v in (rows, *sums)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["place", "value"])

        found = self.x.mapInArrow(run, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value"))
        total = {r["place"]: int(r["value"]) for r in found.collect()}  # one row per dimension
        return total.get(0, 0), [total.get(k + 1, 0) for k in range(width)]

    def _added(self, part: Callable[[np.ndarray], np.ndarray], height: int, columns: int) -> np.ndarray:
        """The sum of ``part(centred rows)``, a matrix of ``height`` x ``columns``, over all rows."""
        width, n, sums = self.width, self.n, self.sums
        names = [f"c{j}" for j in range(columns)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, columns))
            for batch in batches:
                for some in slices(batch, width):
                    total += part(deviations(rows_of(some.column(0), width), n, sums).astype(float) / n)
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *map(pa.array, total.T)], ["place", *names])

        each = self.x.mapInArrow(run, "place int, " + ", ".join(f"{c} double" for c in names))
        out = np.zeros((height, columns))
        for r in each.groupBy("place").agg(*(F.sum(c).alias(c) for c in names)).collect():  # height rows
            out[r["place"]] = r[1:]
        return out

    def multiply(self, block: np.ndarray) -> np.ndarray:
        """V times the block, V being the covariance with divisor n."""
        return self._added(lambda rows: rows.T @ (rows @ block), self.width, block.shape[1]) / self.n

    def trace(self) -> float:
        return float(self._added(lambda rows: np.array([[(rows * rows).sum()]]), 1, 1)[0, 0]) / self.n

    def covariance(self, turn: np.ndarray) -> np.ndarray:
        """The covariance of the rows projected on the columns of ``turn``, centred by their own mean."""
        k = turn.shape[1]
        mean = self._added(lambda rows: (rows @ turn).sum(axis=0, keepdims=True), 1, k)[0] / self.n

        def part(rows: np.ndarray) -> np.ndarray:
            apart = rows @ turn - mean
            return apart.T @ apart

        return self._added(part, k, k) / self.n


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, work: Workspace | None = None, **options) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``, a row per usable vector.

    ``whitened`` is an array over components: the centred grid vector projected on the
    eigenvector and divided by the root of its eigenvalue; ``explained`` holds each
    component's share of the variance, ``deviation`` is a decimal(38,0), null beyond
    that. Vectors that are null, empty, or hold a null or an entry that is no number
    below 2^56 give no row and take no part. Components with a share under 1e-11 are
    rounding noise and left out, so tables of low rank give shorter arrays and a table
    of one distinct vector empty ones. Ids may be null or repeated, repeated rows stay
    repeated; an empty table gives no rows; vectors of different lengths are an error.
    Other columns are never read.
    """
    work = work or Workspace(vectors.sparkSession, "whitening")
    picked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = picked.where(usable(F.col("v"), LARGEST)).select("vec_id", grid(F.col("v")).alias("x"))
    x = work.write(rows.select("x").distinct(), "x")
    width = width_of(x, "x")
    fit = Fit(x, width)
    n, sums = fit.n, fit.sums
    values, turn, trace = np.zeros(0), np.zeros((width, 0)), 0.0
    if n:
        trace = fit.trace()
    if trace > 0:
        values, turn = block_lanczos(fit.multiply, width, components, **options)
        kept = values > LEAST_SHARE * trace
        values, turn = values[kept], turn[:, kept] / np.sqrt(values[kept])
    k = len(values)
    identity_error = float(np.abs(fit.covariance(turn) - np.eye(k)).max()) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, width):
                apart = deviations(rows_of(part.column(1), width), n, sums)
                exact = [Decimal(v) if v < DIGITS else None for v in squared(apart)]
                white = (apart.astype(float) / n) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * k, pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(exact, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    shares = F.array(*(F.lit(float(v / trace)) for v in values)).cast("array<double>")
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(identity_error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``whiten`` with a row per vector and component, numbered from 1."""
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = white.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
    return each.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col.whitened").alias("whitened"), F.col("col.explained").alias("explained"), "identity_error")
