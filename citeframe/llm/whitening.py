"""Whitening of embeddings by a block subspace iteration that never forms the covariance.

Vectors are scaled to integers; every distinct one counts once.  A pass of Spark over the centred rows gives V Q for a
block Q of orthonormal columns, V being the covariance; QR and Rayleigh-Ritz on the block, a matrix of dimensions by
columns, give the next one.  Passes go on until the residuals |V u - e u| of all components that are asked for are
certified to be rounding noise.  Where a pass gains little, as with eigenvalues that lie close together, the block is
widened by its own residuals, up to all dimensions, where one pass suffices.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.llm.common import discard, grown, prepare, refuse, shared_folder

#: Residuals of so small a part of the largest eigenvalue are noise, and so are eigenvalues.
RESIDUAL = 1e-12
NULL = 1e-11
#: Scaled entries are held within this, where doubles are exact.
EDGE = float(1 << 53)
_LOW = (1 << 32) - 1


@dataclass
class Model:
    """n distinct vectors, their sums by dimension, and the components: columns of unit length by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions by components
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int


def scaled(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """Each entry as a whole number; entries beyond 2^53 once scaled are held there."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(EDGE)), F.lit(-EDGE))).cast("bigint") + shift)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, has entries, and holds no null, NaN or infinity."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they suffice, Python's otherwise."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def deviations(apart: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null beyond 64 bits."""
    if apart.dtype != object and apart.size and float(np.abs(apart).max()) ** 2 * apart.shape[1] < 2.0**62:
        return (apart * apart).sum(axis=1).tolist()
    wide = [sum(int(c) ** 2 for c in row) for row in apart]
    return [w if w < 1 << 63 else None for w in wide]


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all rows of a matrix that `part` makes of some of them; each task sends one, and its rows are summed apart, in the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(_matrix(batch, d))
                total = got if total is None else total + got
        if total is not None:
            of = np.full(len(total), TaskContext.get().partitionId(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(of), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "task", "row"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        width = len(table.column("row")[0])
        sums = table.column("row").combine_chunks().flatten().to_numpy().reshape(-1, width).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([sums], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "i bigint, task bigint, row array<double>")
    got = sorted(parts.groupBy("i").applyInArrow(add, "i bigint, row array<double>").collect())  # as large as the block
    return np.array([r.row for r in got])


def _moments(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each dimension; halves of the numbers are summed apart, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            halves = [(x >> 32).sum(axis=0), (x & _LOW).sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), *[pa.array(h) for h in halves], pa.array(np.full(d, len(x)))], names=["i", "high", "low", "n"])

    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low", "n")]
    got = rows.mapInArrow(run, "i bigint, high bigint, low bigint, n bigint").groupBy("i").agg(*exact).orderBy("i").collect()  # one row for each dimension
    return int(got[0].n), [(int(r.high) << 32) + int(r.low) for r in got]


def _orthonormal(block: np.ndarray) -> np.ndarray:
    """An orthonormal basis; the second QR mends what the first one loses on columns that nearly agree."""
    return np.linalg.qr(np.linalg.qr(block)[0])[0]


def subspace(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, *, block: int | None = None, seed: int = 13, most: int = 500) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The first k eigenvectors and eigenvalues of a symmetric matrix known by its product with a block, the largest residual, and the passes taken."""
    q = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, block or 2 * k))))
    last = np.inf
    for passes in range(1, most + 1):
        y = product(q)
        h = q.T @ y
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        z, vz = q @ u, y @ u
        rest = vz - z * values
        sizes = np.linalg.norm(rest, axis=0)
        worst = float(sizes[:k].max())
        if worst <= RESIDUAL * max(values[0], 0) or values[0] <= 0:
            return z[:, :k], values[:k], worst, passes
        if worst > last / 8 and q.shape[1] < d:
            q = _orthonormal(np.concatenate([z, rest / np.maximum(sizes, np.finfo(float).tiny)], axis=1))
        else:
            q = _orthonormal(vz if q.shape[1] < d else z)
        last = worst
    raise ArithmeticError(f"residual {worst} after {most} passes")


def fit(rows: DataFrame, k: int = 16) -> Model | None:
    """The components of rows (x array<bigint>), all of one length, each distinct x once; None without rows.

    Components whose eigenvalue is noise (fewer distinct vectors than dimensions, dimensions that don't vary) are
    left out.  The distinct vectors are a table in the shared folder while this lasts.
    """
    spark = rows.sparkSession
    prepare(spark)
    path = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(path)
    try:
        fitted = spark.read.parquet(path)
        first = fitted.select(F.size("x").alias("d")).first()
        if first is None:
            return None
        d = first.d
        n, sums = _moments(fitted, d)
        k = min(k, d)

        def product(q: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray) -> np.ndarray:
                c = centred(x, n, sums).astype(np.float64) / n
                return c.T @ (c @ q)

            return _summed(fitted, part, d) / n

        vectors, values, residual, passes = subspace(product, d, k)

        def squares(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums).astype(np.float64) / n
            return np.array([[(c * c).sum()]])

        trace = float(_summed(fitted, squares, d)[0, 0]) / n
        good = values > NULL * max(values[0], 0)
        vectors, values = vectors[:, good], values[good]
        error = 0.0
        if len(values):
            w = vectors / np.sqrt(values)

            def covariance(x: np.ndarray) -> np.ndarray:
                c = (centred(x, n, sums).astype(np.float64) / n) @ w
                return c.T @ c

            error = float(np.abs(_summed(fitted, covariance, d) / n - np.eye(len(values))).max())
        return Model(n, sums, vectors, values, trace, error, residual, passes)
    finally:
        discard(spark, path)


def whiten(vectors: DataFrame, k: int = 16, *, vector: str = "embedding", columns: tuple[str, ...] = ("vec_id",), scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """`columns`, component (from 1), n, deviation, whitened, explained and identity_error of each usable row and component.

    Vectors that are null, empty, or hold a null, NaN or infinity take no part; neither do those of another length than
    most have (of equally many, the longer).  Repeated rows give their results each, the fit counts equal vectors
    once.  deviation is exact, or null beyond 64 bits.  No usable row, or none that differs, gives no rows.
    """
    made = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    refuse(columns, [*[c.split()[0] for c in made.split(", ")], "x"])
    spark = vectors.sparkSession
    kept = usable(vectors, vector).select(*[F.col(f"`{c}`") for c in columns], scaled(F.col(vector), scale, shift).alias("x"))
    length = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = grown(vectors, list(columns), made)
    if length is None:
        return spark.createDataFrame([], schema)
    kept = kept.filter(F.size("x") == length.d)
    model = fit(kept, k)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    n, sums, error, count = model.n, model.sums, model.identity_error, len(model.values)
    w, share = model.vectors / np.sqrt(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                apart = centred(_matrix(part, length.d), n, sums)
                rows = part.num_rows
                who = pa.array(np.repeat(np.arange(rows), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c).take(who) for c in columns], pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)), pa.array(np.full(rows * count, n)),
                        pa.array(deviations(apart), pa.int64()).take(who), pa.array(((apart.astype(np.float64) / n) @ w).reshape(-1)), pa.array(np.tile(share, rows)), pa.array(np.full(rows * count, error)),
                    ],
                    names=schema.names,
                )

    return kept.mapInArrow(run, schema)
