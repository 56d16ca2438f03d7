"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, each distinct vector is fitted once, and the centred rows, over the root of their number, are
the matrix X. A step takes v to u = Xv, less what earlier u hold of it, and u to Xᵀu, less what earlier v hold of it, so that Xᵀ X is never
formed. X is bidiagonal between the two bases; the singular values of that small matrix are the deviations, and its right singular
vectors, in the basis of the v, the components.

A u has as many entries as there are vectors. None is stored: it is Xw of a short w, and tasks make the earlier u again from
their rows, so both products and the sums for reorthogonalisation come from one pass. A pass sends back one row of sums from
each of at most ``PARTS`` tasks. Steps go on until the basis is whole (as many steps as dimensions); a v or u that vanishes means a subspace
without links to the rest, and the next step begins with a new direction, so equal eigenvalues are all found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from wardline.llm.frames import ready, written

SCALE, SHIFT = 64, 1_000_000
# Vectors in a block, and tasks of a pass at most.
BLOCK = 4096
PARTS = 1024
EPSILON = float(np.finfo(np.float64).eps)
LARGEST = 2**63 - 1


def usable(vectors: DataFrame, column: str = "embedding", dimension: int | None = None, name: str = "x") -> DataFrame:
    """The rows with a finite vector, which gets whole entries x = floor(64 c) + 1,000,000 under ``name``.

    Dropped are NULL vectors and those with entries that are NULL, not finite, or too large for x (2^56), and vectors of another length
    than most have (the longer of two equally frequent lengths stays), as they lie in another space.
    """
    entries = F.col(column).cast("array<double>")
    fit = F.forall(entries, lambda c: F.coalesce(F.abs(c) < F.lit(float(1 << 56)), F.lit(False)))
    rows = vectors.filter(F.coalesce((F.size(entries) > 0) & fit, F.lit(False)))
    if dimension is None:
        sizes = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dimension = sizes["d"] if sizes else 0
    return rows.filter(F.size(column) == dimension).withColumn(
        name, F.transform(entries, lambda c: F.floor(c * SCALE) + F.lit(SHIFT)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(rows: DataFrame) -> DataFrame:
    """Distinct vectors, in blocks of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary())], ["block"])

        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch.column(0)))
                if sum(map(len, held)) >= BLOCK:
                    yield out()
        if held:
            yield out()

    found = written(rows.select("x").distinct().mapInArrow(run, "block binary"), "vectors")
    return found.coalesce(PARTS).persist(StorageLevel.MEMORY_AND_DISK)


def _summed(blocks: DataFrame, dimension: int, part: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Sums over all blocks of what ``part`` makes of one; the tasks' sums are added in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        least = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                found = part(np.frombuffer(blob, "<i8").reshape(-1, dimension))
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
                least = min(least or blob[:64], blob[:64])
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([least], pa.binary()), pa.array([[t.tobytes() for t in total]], pa.list_(pa.binary())),
                 pa.array([[t.dtype.str for t in total]], pa.list_(pa.string()))], ["first", "sums", "kinds"])

    rows = blocks.mapInArrow(run, "first binary, sums array<binary>, kinds array<string>").collect()
    total = None
    for row in sorted(rows, key=lambda r: bytes(r["first"])):
        found = [np.frombuffer(bytes(b), k) for b, k in zip(row["sums"], row["kinds"], strict=True)]
        total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
    return total


@dataclass
class Whitening:
    """``components`` are rows, by falling ``eigenvalues``; the mean is floor + part / n in whole numbers."""

    n: int = 0
    dimension: int = 0
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    part: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    trace: float = 0.0
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(np.float64) - self.part / self.n

    def projected(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n x - S)^2 over dimensions, exact: in 64 bits where they hold them, else in Python's numbers."""
        y = x - self.floor
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * max(1, self.dimension) > LARGEST:
            y = y.astype(object)
        apart = self.n * y - (self.part if y.dtype != object else self.part.astype(object))
        return [int(v) for v in (apart * apart).sum(axis=1)]


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalised(
        step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], dimension: int, scale: float,
) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B, B upper bidiagonal. ``step(p, W)`` gives, for u = Xp, (Xᵀu, (XW)ᵀu, uᵀu)."""
    random = np.random.default_rng(0)
    tiny = 64 * EPSILON * scale

    def fresh() -> np.ndarray:
        while True:
            v = _orthogonal(random.standard_normal(dimension), vs)
            size = np.linalg.norm(v)
            if size > 1e-8:
                v = _orthogonal(v / size, vs)
                return v / np.linalg.norm(v)

    vs: list[np.ndarray] = []
    ws: list[np.ndarray] = []
    zs: list[np.ndarray] = []
    b = np.zeros((dimension, dimension))
    v, beta = fresh(), 0.0
    for j in range(dimension):
        vs.append(v)
        w = v - beta * ws[-1] if j and beta else v
        earlier = np.array(ws) if ws else np.zeros((0, dimension))
        z, inner, square = step(w, earlier)
        w = w - inner @ earlier
        z = z - inner @ np.array(zs) if zs else z
        alpha = float(np.sqrt(max(0.0, square - inner @ inner)))
        if alpha <= tiny:
            alpha, w, z = 0.0, np.zeros(dimension), np.zeros(dimension)
        else:
            w, z = w / alpha, z / alpha
        b[j, j] = alpha
        ws.append(w)
        zs.append(z)
        if j + 1 == dimension:
            break
        v = _orthogonal(z - alpha * v, vs)
        beta = float(np.linalg.norm(v))
        if beta <= tiny:
            beta, v = 0.0, fresh()
        else:
            v = _orthogonal(v / beta, vs)
            v /= np.linalg.norm(v)
        b[j, j + 1] = beta
    return np.array(vs).T, b


def fit(vectors: DataFrame, components: int = 16, column: str = "embedding") -> Whitening:
    """The whitening of the distinct usable vectors; components whose deviation is zero but for rounding are left out.

    Without usable vectors, or if all are equal, there are no components.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = usable(vectors, column)
    blocks = _blocks(rows)
    first = blocks.first()
    if first is None:
        blocks.unpersist()
        return Whitening()
    dimension = _dimension(rows)

    def totals(x: np.ndarray) -> list[np.ndarray]:
        # Two halves, so that sums of any number of entries are exact.
        return [np.array([len(x)]), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]

    count, high, low = _summed(blocks, dimension, totals)
    n = int(count[0])
    sums = [(int(h) << 32) + int(lo) for h, lo in zip(high, low, strict=True)]
    model = Whitening(n, dimension, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))
    root = float(np.sqrt(n))
    model.trace = float(_summed(blocks, dimension, lambda x: [np.array([np.square(model.centred(x) / root).sum()])])[0][0])
    if not model.trace:
        blocks.unpersist()
        return model

    def step(p: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        held = spark.sparkContext.broadcast((p, earlier))

        def products(x: np.ndarray) -> list[np.ndarray]:
            p, earlier = held.value
            rows = model.centred(x) / root
            u = rows @ p
            return [rows.T @ u, (rows @ earlier.T).T @ u, np.array([u @ u])]

        z, inner, square = _summed(blocks, dimension, products)
        held.destroy()
        return z, inner, float(square[0])

    basis, small = bidiagonalised(step, dimension, float(np.sqrt(model.trace)))
    _, deviations, right = np.linalg.svd(small)
    kept = min(components, int((deviations > 64 * dimension * EPSILON * deviations[0]).sum()))
    found = right[:kept] @ basis.T
    found /= np.linalg.norm(found, axis=1)[:, None]
    # Either sign would do; the largest entry is made positive.
    found *= np.sign(found[np.arange(kept), np.abs(found).argmax(axis=1)])[:, None]
    model.components, model.eigenvalues = found, deviations[:kept] ** 2

    def moments(x: np.ndarray) -> list[np.ndarray]:
        y = model.projected(x)
        return [y.sum(axis=0), (y.T @ y).ravel()]

    mean, products = _summed(blocks, dimension, moments)
    mean = mean / n
    covariance = products.reshape(kept, kept) / n - np.outer(mean, mean)
    model.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    blocks.unpersist()
    return model


def _dimension(rows: DataFrame) -> int:
    return rows.select(F.size("x")).first()[0]


def apply(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The usable rows with all their columns, and ``deviation`` (decimal(38, 0), NULL if it has more digits) and
    ``whitened`` (array<double>, one entry for each component). Given columns of these names are replaced. Repeated rows stay."""
    spark = vectors.sparkSession
    ready(spark)
    own = [c for c in vectors.columns if c not in ("deviation", "whitened")]
    rows = usable(vectors.select(*own), column, model.dimension, "__x")
    fields = [f for f in rows.schema.fields if f.name != "__x"]
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        kept = len(model.components)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(len(own)))
            sums = [Decimal(v) if v < 10**38 else None for v in model.deviations(x)]
            flat = model.projected(x) if kept else np.zeros((len(x), 0))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * kept, pa.int32()), pa.array(flat.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sums, pa.decimal128(38, 0)), lists], [*own, "deviation", "whitened"])

    return rows.select(*own, "__x").mapInArrow(run, StructType([
        *fields, StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))]))


def per_component(spark: SparkSession, rows: DataFrame, model: Whitening, id_column: str = "vec_id") -> DataFrame:
    """One row for each vector and component, numbered from 1, with the figures of the model beside it."""
    shares = [float(e) / model.trace for e in model.eigenvalues]
    explained = F.array(*map(F.lit, shares)).cast("array<double>")
    return rows.select(id_column, "deviation", F.posexplode("whitened").alias("__at", "whitened")).select(
        id_column, (F.col("__at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        F.get(explained, F.col("__at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
