"""Whitening of embeddings by the exact characteristic polynomial of their scatter (operator 11).

Entries become integers, so the scatter is exact: tasks add up their rows, Spark adds up the tasks. Its
characteristic polynomial comes from residues modulo many primes (a Spark job over the primes), its largest
real roots from counted sign changes and bisection, the components from inverse iteration in fixed point (a Spark
job over the roots). What the driver holds is as large as one matrix, however many vectors there are; vectors
themselves are only ever scanned, never shuffled.

Defined results: vectors that are null, or hold a null, a non-finite entry or one beyond 2**56, are left out, and
so are empty ones and those whose length is not the most frequent one (of equally frequent ones the larger); null
ids stay null and repeated rows count as often as they occur; components without variance are left out, so a table
of equal vectors, of one or of none gives no components; of a multiple eigenvalue any orthonormal basis is taken;
a deviation beyond 64 bits is null; columns of the input named like a new one are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.exact_roots import (
    coefficient_bound, combine, largest_roots, null_vectors, polynomial_residues, primes_beyond,
)

SCALE = 64  # an entry c counts as floor(SCALE * c)
LARGEST = float(2**56)
SLICE_ROWS = 8192
LIMB = 60  # bits of the lower half of a sum


@dataclass
class Whitening:
    """What the vectors of a table share. ``matrix`` takes a centred vector to its whitened components."""

    size: int
    n: int
    sums: list[int]  # of floor(SCALE * c), by dimension
    components: np.ndarray  # a row each, unit length
    variances: list[float]
    explained: list[float]

    @property
    def matrix(self) -> np.ndarray:
        return self.components.T / np.sqrt(np.array(self.variances))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: present, with finite entries that fit."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST))  # NaN is larger than all
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def _entries(column: pa.Array, size: int) -> np.ndarray:
    """floor(SCALE * c) of a list column whose rows all have ``size`` entries."""
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(values * SCALE).astype(np.int64).reshape(-1, size)


def _slices(batches, name: str):
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield part, part.column(name)


def _products(x: np.ndarray) -> np.ndarray:
    """The exact sums of products of all pairs of columns, as Python integers."""
    most = max(int(x.max()), -int(x.min())) + 1
    out = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    rows = 2**53 // most**2
    if rows == 0:  # a product of two entries is beyond a double
        wide = x.astype(object)
        return wide.T @ wide
    for start in range(0, len(x), rows):
        part = x[start : start + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)  # all sums are below 2**53, so exact
    return out


def _scatter(vectors: DataFrame, size: int) -> tuple[list[int], list[list[int]]]:
    """Sums by dimension and sums of products, exact; as many rows as the matrix has cells leave each task."""
    upper = np.triu_indices(size)

    def run(batches):
        sums, products = np.zeros(size, dtype=object), np.zeros((size, size), dtype=object)
        for _, column in _slices(batches, "vector"):
            x = _entries(column, size)
            sums += x.sum(axis=0, dtype=object) if abs(x).max() > 2**40 else x.sum(axis=0).astype(object)
            products += _products(x)
        cells = [*sums.tolist(), *products[upper].tolist()]
        decimals = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_pydict(
            {
                "cell": pa.array(range(len(cells)), pa.int32()),
                "high": pa.array([Decimal(v >> LIMB) for v in cells], decimals),
                "low": pa.array([Decimal(v % 2**LIMB) for v in cells], decimals),
            }
        )

    found = vectors.mapInArrow(run, "cell int, high decimal(38,0), low decimal(38,0)")
    total = {r.cell: (int(r.h) << LIMB) + int(r.l) for r in found.groupBy("cell").agg(F.sum("high").alias("h"), F.sum("low").alias("l")).collect()}
    products = [[0] * size for _ in range(size)]
    for k, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
        products[i][j] = products[j][i] = total[size + k]
    return [total[i] for i in range(size)], products


def _polynomial(spark, matrix: list[list[int]], trace: int) -> list[int]:
    """The characteristic polynomial: each task takes some primes."""
    primes = primes_beyond(2 * coefficient_bound(trace, len(matrix)))

    def run(batches):
        for batch in batches:
            some = batch.column("prime").to_pylist()
            if some:
                residues = polynomial_residues(matrix, some)
                yield pa.RecordBatch.from_pydict({"prime": pa.array(some, pa.int64()), "residues": pa.array(residues.tolist(), pa.list_(pa.int64()))})

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks)
    found = rows.mapInArrow(run, "prime long, residues array<long>").collect()
    return combine([r.residues for r in found], [r.prime for r in found])


def _vectors(spark, matrix: list[list[int]], roots: list[tuple[int, int, int]]) -> list[list[float]]:
    """Unit eigenvectors in the order of the roots: each task takes some roots."""

    def run(batches):
        for batch in batches:
            for k, at, bits, many in zip(*(batch.column(c).to_pylist() for c in ("k", "at", "bits", "many"))):
                found = null_vectors(matrix, int(at), bits, many)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "vectors": pa.array([found], pa.list_(pa.list_(pa.float64())))})

    rows = [(k, str(at), bits, many) for k, (at, bits, many) in enumerate(roots)]
    tasks = min(len(rows), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame(rows, "k int, at string, bits int, many int").repartition(tasks)
    found = rows.mapInArrow(run, "k int, vectors array<array<double>>").collect()
    return [v for r in sorted(found, key=lambda r: r.k) for v in r.vectors]


def fit(df: DataFrame, vector_col: str = "embedding", components: int = 32) -> Whitening:
    """The whitening of all vectors of ``df``, to at most ``components`` components of the largest variances."""
    spark = df.sparkSession
    vectors = df.select(F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    size = vectors.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = size.orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return Whitening(0, 0, [], np.zeros((0, 0)), [], [])
    size, n = size.size, size.n
    sums, products = _scatter(vectors.where(F.size("vector") == size), size)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]  # n * n * covariance
    trace = sum(matrix[i][i] for i in range(size))
    if trace == 0:
        return Whitening(size, n, sums, np.zeros((0, size)), [], [])
    roots = largest_roots(_polynomial(spark, matrix, trace), components)
    found = np.array(_vectors(spark, matrix, roots))[:components]
    values = [(at, bits) for at, bits, many in roots for _ in range(many)][:components]
    return Whitening(
        size, n, sums, found,
        [at / (n * n << bits) for at, bits in values],
        [at / (trace << bits) for at, bits in values],
    )


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exact: 64-bit integers, or Python's where these do not reach."""
    most = max(int(abs(x).max(initial=0)) * model.n, max(map(abs, model.sums)))
    kind = np.int64 if most < 2**62 else object
    return x.astype(kind) * model.n - np.array(model.sums, dtype=kind)


def _deviations(centred: np.ndarray) -> pa.Array:
    most = int(abs(centred).max(initial=0))
    if most**2 * centred.shape[1] >= 2**63:
        centred = centred.astype(object)
    return pa.array([v if v < 2**63 else None for v in (centred * centred).sum(axis=1).tolist()], pa.int64())


def whiten(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """The rows of ``df`` whose vector takes part, with ``deviation`` and the array ``whitened``."""
    kept = [c for c in df.columns if c not in ("deviation", "whitened")]
    rows = df.where(usable(F.col(vector_col)) & (F.size(vector_col) == model.size)).select(
        F.col(vector_col).alias("_vector"), *kept
    )
    out = T.StructType(
        [*(rows.schema[c] for c in kept), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for part, column in _slices(batches, "_vector"):
            centred = _centred(_entries(column, model.size), model)
            whitened = (centred / model.n).astype(np.float64) @ model.matrix
            offsets = np.arange(len(whitened) + 1, dtype=np.int32) * whitened.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whitened.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _deviations(centred), lists], out.names)

    return rows.mapInArrow(run, out)


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity; 0 without components."""
    k = len(model.variances)
    if not k:
        return 0.0

    def run(batches):
        sums, products = np.zeros(k), np.zeros((k, k))
        for _, column in _slices(batches, "whitened"):
            w = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            sums += w.sum(axis=0)
            products += w.T @ w
        cells = np.concatenate([sums, products.reshape(-1)])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(len(cells)), pa.int32()), "value": pa.array(cells)})

    found = whitened.select("whitened").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("v"))
    total = np.zeros(k + k * k)
    for row in found.collect():
        total[row.cell] = row.v
    mean, products = total[:k] / model.n, total[k:].reshape(k, k) / model.n
    # the vectors were centred exactly before they were projected; what rounding left of their mean goes here
    return float(abs(products - np.outer(mean, mean) - np.eye(k)).max())
