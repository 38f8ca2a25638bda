"""Embedding whitening by the cyclic Jacobi method.

Vectors are put on a whole-number grid, so that equal ones are exactly equal and sums are exact. The fit uses each distinct vector once. Its scatter is made in
two distributed passes: the first gives the number of vectors and the sums of each dimension, the second the products of vectors centred by these,
one partial matrix a task, added up entry by entry. The driver, which holds one matrix of dimensions by dimensions, turns it by symmetric Jacobi
rotations, in rounds of disjoint pairs so that each sweep meets every pair once, until every off-diagonal entry is negligible beside its own
two diagonal entries; so small eigenvalues keep their relative accuracy. Directions are sorted by falling eigenvalue, scaled, broadcast, and
applied to every row; a last distributed pass measures how far the covariance of the whitened vectors is from the identity.

Scale. The rows are written once with their number and digest. Digests that occur once are told by the two-pass Bloom filter of exact dedup, so no vector is
shuffled to find the distinct ones; only those that repeat another meet a shuffle, and a group of copies of any size collapses on the map side. Each task
emits at most dimensions squared partial sums; the driver gets one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.bloom import left_join_sparsely
from ledgerframe.llm.exact_dedup import repeated
from ledgerframe.llm.shared import counted, numbered, place, written

STEP = 64.0
SHIFT = 1_000_000
COMPONENTS = 16
#: The driver holds some matrices of dimensions by dimensions, 128 MB each at most.
MOST_DIMENSIONS = 4096
#: Rows that are centred and multiplied at once.
BLOCK = 4096
SWEEPS = 60
#: Eigenvalues below this share of the largest are rounding of zero.
NEGLIGIBLE = 1e-13


@dataclass(frozen=True)
class Whitening:
    """directions: one column for each component, eigenvectors divided by the roots of their eigenvalues; sums and n of the fit list."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    explained: np.ndarray


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semi-definite matrix."""
    a, size = np.array(matrix, np.float64), len(matrix)
    even = size + size % 2
    v, order = np.eye(size), np.arange(even)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(1, even - 1)):
            # One round of a tournament: disjoint pairs, of which one may be with the place that an odd size leaves free.
            p, q = np.minimum(order[: even // 2], order[even // 2 :][::-1]), np.maximum(order[: even // 2], order[even // 2 :][::-1])
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
            real = q < size
            p, q = p[real], q[real]
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            much = np.abs(apq) > np.finfo(float).eps * np.sqrt(np.abs(app * aqq))
            if not much.any():
                continue
            turned = True
            p, q, app, aqq, apq = p[much], q[much], app[much], aqq[much], apq[much]
            with np.errstate(over="ignore", divide="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            columns_p, columns_q = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * columns_p - s * columns_q, s * columns_p + c * columns_q
            a[p, q] = a[q, p] = 0.0
            # In the closed form, which keeps small values accurate.
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            vectors_p, vectors_q = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vectors_p - s * vectors_q, s * vectors_p + c * vectors_q
        if not turned:
            break
    values = np.diagonal(a)
    falling = np.argsort(-values, kind="stable")
    return values[falling], v[:, falling]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of an array column without nulls as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _deviations(column: pa.Array, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums of each row: exact, in longs where all fit."""
    x = _matrix(column, len(sums))
    most = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    return n * x - sums.astype(np.int64) if most < 1 << 62 else n * x.astype(object) - sums


def gridded(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and x, floor(STEP * c) + SHIFT of each entry, of the rows whose vector is there and has finite entries alone."""
    entries = F.transform(place(vectors, vector_column), lambda c: c.cast("double"))
    rows = numbered(vectors).select(place(vectors, id_column).alias("id"), entries.alias("e"))
    good = F.col("e").isNotNull() & F.forall("e", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(good).select("id", F.transform("e", lambda c: F.floor(c * F.lit(STEP)) + F.lit(SHIFT)).alias("x"))


def _sums(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of rows (x) and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            fits = int(np.abs(x).max(initial=0)) * max(1, len(x)) < 1 << 62
            n, sums = n + len(x), sums + (x if fits else x.astype(object)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(s) for s in sums])], names=["i", "n", "s"])

    parts = rows.select("x").mapInArrow(run, "i int, n long, s string")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = np.zeros(size, object)
    for r in found:
        sums[r.i] = int(r.s)
    return (found[0].n if found else 0), sums


def _scatter(rows: DataFrame, n: int, sums: np.ndarray, directions: np.ndarray | None = None) -> np.ndarray:
    """Products of the rows (x) centred by sums / n, summed over all; with directions, of the rows projected on these."""
    size = len(sums) if directions is None else directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((size, size)), np.zeros(size)
        seen = False
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part, seen = batch.slice(k, BLOCK), True
                c = (_deviations(part.column(0), n, sums) / n).astype(np.float64)
                c = c if directions is None else c @ directions
                total += c.T @ c
                mean += c.sum(axis=0)
        if seen:
            i, j = np.triu_indices(size)
            entries = [np.concatenate([i, np.full(size, -1)]), np.concatenate([j, np.arange(size)]), np.concatenate([total[i, j], mean])]
            yield pa.RecordBatch.from_arrays([pa.array(entries[0], pa.int32()), pa.array(entries[1], pa.int32()), pa.array(entries[2])], names=["i", "j", "v"])

    parts = rows.select("x").mapInArrow(run, "i int, j int, v double")
    out, mean = np.zeros((size, size)), np.zeros(size)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r.i < 0:
            mean[r.j] = r.v
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.v
    # What rounding has left of the mean.
    return out - np.outer(mean, mean) / n


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct rows (x, `size` long entries each, written); None without rows or dimensions.

    Components whose eigenvalue is zero, but for rounding, have no whitened value and are left out."""
    if size > MOST_DIMENSIONS:
        raise ValueError(f"at most {MOST_DIMENSIONS} dimensions, not {size}")
    n, sums = _sums(rows, size) if size else (0, np.zeros(0, object))
    if not n:
        return None
    values, vectors = jacobi(_scatter(rows, n, sums) / n)
    total = values.sum()
    real = int((values[:components] > max(NEGLIGIBLE * values[0], 0.0)).sum())
    return Whitening(n, sums, vectors[:, :real] / np.sqrt(values[:real]), values[:real] / total if real else values[:0])


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array) and identity_error: one row for each vector with finite entries alone.

    n is the number of distinct vectors on the grid; deviation the sum over dimensions of (n * x - S)^2, exact; whitened has one entry for each
    component, by falling eigenvalue. Vectors that are null, empty, or hold a null or a value that is not finite are dropped; so are those of another length than
    most have (of two lengths as frequent the greater stays). Where fewer components than asked for vary, whitened is shorter; if all vectors are
    equal it is empty. Repeated rows and ids come out each, and count once in the fit; null ids stay; other columns are not read, whatever they are called;
    an empty table gives no rows. A deviation, or an entry on the grid, beyond a long is an error.
    """
    spark = vectors.sparkSession
    rows = gridded(vectors, id_column, vector_column).withColumn("rid", F.monotonically_increasing_id()).withColumn("size", F.size("x"))
    rows, seen = counted(rows.withColumn("sha", F.unhex(F.sha2(F.to_json(F.struct("x")).cast("binary"), 256))), "vectors")
    sizes = rows.groupBy("size").count().where("size > 0").agg(F.max(F.struct("count", "size"))["size"]).first()[0]
    size = int(sizes or 0)
    rows = rows.where(F.col("size") == size)
    again = repeated(rows.select("rid", F.lit(0).alias("id"), "sha"), seen)
    distinct = written(left_join_sparsely(rows.select("rid", "x"), again, "rid").where("lost is null").select("x"), "distinct")
    found = fit(distinct, size, components)
    kind = dict(rows.dtypes)["id"]
    schema = f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if found is None:
        return spark.createDataFrame([], schema)
    k = found.directions.shape[1]
    error = float(np.abs(_scatter(distinct, found.n, found.sums, found.directions) / found.n - np.eye(k)).max()) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                z = _deviations(part.column(1), found.n, found.sums)
                wide = int(np.abs(z).max(initial=0)) ** 2 * size >= 1 << 63
                squares = ((z.astype(object) if wide else z) ** 2).sum(axis=1)
                w = pa.array(((z / found.n).astype(np.float64) @ found.directions).reshape(-1))
                cuts = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(squares), pa.int64()), pa.ListArray.from_arrays(cuts, w)], names=["vec_id", "deviation", "whitened"])

    out = rows.select("id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")
    explained = F.array(*[F.lit(float(e)) for e in found.explained]).cast("array<double>")
    return out.select("vec_id", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """The result of `whiten` with one row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = whitened.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("k", "w"))
    return rows.select("vec_id", (F.col("k") + F.lit(1)).cast("int").alias("component"), "n", "deviation", F.col("w").alias("whitened"), F.get("explained", F.col("k")).alias("explained"), "identity_error")
