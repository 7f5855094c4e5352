"""Truncated decompositions of tall sparse matrices: a randomised range finder and a tall-skinny QR that tasks reduce in a tree.

A basis of the columns' space is found by power iterations, each of which multiplies the rows with the basis and back and
adds the tasks' products up in a tree. The rows' products with the basis are then reduced to one triangle by QR of
QRs, and the triangle's singular values are the matrix's. Nothing is squared, so small values come out as well
as large ones, and the driver holds the basis, columns times rank, never columns times columns. Where the rank is a good part of
the columns the basis is the identity, and the result is exact. Centring is a shift of rank one in the products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.sources.scratch import Scratch

#: Columns more than asked for, power iterations, and the part of the columns from which on the basis is the identity.
MORE, POWER, EXACT = 10, 4, 4
#: Rows that are worked on at once, and results that are put together in one task of the tree.
ROWS, FAN = 512, 8
#: Numbers of a block of a sum.
BLOCK = 1 << 16


def sparse_blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, values): of a few rows (indices, values) the columns that occur, and a dense matrix of them alone."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            index, value = (batch.column(c).slice(lo, rows) for c in (0, 1))
            sizes = np.diff(index.offsets.to_numpy()).astype(np.int64)
            columns, place = np.unique(index.flatten().to_numpy().astype(np.int64), return_inverse=True)
            x = np.zeros((len(sizes), len(columns)))
            x[np.repeat(np.arange(len(sizes)), sizes), place] = value.flatten().to_numpy()
            yield columns, x


def column_sums(features: DataFrame, size: int) -> tuple[int, np.ndarray, float]:
    """Number of rows, sums of the columns, and the sum of all squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for columns, x in sparse_blocks(batches):
            total[columns] += x.sum(0)
            total[size:] += len(x), (x * x).sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["entry", "total"])

    table = features.select("indices", "values").mapInArrow(run, "entry long, total double").groupBy("entry").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(size + 2)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return int(out[size]), out[:size], float(out[size + 1])


def _tree(scratch: Scratch, parts: DataFrame, tasks: int, together, schema: str, name: str) -> DataFrame:
    """Puts the parts (task, block, ...) of up to FAN neighbouring tasks together until one is left for each block."""
    level = 0
    while tasks > 1:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task", "block").applyInArrow(together, schema)
        tasks, level = -(-tasks // FAN), level + 1
        if tasks > 1:
            parts = scratch.save(parts, f"{name}-{level}")
    return parts


def multiplied(scratch: Scratch, features: DataFrame, basis: np.ndarray, mean: np.ndarray | None) -> np.ndarray:
    """A' A P for rows A, centred by ``mean``, and a basis P: a matrix as large as the basis."""
    shared = features.sparkSession.sparkContext.broadcast(basis)
    shift = None if mean is None else mean @ basis
    schema = "task int, block int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        total, ones = np.zeros_like(p), np.zeros(p.shape[1])
        for columns, x in sparse_blocks(batches):
            y = x @ p[columns]
            if shift is not None:
                y -= shift
                ones += y.sum(0)
            total[columns] += x.T @ y
        if shift is not None:
            total -= np.outer(mean, ones)
        flat = total.ravel()
        for b in range(0, flat.size, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([b // BLOCK], pa.int32()), pa.array([flat[b : b + BLOCK].tobytes()], pa.binary())], ["task", "block", "data"])

    def together(table: pa.Table) -> pa.Table:
        data = np.sum([np.frombuffer(d, np.float64) for d in table.column("data").to_pylist()], 0)
        return table.slice(0, 1).set_column(2, "data", pa.array([data.tobytes()], pa.binary()))

    rows = features.select("indices", "values")
    parts = rows.mapInArrow(run, schema)
    out, flat = np.zeros_like(basis), None
    flat = out.reshape(-1)
    for r in _tree(scratch, parts, rows.rdd.getNumPartitions(), together, schema, "product").toLocalIterator():
        data = np.frombuffer(bytes(r.data), np.float64)
        flat[r.block * BLOCK : r.block * BLOCK + len(data)] = data
    shared.unpersist()
    return out


def triangle(scratch: Scratch, features: DataFrame, size: int, basis: np.ndarray | None, mean: np.ndarray | None) -> np.ndarray:
    """R of the QR of A P, the rows' products with the basis (None: the rows themselves), by QRs of QRs."""
    width = size if basis is None else basis.shape[1]
    shared = None if basis is None else features.sparkSession.sparkContext.broadcast(basis)
    shift = None if mean is None else mean if basis is None else mean @ basis
    schema = "task int, block int, data binary"
    chunk = max(ROWS, 2 * width)

    def reduced(stack: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(stack), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.zeros((0, width))], 0
        for columns, x in sparse_blocks(batches):
            if shared is None:
                y = np.zeros((len(x), width))
                y[:, columns] = x
            else:
                y = x @ shared.value[columns]
            held.append(y if shift is None else y - shift)
            n += len(y)
            if n > chunk:
                held, n = [reduced(held)], 0
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([0], pa.int32()), pa.array([reduced(held).tobytes()], pa.binary())], ["task", "block", "data"])

    def together(table: pa.Table) -> pa.Table:
        stack = [np.frombuffer(d, np.float64).reshape(-1, width) for d in table.column("data").to_pylist()]
        return table.slice(0, 1).set_column(2, "data", pa.array([reduced(stack).tobytes()], pa.binary()))

    rows = features.select("indices", "values")
    found = [np.frombuffer(bytes(r.data), np.float64).reshape(-1, width) for r in _tree(scratch, rows.mapInArrow(run, schema), rows.rdd.getNumPartitions(), together, schema, "triangle").collect()]
    return reduced([np.zeros((0, width)), *found])


def decomposed(features: DataFrame, size: int, k: int, mean: np.ndarray | None = None, power: int = POWER, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values of the rows (indices, values), centred by ``mean``, and their right vectors as columns.

    Indices of a row don't repeat. Signs make each vector's largest entry positive.
    """
    scratch = Scratch(features.sparkSession, "factor")
    width, basis = k + MORE, None
    if EXACT * width < size:
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
        for _ in range(power):
            basis = np.linalg.qr(multiplied(scratch, features, basis, mean))[0]
    r = triangle(scratch, features, size, basis, mean)
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate([s, np.zeros(vt.shape[0] - len(s))])  # fewer rows than columns
    v = vt.T if basis is None else basis @ vt.T
    s, v = s[:k], v[:, :k]
    return s, v * np.where(np.take_along_axis(v, np.abs(v).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)
