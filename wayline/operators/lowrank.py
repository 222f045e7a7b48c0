"""The largest singular values of a wide and tall matrix, with both kinds of singular vectors, by random sampling of its range.

A record's features are a row. The matrix meets a thin random one; the orthonormal basis of what
comes out is found by QR in every task, then of the tasks' triangles, up a tree; rounds of
multiplying by the matrix and its transpose turn it towards the largest singular vectors; what is
left is a small decomposition. No square of the columns is ever made, so there may be many: the
driver and each task hold some thin matrices, columns by k + extra.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import project

#: Numbers of a thin matrix at most, and tasks whose results are put together at once.
MOST, FAN = 1 << 26, 64
#: Columns of a thin matrix that travel in one row.
STRETCH = 1024


def _blocks(source: DataFrame, make, schema: str) -> DataFrame:
    """What `make`, a function of a task's number and its batches as matrices, yields as rows of `part` and further columns."""

    def run(batches):
        from pyspark import TaskContext

        matrices = (b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in batches if b.num_rows)
        yield from make(TaskContext.get().partitionId(), matrices)

    return source.mapInArrow(run, schema)


def _triangle(source: DataFrame, basis: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of the matrix times a thin one."""
    width = basis.shape[1]

    def own(part, matrices):
        r = np.zeros((0, width))
        for a in matrices:
            r = np.linalg.qr(np.vstack([r, a @ basis]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "r"])

    def joined(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(table.column("r").combine_chunks().flatten().to_numpy().reshape(-1, width), mode="r")
        return pa.table({"r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    parts = _blocks(source, own, "part long, r array<double>").groupBy(F.floor(F.col("part") / FAN)).applyInArrow(joined, "r array<double>")
    found = [np.array(row.r).reshape(-1, width) for row in parts.collect()]  # a triangle for every FAN tasks
    return np.linalg.qr(np.vstack([np.zeros((0, width)), *found]), mode="r")


def _transposed(source: DataFrame, right: np.ndarray) -> np.ndarray:
    """The transpose of the matrix times (the matrix times `right`): as thin as `right`."""
    n, width = right.shape

    def own(part, matrices):
        total = np.zeros((n, width))
        for a in matrices:
            total += a.T @ (a @ right)
        for at in range(0, n, STRETCH):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at]), pa.array([total[at : at + STRETCH].ravel()], pa.list_(pa.float64()))], ["part", "at", "values"])

    def added(table: pa.Table) -> pa.Table:
        rows = table.column("values").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return pa.table({"part": [table.column("part")[0].as_py() // FAN], "at": [table.column("at")[0].as_py()], "values": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    schema = "part long, at long, values array<double>"
    sums = _blocks(source, own, schema)
    for _ in range(2):  # up a tree: FAN tasks, then FAN of those
        sums = sums.groupBy(F.floor(F.col("part") / FAN), "at").applyInArrow(added, schema)
    out = np.zeros((n, width))
    for row in sums.collect():
        out[row.at : row.at + STRETCH] += np.array(row["values"]).reshape(-1, width)
    return out


def randomised_svd(rows: DataFrame, key: str, features: str, k: int, *, extra=16, rounds=4, seed=1) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((key, scores) of the left singular vectors, the k largest singular values, the right singular vectors as columns).

    extra: columns of the thin matrix beyond k; rounds: how often it meets the matrix and its transpose. More of both come nearer
    where singular values lie close together. Each round reads the rows twice: write them first where they cost much.
    Null features are passed over; all others must be of one length. Each right vector has its largest entry positive.
    """
    source = rows.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("v"))
    first = source.select(F.size("v").alias("n")).first()
    n = first.n if first else 0
    width = min(n, k + extra)
    if n * width > MOST:
        raise ValueError("too many columns for a thin matrix of them")
    if not n:
        return project(rows, key, features, np.zeros((0, 0))), np.zeros(0), np.zeros((0, 0))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    for turn in range(rounds + 1):
        # an orthonormal basis of the range: the product, with its triangle taken off
        right = basis @ np.linalg.pinv(_triangle(source, basis), rcond=1e-12)
        thin = _transposed(source, right)
        if turn < rounds:
            basis = np.linalg.qr(thin)[0]
    inner, values, outer = np.linalg.svd(thin.T, full_matrices=False)
    k = min(k, len(values))
    vectors = outer[:k].T
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])
    return project(rows, key, features, right @ inner[:, :k] * sign), values[:k], vectors * sign
