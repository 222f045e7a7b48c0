"""Singular values and components of a tall matrix: one row of features for each record.

The products of all column pairs are summed in every task and then over tasks, so the driver sees a
square of the columns, of which there are few; rows are never gathered.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_COLUMNS = 4096


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gram(rows: DataFrame, features: str) -> np.ndarray:
    """The features' matrix of products, columns by columns."""
    source = rows.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("v"))

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                a = _rows(batch.column("v"))
                if a.shape[1] > MOST_COLUMNS:
                    raise ValueError("too many columns for a matrix of their products")
                total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = source.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    cells = parts.toArrow()  # as many numbers as the square has, in columns
    i, j = (cells.column(c).to_numpy() for c in ("i", "j"))
    n = 1 + int(i.max(initial=-1))
    out = np.zeros((n, n))
    out[i, j] = cells.column("v").to_numpy()
    return out


def decompose(rows: DataFrame, features: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values, and the right singular vectors as columns, each with its largest entry positive."""
    values, vectors = np.linalg.eigh(gram(rows, features))
    order = np.argsort(values)[::-1][:k]
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])]) if len(order) else np.zeros(0)
    return np.sqrt(np.maximum(values[order], 0)), vectors * sign


def project(rows: DataFrame, key: str, features: str, vectors: np.ndarray, scale=1.0) -> DataFrame:
    """(key, scores): each record's coordinates along the vectors, divided by `scale`."""
    kind = rows.schema[key].dataType.simpleString()
    source = rows.where(F.col(features).isNotNull()).select(key, F.col(features).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(((_rows(batch.column("v")) @ vectors) / scale).tolist(), pa.list_(pa.float64()))], [key, "scores"])

    return source.mapInArrow(run, f"{key} {kind}, scores array<double>")


def truncated_svd(rows: DataFrame, key: str, features: str, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(key, scores) of the left singular vectors, the singular values and the right singular vectors."""
    values, vectors = decompose(rows, features, k)
    return project(rows, key, features, vectors, np.where(values > 0, values, 1)), values, vectors


def uncentred_components(rows: DataFrame, key: str, features: str, k: int) -> DataFrame:
    """(key, scores): principal components without centring."""
    return project(rows, key, features, decompose(rows, features, k)[1])
