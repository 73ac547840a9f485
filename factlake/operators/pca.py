"""Principal components of wide sparse (or dense) rows.

A dense covariance of 10,000 terms does not fit a driver, so the leading
subspace is found by randomised iteration: each pass multiplies the centred
rows with a thin matrix and adds up, over the rows, what comes back. Only the
thin matrix (columns x about 30) is ever held by the driver or a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.scale import materialize

# Columns whose partial products are added up together: many small groups.
STRIPE = 64


def _sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, column number and value of the entries of a batch of ML
    vectors."""
    dense = np.asarray(column.field("type")) == 1
    values = column.field("values")
    lengths = np.asarray(values.value_lengths(), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    value = np.asarray(values.flatten(), dtype=np.float64)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    col = np.arange(len(value)) - start
    col[~dense[row]] = np.asarray(column.field("indices").flatten(), dtype=np.int64)
    return row, col, value


def _times(entries, matrix: np.ndarray, rows: int) -> np.ndarray:
    """Sparse rows x thin matrix."""
    row, col, value = entries
    # One column at a time stays in a core's cache
    columns = np.ascontiguousarray(matrix.T)
    return np.stack([np.bincount(row, value * c[col], minlength=rows) for c in columns], axis=1)


def _transposed_times(entries, matrix: np.ndarray, cols: int) -> np.ndarray:
    row, col, value = entries
    columns = np.ascontiguousarray(matrix.T)
    return np.stack([np.bincount(col, value * c[row], minlength=cols) for c in columns], axis=1)


@dataclass(frozen=True)
class PcaModel:
    mean: np.ndarray
    components: np.ndarray  # columns x k
    variances: np.ndarray

    def transform(self, df: DataFrame, column: str, output: str) -> DataFrame:
        """Adds the centred projection as an array."""
        shift = self.mean @ self.components
        shared = df.sparkSession.sparkContext.broadcast((self.components, shift))

        @F.arrow_udf("array<double>")
        def project(rows: pa.Array) -> pa.Array:
            components, shift = shared.value
            out = _times(_sparse(rows), components, len(rows)) - shift
            ends = np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return df.withColumn(output, project(F.col(column)))


def _summed(rows: DataFrame, q: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Centred rows, transposed, times (centred rows times q), over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((q, mean))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, mean = shared.value
        total, sums = np.zeros_like(q), np.zeros(q.shape[1])
        for b in batches:
            entries = _sparse(b.column(0))
            y = _times(entries, q, b.num_rows) - mean @ q
            total += _transposed_times(entries, y, len(q))
            sums += y.sum(axis=0)
        total -= np.outer(mean, sums)
        starts = np.arange(0, len(total), STRIPE, dtype=np.int32)
        ends = np.minimum(np.append(starts, len(total)) , len(total)) * q.shape[1]
        parts = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(total.ravel()))
        yield pa.RecordBatch.from_pydict({"stripe": pa.array(starts), "part": parts})

    parts = rows.mapInArrow(partial, "stripe int, part array<double>")
    added = parts.groupBy("stripe").agg(Summarizer.sum(array_to_vector(F.col("part"))).alias("s"))
    found = added.select("stripe", vector_to_array("s").alias("s")).toArrow().sort_by("stripe")
    return np.asarray(found["s"].combine_chunks().flatten()).reshape(q.shape)


def fit_pca(
    df: DataFrame,
    column: str,
    k: int = 20,
    oversample: int = 10,
    iterations: int = 7,
    seed: int = 42,
) -> PcaModel:
    """Leading `k` components; the largest entry of each is positive."""
    rows = materialize(df.select(F.col(column).alias("v")), "pca")
    stats = rows.agg(
        Summarizer.metrics("mean", "count").summary(F.col("v")).alias("s")
    ).first()["s"]
    mean, n = stats["mean"].toArray(), stats["count"]
    width = len(mean)
    if n < 2 or k > width:
        raise ValueError(f"cannot find {k} components in {n} rows of {width} numbers")
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((width, min(width, k + oversample))))
    for _ in range(iterations):
        q, _ = np.linalg.qr(_summed(rows, q, mean))
    small = q.T @ _summed(rows, q, mean) / (n - 1)
    variances, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(variances)[::-1][:k]
    components = q @ turn[:, best]
    largest = components[np.abs(components).argmax(axis=0), np.arange(k)]
    signs = np.where(largest < 0, -1.0, 1.0)
    return PcaModel(mean, components * signs, variances[best])
