"""Embedding rows as packed vectors, shared by the operators on ``embeddings``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension(rows: DataFrame) -> int:
    """The length that most non-empty vectors have (the greater of equally frequent ones); 0 without any."""
    sizes = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).count()
    most = sizes.orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return 0 if most is None else most["size"]


def finite(dim: int) -> Column:
    """Whether a row has an id and a vector of ``dim`` components, none null or non-finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & fine


def distinct_ids(rows: DataFrame) -> DataFrame:
    """One row for each vec_id: that of the least other columns.  Nothing is shuffled but ids unless one repeats."""
    if not rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        return rows
    others = [c for c in rows.columns if c != "vec_id"]
    return rows.groupBy("vec_id").agg(F.min(F.struct(*others)).alias("x")).select("vec_id", *[f"x.{c}" for c in others])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list<double> column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dim)


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def unpacked(column: pa.Array, dtype) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def inner(a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Inner products of the rows of two matrices, summed from the first component on, so that equal pairs
    of vectors have equal products wherever they are computed."""
    out = np.zeros(len(a))
    for at in range(0, len(a), step):
        x, y, s = a[at:at + step], b[at:at + step], out[at:at + step]
        for k in range(a.shape[1]):
            s += x[:, k] * y[:, k]
    return out
