"""Shared parts of the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not zero, without null, NaN or infinite components."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < big))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def kind_of(df: DataFrame, vector_col: str) -> str:
    """The type in which vectors are kept: floats as they are, all other numbers as doubles, so that none loses digits."""
    return "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"


def typed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of all rows."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind_of(df, vector_col)).alias("v"))


def pick(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part and have an id."""
    return typed(df, id_col, vector_col).where(F.col("id").isNotNull() & valid(F.col("v")))


def matrix(column) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return np.array(column.tolist(), np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first goes to 1, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows, summed the same way whatever their place in a block."""
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
