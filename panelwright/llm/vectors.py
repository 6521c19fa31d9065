"""Shared parts of the vector operators: usable rows, whole-number components, matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scaled components beyond this are held there, so that sums of squares of
# whole vectors stay inside 64 bits (real embeddings are far below).
LARGEST = 1 << 26


def usable(vector: Column) -> Column:
    """True for a vector with components, none of them null or non-finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))  # NaN is above infinity
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def whole(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * component) + shift as longs, all floors down."""

    def one(c: Column) -> Column:
        x = F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
        return F.floor(x).cast("long") + F.lit(shift).cast("long")

    return F.transform(vector, one)


def dimension(rows: DataFrame, vector: str, id_col: str) -> int:
    """Length of the vector with the smallest id; 0 for an empty table."""
    first = rows.select(id_col, F.size(vector).alias("_d")).orderBy(F.col(id_col).asc_nulls_last(), F.col("_d").desc()).limit(1).collect()
    return first[0]["_d"] if first else 0


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
