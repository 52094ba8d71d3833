"""Tables of vectors: which rows take part, and their numbers as numpy matrices.

Defined results: a row takes part if its vector is an array without null and without NaN or
infinity. Distances need one length, so where lengths differ those of the most frequent length
take part (of equally frequent ones the longest). Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Has the array only finite components, and one at least?"""
    infinite = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def usable(rows: DataFrame, vector: str = "vector") -> tuple[DataFrame, int]:
    """The rows that take part, and the length of their vectors; 0 if there are none."""
    kept = rows.filter(finite(F.col(vector)))
    lengths = kept.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max_by("width", F.struct("n", "width")).alias("width")).first()
    width = most.width or 0
    return kept.filter(F.size(vector) == width), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, in the type they are stored in."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width)


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 * c) of every component, as whole numbers.

    Components of 2**40 and more are refused: their squares leave exact arithmetic.
    """
    whole = np.floor(1024.0 * matrix(column, width).astype(np.float64))
    if whole.size and np.abs(whole).max() >= 2.0**50:
        raise ValueError("a component is 2**40 or more")
    return whole.astype(np.int64)
