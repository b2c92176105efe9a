"""What the operators on embeddings share: rows that take part, and their integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are; false rather than null."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def integer_vectors(rows: DataFrame, vector: str, scale: int = 256) -> tuple[DataFrame, int, int]:
    """Rows with ``x`` (array<bigint>) in place of the vector: floor(scale * c) of each entry c as double.

    Also the number of dimensions, that of the longest vector (shorter ones have zeros at their end), and the largest
    magnitude of an entry. Entries of 2^40 and more raise an error: sums over all rows couldn't be exact.
    """
    named = rows.where(finite(F.col(vector)))
    named = named.withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))))
    most = F.array_max(F.transform("x", F.abs))
    size, largest = named.agg(F.max(F.size("x")), F.max(most)).first()
    size, largest = size or 0, largest or 0
    if largest >= 1 << 40:
        raise ValueError("entries of vectors must stay below 2^40 when scaled")
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size("x"))
    padded = F.when(F.size("x") < size, F.concat("x", zeros)).otherwise(F.col("x"))
    return named.withColumn("x", padded).drop(*([] if vector == "x" else [vector])), size, largest


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of long integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), size)
