"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null or empty, every component a finite number, and not all of them zero."""
    column = F.col(vector)

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    # exists() first looks at components that are null or not finite, so the zero test sees numbers only
    return F.coalesce(
        column.isNotNull() & F.forall(column, finite) & F.exists(column, lambda x: F.coalesce(x != 0, F.lit(False))),
        F.lit(False),
    )


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so squares stay in range."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def fixed_sample(vectors: DataFrame, column: str, most_rows: int, most_bytes: int = 16 << 20) -> tuple[int, np.ndarray]:
    """The commonest vector length, and the vectors of that length with the smallest hashes.

    At most ``most_rows`` vectors and ``most_bytes`` reach the driver, however large the table.
    """
    size = F.size(column)
    first = vectors.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if first is None:
        return 0, np.empty((0, 0))
    rows = max(1, min(most_rows, most_bytes // (8 * first["size"])))
    chosen = (
        vectors.filter(size == first["size"])
        .orderBy(F.xxhash64(column))
        .limit(rows)
        .select(F.col(column).cast("array<double>").alias("v"))
    )
    return first["size"], np.array([row.v for row in chosen.collect()], dtype=np.float64)
