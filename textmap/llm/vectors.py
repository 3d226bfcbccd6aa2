"""Vectors of a table, ready for cosine work in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.session import stage

VECTORS = "row long, vec_id long, vector array<double>"


def usable(embeddings: DataFrame, name: str, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, int]:
    """All rows (row, vec_id), the rows with usable vectors (row, vec_id, vector), and the vectors' length.

    A vector is usable if it is not null, holds only finite numbers, not all zero, and has the commonest
    length of such vectors (the shorter one on a tie).
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")
    )
    rows = stage(rows, f"{name}-rows")
    top = F.lit(float(np.finfo(np.float64).max))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= top)) & F.exists(
        "vector", lambda x: x != F.lit(0.0)
    )
    whole = rows.where(F.col("vector").isNotNull() & F.coalesce(good, F.lit(False)))
    lengths = whole.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.col("n").desc(), "length").first()
    length = common["length"] if common else 0
    return rows.select("row", "vec_id"), whole.where(F.size("vector") == length), length


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest part first, so that no square overflows."""
    if not vectors.size:
        return vectors
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
