"""Vector columns: which rows take part, and their numbers as arrays within a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: str | Column) -> Column:
    """Whether a vector is there, has entries, and none is null, NaN or infinite."""
    c = F.col(vector) if isinstance(vector, str) else vector
    sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) > 0) & sound, F.lit(False))


def dimension(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, the larger one of a tie; 0 for an empty table."""
    lengths = rows.groupBy(F.size(vector).alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return most[0]["length"] if most else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column, one a row, as doubles; all have ``dim`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
