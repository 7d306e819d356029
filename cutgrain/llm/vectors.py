"""What both vector operators need: checked rows, and blocks of rows as matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: str) -> Column:
    """Whether a vector is not null or zero and holds no null or non-finite component; never null."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0.0), F.lit(False))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector, as array<double>."""
    return rows.where(is_usable(vector)).withColumn(vector, F.col(vector).cast("array<double>"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, without overflow or underflow on the way."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
