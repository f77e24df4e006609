"""Tables of vectors, as the searches of this package read them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """``vec_id`` and ``vector``, an array of doubles, one row per id.

    Rows go whose id or vector is null, or whose vector holds a null or a
    component that is not finite; with ``nonzero`` also those of zeros alone. Of
    rows with one id the smallest vector stays.
    """
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept: Column = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite
    if nonzero:
        kept = kept & F.exists("vector", lambda x: x != 0)
    slim = df.select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector")).where(kept)
    return slim.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def as_matrix(column: pd.Series, width: int, dtype: type = np.float64) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros at their end."""
    lengths = np.fromiter(map(len, column), np.int64, len(column))
    if len(column) and (lengths == width).all():
        return np.stack(column.to_list()).astype(dtype, copy=False)
    out = np.zeros((len(column), width), dtype)
    for row, vector in zip(out, column):
        row[:len(vector)] = vector
    return out
