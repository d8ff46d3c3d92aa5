"""Float vectors as vectors of integers, for the operators that compute with exact sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are below this in size after scaling, so that squared distances of up to 2**6 of them stay below 2**63.
LARGEST = 1 << 27


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as array<int>; null for what is not sound."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).try_cast("int"))


def sound(vector: Column, scale: int) -> Column:
    """True where no component is null, NaN, infinite, or LARGEST or more in size once scaled; false for null vectors."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * scale >= LARGEST))
    return F.coalesce(~odd, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of integers as int64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def kept(table: DataFrame, id_col: str, vector_col: str, scale: int, label_col: str | None = None) -> DataFrame:
    """(id, v, label): the rows with a sound vector; label is null without label_col."""
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), label.alias("label"))
    return rows.where(sound(F.col("v"), scale) & (F.size("v") > 0)).select("id", whole(F.col("v"), scale).alias("v"), "label")
