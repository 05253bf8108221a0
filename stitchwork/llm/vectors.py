"""Integer vectors and sums of them, shared by the operators on embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.llm.common import met, settle, ship


def is_finite(vector: str) -> Column:
    """True for a vector that is there and holds no null, NaN or infinite component."""
    whole = F.forall(F.col(vector).cast("array<double>"), lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    return F.coalesce(whole, F.lit(False))


def bound_of(size: int) -> int:
    """The largest component for which the squared distance of two vectors of this size fits in 64 bits."""
    return math.isqrt(2**62 // max(size, 1)) // 2


def integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x) as 64-bit integers; what lies beyond ``bound_of(size)`` is held at that bound."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    bound = bound_of(size)
    return np.clip(np.floor(flat * scale), -bound, bound).astype(np.int64)


def totals(partial: DataFrame, keys: list[str]) -> list:
    """Sums of ``total`` and ``n`` by key: as many rows as the model has numbers, whatever the table's size."""
    return partial.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def with_sums(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows of equal ``key`` (nulls together).

    Sums are made on the map side first. A sum beyond 64 bits is null.
    """
    sums = df.groupBy(key).agg(F.sum(F.col(value).cast("decimal(38,0)")).try_cast("long").alias(name), F.count("*").alias("_n"))
    return met(df, settle(sums), key, "_n")


ship(__name__)
