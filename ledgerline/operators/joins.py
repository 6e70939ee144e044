"""Join helpers: size-checked broadcast of dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension is broadcast only when the statistics of its plan (file sizes, for a
# scan; products of them, for a join) prove that it has at most this many bytes.
DIM_MAX_BYTES = 32 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of ``df``, from the bytes of the files behind it; runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_bounded(df: DataFrame, max_bytes: int = DIM_MAX_BYTES) -> bool:
    """True when the optimizer's size is small.

    Packed columns can be some times larger in memory, which the limit allows for.
    """
    return plan_bytes(df) <= max_bytes


def dim(df: DataFrame, max_bytes: int = DIM_MAX_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its size is proven small, else unchanged
    (Spark then uses a shuffle join, and AQE may still broadcast at runtime)."""
    return F.broadcast(df) if is_bounded(df, max_bytes) else df


def active(df: DataFrame) -> DataFrame:
    """Soft-delete filter ``delete_flag = 0`` (NULL flags excluded)."""
    return df.where(F.col("delete_flag") == 0)
