"""Sums that don't overflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_sum(df: DataFrame, column: str) -> DataFrame:
    """``total`` of a whole-number column as a 38-digit decimal; 0 without rows."""
    total = F.sum(F.col(column).cast("decimal(20,0)")).cast("decimal(38,0)")
    return df.agg(F.coalesce(total, F.lit(0).cast("decimal(38,0)")).alias("total"))
