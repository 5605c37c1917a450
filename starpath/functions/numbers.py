"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(text: Column) -> Column:
    """Text as a whole number, null where it is none."""
    return text.try_cast("bigint")


def decimal_number(text: Column) -> Column:
    """Text as a finite double, null where it is none; Java's suffixes (``1.5d``), NaN and Infinity are no numbers."""
    return F.when(~text.rlike(r"(?i)[df]\s*$|nan|inf"), text.try_cast("double"))


def dot(left: Column, right: Column) -> Column:
    """Inner product of two whole arrays; null where their lengths differ."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda total, product: total + product)
    return F.when(F.size(left) == F.size(right), total)


def squared_error(predicted: Column, actual: Column) -> Column:
    return (predicted - actual) * (predicted - actual)


def percent_improvement(baseline: Column, value: Column) -> Column:
    return F.try_divide(baseline - value, baseline) * F.lit(100.0)
