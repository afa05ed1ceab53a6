"""The percentile definitions that occur; they differ and are never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(column: str, p: float) -> Column:
    """sorted[ceil(p * n) - 1]"""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def middle(column: str) -> Column:
    """Median, the mean of the two middle values of an even number."""
    return F.median(column)


def interpolated(column: str, p: float) -> Column:
    """Linear interpolation at (n - 1) * p"""
    return F.percentile(column, p)


def floor_index(column: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(n * p))]; for groups of results, not of raw rows."""
    values = F.array_sort(F.collect_list(column))
    return F.get(values, F.least(F.size(values) - 1, F.floor(F.size(values) * F.lit(p)).cast("int")))


def upper_middle(column: Column) -> Column:
    """sorted[n / 2]"""
    values = F.array_sort(F.collect_list(column))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))
