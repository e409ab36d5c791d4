"""Small list helpers used by the quality and bank operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_mean(arr: Column) -> Column:
    """Mean of a numeric list; NULL for an empty or NULL list."""
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(arr).cast("double"))


def array_except_value(arr: Column, value: Column) -> Column:
    """Elements different from ``value``, order and duplicates kept
    (``array_except`` would de-duplicate)."""
    return F.filter(arr, lambda o: o != value)


def zip_positional(a: Column, b: Column) -> Column:
    """Element-wise pairs truncated to the shorter list, like Python's zip()."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, n)
