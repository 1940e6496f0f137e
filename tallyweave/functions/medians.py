"""Median of a short, fixed number of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def median_of_array(values: Column, n: int) -> Column:
    """Middle of ``n`` values; an even count gives the mean of the two middle ones."""
    ordered = F.sort_array(values)
    if n % 2:
        return F.get(ordered, F.lit(n // 2)).cast("double")
    return (F.get(ordered, F.lit(n // 2 - 1)) + F.get(ordered, F.lit(n // 2))).cast("double") / F.lit(2.0)


def median_of_columns(values: Sequence[Column]) -> Column:
    return median_of_array(F.array(*values), len(values)) if len(values) > 1 else values[0].cast("double")


def median_of_group(value: Column) -> Column:
    """Aggregate form, for groups whose size is the number of sketch rows (at most 16)."""
    ordered = F.sort_array(F.collect_list(value))
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high).cast("double") / F.lit(2.0)
