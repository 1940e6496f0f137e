"""Weight functions ``g``: Column -> Column, applied to frequencies.

The single-argument forms answer zero for negative input. The ``pos_*`` forms are the strict
ones used for two streams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def g_cardinality(x: Column) -> Column:
    return F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def g_sum(x: Column) -> Column:
    return F.when(x >= 0, x.cast("double")).otherwise(F.lit(0.0))


def g_entropy(x: Column) -> Column:
    return F.when(x > 0, x.cast("double") * F.log2(x.cast("double"))).otherwise(F.lit(0.0))


def g_sqr(x: Column) -> Column:
    return F.when(x >= 0, x.cast("double") * x.cast("double")).otherwise(F.lit(0.0))


def g1_one(x: Column) -> Column:
    return g_cardinality(x)


def g1_sum(x: Column) -> Column:
    return F.when(x > 0, x.cast("double")).otherwise(F.lit(0.0))


def g1_sqr(x: Column) -> Column:
    return F.when(x > 0, x.cast("double") * x.cast("double")).otherwise(F.lit(0.0))


def g2_mul(x: Column, y: Column) -> Column:
    return F.when((x > 0) & (y > 0), x.cast("double") * y.cast("double")).otherwise(F.lit(0.0))


WEIGHTS = {
    "cardinality": g_cardinality,
    "sum": g_sum,
    "entropy": g_entropy,
    "sqr": g_sqr,
}
