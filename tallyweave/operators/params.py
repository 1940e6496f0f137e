"""Sizes of a memory sweep as columns: the table form of ``sketch_params_from_memory``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.spec import BUCKET_BYTES, COUNTER_BYTES, LEVELS


def sketch_params_table(budgets: DataFrame, heavy_ratio: float = 0.6, rows: int = 5,
                        counter_ratio: float = 0.9, levels: int = LEVELS) -> DataFrame:
    """Adds ``buckets``, ``width`` and ``capacity`` to every memory budget ``mem`` (bytes)."""
    whole = lambda c: c.cast("bigint")
    div = lambda c, n: F.floor(c / F.lit(n)).cast("bigint")
    mem = F.col("mem")
    level = div(whole(mem * F.lit(1 - heavy_ratio)), levels)
    return budgets.select(
        *budgets.columns, div(whole(mem * F.lit(heavy_ratio)), BUCKET_BYTES).alias("buckets"),
        F.greatest(F.lit(1), div(div(whole(level * F.lit(counter_ratio)), COUNTER_BYTES), rows)).alias("width"),
        F.greatest(F.lit(1), div(whole(level * F.lit(1 - counter_ratio)), COUNTER_BYTES)).alias("capacity"))
