"""Count-Min with 8-bit counters that merge with their buddy when they overflow.

Counts only grow, so the final layout depends on the totals alone: a block of size s (1, 2
or 4 cells) whose total reaches 2^(8s) joins its aligned buddy. Four neighbouring cells decide
everything, hence one grouped sum per aligned group of four and plain column expressions.
A block whose buddy would lie beyond the row stays as it is and keeps its whole
total, as does a block of four, so that no estimate is below the truth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.linear import (
    BROADCAST_CELLS, per_key_by_join, _least, _row_values, linear_counting, unsigned_build,
)
from tallyweave.spec import SketchSpec

ROLE = "salsa"


def salsa_build(stream: DataFrame, spec: SketchSpec) -> DataFrame:
    """``(row, idx, start, size, v)``: for every non-zero cell, the block holding it."""
    return salsa_blocks(unsigned_build(stream, spec, ROLE), F.lit(spec.width))


def salsa_blocks(cells: DataFrame, width: Column, by: Sequence[str] = ()) -> DataFrame:
    """Blocks of the sums ``(by..., row, idx, v)``."""
    quad = F.floor(F.col("idx") / F.lit(4)).cast("bigint")
    part = lambda j: F.sum(F.when(F.col("idx") % 4 == j, F.col("v")).otherwise(F.lit(0)))
    four = cells.groupBy(*by, "row", quad.alias("quad")).agg(*[part(j).alias(f"c{j}") for j in range(4)])

    first = F.col("quad") * F.lit(4)
    c = [F.col(f"c{j}") for j in range(4)]
    low, high = c[0] + c[1], c[2] + c[3]
    pair_low = (F.greatest(c[0], c[1]) >= 2**8) & (first + 1 < width)
    pair_high = (F.greatest(c[2], c[3]) >= 2**8) & (first + 3 < width)
    whole = ((pair_low & (low >= 2**16)) | (pair_high & (high >= 2**16))) & (first + 3 < width)

    def block(j: int):
        pair, total = (pair_low, low) if j < 2 else (pair_high, high)
        size = F.when(F.col("whole"), F.lit(4)).when(pair, F.lit(2)).otherwise(F.lit(1))
        value = F.when(F.col("whole"), low + high).when(pair, total).otherwise(c[j])
        begin = F.when(F.col("whole"), first).when(pair, first + (0 if j < 2 else 2)).otherwise(first + j)
        return F.struct((first + j).alias("idx"), begin.alias("start"), size.alias("size"), value.alias("v"))

    return (
        four.withColumn("whole", whole)
        .select(*by, "row", F.explode(F.array(*[block(j) for j in range(4)])).alias("b"))
        .select(*by, "row", "b.idx", "b.start", "b.size", "b.v")
        .filter(F.col("v") > 0)
    )


def salsa_query(keys: DataFrame, blocks: DataFrame, spec: SketchSpec) -> DataFrame:
    """Adds ``est``: the smallest block value of each key."""
    if spec.rows * spec.width > BROADCAST_CELLS:
        return per_key_by_join(keys, blocks, spec, ROLE, False, F.min("_value").cast("bigint"))
    joined, values = _row_values(keys, blocks, spec, ROLE, False)
    return joined.select(*keys.columns, _least(values).alias("est"))


def salsa_cardinality(blocks: DataFrame, spec: SketchSpec) -> DataFrame:
    return linear_counting(blocks, spec)
