"""Linear sketches: tables of counters that add up.

``count_sketch``, ``count_min``, ``k-ary`` and ``fagms`` share one build: explode the row number,
sum by cell. Map-side aggregation bounds the shuffle by tasks x rows x width, whatever the
number of keys. Point queries read the counters as one dense array per group,
broadcast while the size fixed by the spec allows it, joined by cell beyond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.hashing import (
    cell_text, coefficients_at, hash_fn, sign_text, with_hashes, with_lanes,
)
from tallyweave.functions.medians import median_of_columns, median_of_group
from tallyweave.operators.tasks import long_tasks
from tallyweave.spec import SketchSpec

# A dense array of counters is broadcast up to this many cells (8 bytes each).
BROADCAST_CELLS = 8_000_000


def is_text(df: DataFrame, key: str = "key") -> bool:
    return dict(df.dtypes)[key] == "string"


def row_list(spec: SketchSpec) -> str:
    """SQL text that repeats a row once per sketch row."""
    return f"explode(array({','.join(str(r) for r in range(spec.rows))})) AS row"


def row_functions(spec: SketchSpec, role: str) -> list:
    return [hash_fn(spec.seed, role, 0, r) for r in range(spec.rows)]


def with_row_hash(df: DataFrame, spec: SketchSpec, role: str) -> DataFrame:
    """One row per input row and sketch row: adds ``row`` and its hash ``h``."""
    spread = with_lanes(df, is_text(df)).selectExpr("*", row_list(spec))
    return with_hashes(spread, {"h": coefficients_at(row_functions(spec, role), "row")})


def _sum_cells(stream: DataFrame, spec: SketchSpec, by: Sequence[str], role: str, signed: bool) -> DataFrame:
    spread = with_row_hash(long_tasks(stream.select(*by, "key", "weight")), spec, role)
    value = f"{sign_text('h')} * weight" if signed else "weight"
    return (
        spread.selectExpr(*by, "row", f"{cell_text('h', spec.width)} AS idx", f"{value} AS v")
        .groupBy(*by, "row", "idx").agg(F.sum("v").alias("v")).filter("v != 0"))


def count_sketch_build(stream: DataFrame, spec: SketchSpec, by: Sequence[str] = (),
                       role: str = "count") -> DataFrame:
    """Signed counters ``(by..., row, idx, v)``; cells that cancel to zero are left out."""
    return _sum_cells(stream, spec, by, role, True)


def unsigned_build(stream: DataFrame, spec: SketchSpec, role: str,
                   by: Sequence[str] = ()) -> DataFrame:
    return _sum_cells(stream, spec, by, role, False)


def dense_counters(counters: DataFrame, width: int, rows: int) -> DataFrame:
    """One row holding all cells in order ``row * width + idx``, empty ones as 0."""
    cells = counters.selectExpr(f"row * {width}L + idx AS _cell", "v")
    zeros = counters.sparkSession.range(rows * width).selectExpr("id AS _cell", "0L AS v")
    full = cells.unionByName(zeros).groupBy("_cell").agg(F.sum("v").alias("v"))
    return full.agg(F.expr("array_sort(collect_list(struct(_cell, v))).v AS cells"))


def _fits(spec: SketchSpec) -> bool:
    return spec.rows * spec.width <= BROADCAST_CELLS


def _row_values(keys: DataFrame, counters: DataFrame, spec: SketchSpec, role: str, signed: bool,
                shared_row: bool = False) -> tuple[DataFrame, list[Column]]:
    """Keys beside what they see in each row of the broadcast dense counters."""
    hashed = with_hashes(with_lanes(keys, is_text(keys)), {
        f"_h{r}": fn.coefficients() for r, fn in enumerate(row_functions(spec, role))})
    table = dense_counters(counters, spec.width, 1 if shared_row else spec.rows).selectExpr("cells", "1 AS _one")
    values = []
    for r in range(spec.rows):
        v = f"get(cells, int({cell_text(f'_h{r}', spec.width)} + {0 if shared_row else r * spec.width}))"
        values.append(F.expr(f"{sign_text(f'_h{r}')} * {v}" if signed else v))
    return hashed.selectExpr("*", "1 AS _one").join(F.broadcast(table), "_one"), values


def _cells_by_join(keys: DataFrame, counters: DataFrame, spec: SketchSpec, role: str,
                   signed: bool) -> DataFrame:
    """``(key columns..., _value)`` once per row, for sketches too wide to broadcast."""
    probe = with_row_hash(keys, spec, role).selectExpr("*", f"{cell_text('h', spec.width)} AS idx")
    value = f"{sign_text('h')} * coalesce(v, 0)" if signed else "coalesce(v, 0)"
    return probe.join(counters.select("row", "idx", "v"), ["row", "idx"], "left").selectExpr(
        *keys.columns, f"{value} AS _value")


def per_key_by_join(keys: DataFrame, counters: DataFrame, spec: SketchSpec, role: str, signed: bool,
                    value: Column) -> DataFrame:
    """Adds ``est``, an aggregate of ``_value``: found once per key and joined back to every row."""
    cells = _cells_by_join(keys.select("key").distinct(), counters, spec, role, signed)
    found = cells.groupBy(F.col("key").alias("_key")).agg(value.alias("est"))
    return keys.join(found, keys["key"].eqNullSafe(found["_key"])).drop("_key")


def _least(values: Sequence[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def count_sketch_query(keys: DataFrame, counters: DataFrame, spec: SketchSpec,
                       role: str = "count") -> DataFrame:
    """Adds ``est``: the median over rows of the signed cell of each key."""
    if not _fits(spec):
        return per_key_by_join(keys, counters, spec, role, True, median_of_group(F.col("_value")))
    joined, values = _row_values(keys, counters, spec, role, True)
    return joined.select(*keys.columns, median_of_columns(values).alias("est"))


def count_sketch_f2(counters: DataFrame) -> DataFrame:
    """Second frequency moment: median over rows of the sum of squared counters."""
    squares = counters.groupBy("row").agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("s"))
    return squares.agg(median_of_group(F.col("s")).alias("f2"))


def sketch_merge(*tables: DataFrame, cells: Sequence[str] = ("row", "idx")) -> DataFrame:
    """Cell-wise sum of summaries built with the same spec."""
    merged = tables[0]
    for other in tables[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy(*cells).agg(F.sum("v").alias("v")).filter(F.col("v") != 0)


def count_min_build(stream: DataFrame, spec: SketchSpec, shared_row: bool = False) -> DataFrame:
    """Unsigned counters; ``shared_row`` puts all hash functions over one array."""
    built = unsigned_build(stream, spec, "min")
    if not shared_row:
        return built
    return built.groupBy(F.lit(0).alias("row"), "idx").agg(F.sum("v").alias("v"))


def count_min_query(keys: DataFrame, counters: DataFrame, spec: SketchSpec,
                    shared_row: bool = False) -> DataFrame:
    """Adds ``est``: the smallest cell of each key, never below its true count."""
    if not _fits(spec):
        if shared_row:
            counters = counters.selectExpr(row_list(spec), "idx", "v")
        return per_key_by_join(keys, counters, spec, "min", False, F.min("_value").cast("bigint"))
    joined, values = _row_values(keys, counters, spec, "min", False, shared_row)
    return joined.select(*keys.columns, _least(values).alias("est"))


def kary_build(stream: DataFrame, spec: SketchSpec) -> DataFrame:
    return unsigned_build(stream, spec, "kary")


def kary_query(keys: DataFrame, counters: DataFrame, spec: SketchSpec) -> DataFrame:
    """Adds ``est``: each cell corrected by the mean of its row, then the median over rows."""
    w = float(spec.width)
    total = counters.filter(F.col("row") == 0).agg(
        F.coalesce(F.sum("v"), F.lit(0)).alias("_total")).withColumn("_one", F.lit(1))
    correct = lambda v: (v.cast("double") - F.col("_total") / F.lit(w)) / F.lit(1.0 - 1.0 / w)
    if not _fits(spec):
        wide = per_key_by_join(keys, counters, spec, "kary", False, median_of_group(F.col("_value").cast("double")))
        return wide.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(
            *keys.columns, correct(F.col("est")).alias("est"))
    joined, values = _row_values(keys, counters, spec, "kary", False)
    return joined.join(F.broadcast(total), "_one").select(
        *keys.columns, median_of_columns([correct(v) for v in values]).alias("est"))


def kary_change(keys: DataFrame, before: DataFrame, after: DataFrame, spec: SketchSpec) -> DataFrame:
    """Estimated change of each key between two epochs built with the same spec.

    The estimate is linear in the counters, so the difference table is queried directly.
    """
    delta = sketch_merge(after, before.withColumn("v", -F.col("v")))
    return kary_query(keys, delta, spec)


def agms_build(stream: DataFrame, rows: int, width: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Every cell receives plus or minus each weight: ``(by..., row, idx, v)``.

    The number of cells is a small constant, so one aggregation holds a sum per cell and no
    row is multiplied.
    """
    # One 31-bit hash serves 30 cells, so the hash is computed once per 30 sums.
    n = rows * width
    hashed = with_hashes(with_lanes(stream.select(*by, "key", "weight"), is_text(stream)), {
        f"_h{j}": hash_fn(seed, "agms", 0, j).coefficients() for j in range((n + 29) // 30)})
    sums = hashed.groupBy(*by).agg(*[
        F.expr(f"coalesce(sum((1 - 2 * (shiftright(_h{c // 30}, {c % 30}) & 1)) * weight), 0)").alias(f"_c{c}")
        for c in range(n)])
    cells = F.posexplode(F.array(*[F.col(f"_c{c}") for c in range(n)]))
    return sums.select(*by, cells.alias("_cell", "v")).select(
        *by, F.floor(F.col("_cell") / width).cast("int").alias("row"),
        (F.col("_cell") % width).cast("bigint").alias("idx"), "v")


def agms_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join size: mean over all cells of the product of the two counters."""
    pair = a.join(b.withColumnRenamed("v", "v2"), ["row", "idx"])
    return pair.agg((F.sum(F.col("v").cast("double") * F.col("v2")) / F.count(F.lit(1))).alias("join_size"))


def fagms_build(stream: DataFrame, spec: SketchSpec, by: Sequence[str] = ()) -> DataFrame:
    return count_sketch_build(stream, spec, by, role="fagms")


def fagms_delete(counters: DataFrame, removed: DataFrame, spec: SketchSpec) -> DataFrame:
    """Take arrivals out again: the same build with negative weights."""
    negative = removed.withColumn("weight", -F.col("weight"))
    return sketch_merge(counters, fagms_build(negative, spec))


def fagms_query(keys: DataFrame, counters: DataFrame, spec: SketchSpec) -> DataFrame:
    return count_sketch_query(keys, counters, spec, role="fagms")


def row_products(a: DataFrame, b: DataFrame, rows: int, g=None) -> DataFrame:
    """Dot product of two counter tables per row, or the sum of ``g`` of the products of common cells; without any it is 0."""
    g = g or (lambda product: product)
    products = a.join(b.select("row", "idx", F.col("v").alias("v2")), ["row", "idx"]).select(
        "row", g(F.col("v").cast("double") * F.col("v2")).cast("double").alias("p"))
    zeros = a.sparkSession.range(rows).select(F.col("id").cast("int").alias("row"), F.lit(0.0).alias("p"))
    return products.unionByName(zeros).groupBy("row").agg(F.sum("p").alias("p"))


def fagms_join(a: DataFrame, b: DataFrame, spec: SketchSpec) -> DataFrame:
    """Join size: median over rows of the dot product of the counters."""
    return row_products(a, b, spec.rows).agg(median_of_group(F.col("p")).alias("join_size"))


def counter_gsum(counters: DataFrame, g, rows: int) -> DataFrame:
    """``g`` over the raw counters of each row, median over rows.

    Meaningful for ``g(x) = x^2`` only: a counter mixes several keys and has a sign.
    """
    zeros = counters.sparkSession.range(rows).select(F.col("id").cast("int").alias("row"), F.lit(0.0).alias("s"))
    sums = counters.select("row", g(F.col("v")).alias("s")).unionByName(zeros).groupBy("row").agg(
        F.sum("s").alias("s"))
    return sums.agg(median_of_group(F.col("s")).alias("gsum"))


def linear_counting(counters: DataFrame, spec: SketchSpec) -> DataFrame:
    """Distinct keys from the share of empty cells, smallest row; a full row counts one empty."""
    w = float(spec.width)
    used = counters.groupBy("row").agg(F.count(F.lit(1)).alias("used"))
    zeros = counters.sparkSession.range(spec.rows).select(
        F.col("id").cast("int").alias("row"), F.lit(0).cast("bigint").alias("used"))
    empty = F.greatest(F.lit(1.0), F.lit(w) - F.col("used"))
    return used.unionByName(zeros).groupBy("row").agg(F.sum("used").alias("used")).agg(
        F.min(F.lit(w) * F.log(F.lit(w) / empty)).alias("cardinality"))


def sketch_size(counters: DataFrame, spec: SketchSpec) -> DataFrame:
    """Cells, bytes and fill level of a counter table."""
    total = spec.rows * spec.width
    return counters.agg(
        F.lit(total).cast("bigint").alias("cells"),
        F.lit(total * 4).cast("bigint").alias("bytes"),
        F.count(F.lit(1)).alias("used"),
        (F.count(F.lit(1)) / F.lit(float(total))).alias("fill"),
    )
