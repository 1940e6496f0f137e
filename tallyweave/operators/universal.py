"""Universal sketch: nested key samples, a Count-Sketch and a candidate list per level.

Level 0 sees every key; a key reaches level i with probability 2^-i. The summary is two
tables, ``counters(level, row, idx, v)`` and ``candidates(level, key, v)``; any weighted sum
``sum g(f)`` is one aggregation over the candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.hashing import (
    LANES, cell_text, coefficients_at, depth_text, hash_fn, sign_text, with_hashes, with_lanes,
)
from tallyweave.functions.medians import median_of_columns, median_of_group
from tallyweave.functions.weights import g_cardinality, g_entropy
from tallyweave.operators.exact import top_per_group
from tallyweave.operators.frequent import frequent_per_partition
from tallyweave.operators.linear import BROADCAST_CELLS, is_text, row_list, sketch_merge
from tallyweave.operators.tasks import long_tasks
from tallyweave.spec import SketchSpec

G = Callable[[Column], Column]
CELL = ("level", "row", "idx")
# Longest list of frequent keys that a task keeps for one level.
LISTED_KEYS = 1 << 16


def with_depth(df: DataFrame, spec: SketchSpec) -> DataFrame:
    """Adds ``_depth``, the deepest level of ``key`` (it lives in levels 0 to this one), and its lanes."""
    hashed = with_hashes(with_lanes(df, is_text(df)), {"_d": hash_fn(spec.seed, "depth").coefficients()})
    return hashed.selectExpr(*[f"`{c}`" for c in df.columns], *LANES, f"{depth_text('_d', spec.levels)} AS _depth")


def sampled_levels(df: DataFrame, spec: SketchSpec) -> DataFrame:
    """One row per key and level it is sampled into (two per key on average)."""
    return with_depth(df, spec).selectExpr("*", "explode(sequence(0, _depth)) AS level").drop("_depth")


def _with_level_row_hash(df: DataFrame, spec: SketchSpec) -> DataFrame:
    """Adds ``row`` (one output row each) and the hash ``h`` of the columns ``level``, ``row``."""
    fns = [hash_fn(spec.seed, "univ", level, row) for level in range(spec.levels) for row in range(spec.rows)]
    spread = df.selectExpr("*", row_list(spec))
    return with_hashes(spread, {"h": coefficients_at(fns, f"level * {spec.rows} + row")})


def universal_build(stream: DataFrame, spec: SketchSpec, by: Sequence[str] = ()) -> DataFrame:
    """Counters ``(by..., level, row, idx, v)`` of a stream or of key counts.

    No key shuffle: rows are spread to their cells inside the input partition and summed
    there first, so the shuffle is bounded by tasks x cells.
    """
    arrivals = long_tasks(stream.select(*by, "key", "weight"))
    spread = _with_level_row_hash(sampled_levels(arrivals, spec), spec)
    return (
        spread.selectExpr(*by, "level", "row", f"{cell_text('h', spec.width)} AS idx", f"{sign_text('h')} * weight AS v")
        .groupBy(*by, "level", "row", "idx").agg(F.sum("v").alias("v")).filter("v != 0"))


def universal_merge(*counters: DataFrame) -> DataFrame:
    return sketch_merge(*counters, cells=CELL)


def _dense_levels(counters: DataFrame, spec: SketchSpec, levels: int) -> DataFrame:
    """For each of the first ``levels``, all cells as one array (``rows * width`` values)."""
    size = spec.rows * spec.width
    zeros = counters.sparkSession.range(levels * size).selectExpr(
        f"int(id div {size}) AS level", f"id % {size} AS _cell", "0L AS v")
    cells = counters.selectExpr("level", f"row * {spec.width}L + idx AS _cell", "v")
    full = cells.unionByName(zeros).groupBy("level", "_cell").agg(F.sum("v").alias("v"))
    return full.groupBy("level").agg(F.expr("array_sort(collect_list(struct(_cell, v))).v AS cells"))


def universal_estimates(pairs: DataFrame, counters: DataFrame, spec: SketchSpec,
                        levels: int | None = None) -> DataFrame:
    """Adds ``est`` to ``(level, key, ...)`` rows: median of the signed cells of that level.

    ``levels`` says that only that many levels are asked for.
    """
    levels = levels or spec.levels
    wide = levels * spec.rows * spec.width > BROADCAST_CELLS
    keyed = with_lanes(pairs.select("level", "key").distinct() if wide else pairs, is_text(pairs))
    if wide:
        probe = _with_level_row_hash(keyed, spec).selectExpr("*", f"{cell_text('h', spec.width)} AS idx")
        found = probe.join(counters.select(*CELL, F.col("v").alias("_v")), list(CELL), "left").groupBy(
            F.col("level").alias("_level"), F.col("key").alias("_key")).agg(
            median_of_group(F.expr(f"{sign_text('h')} * coalesce(_v, 0)")).alias("est"))
        same = pairs["key"].eqNullSafe(found["_key"]) & (pairs["level"] == found["_level"])
        return pairs.join(found, same).drop("_level", "_key")
    hashed = with_hashes(keyed, {
        f"_h{row}": coefficients_at([hash_fn(spec.seed, "univ", level, row) for level in range(levels)], "level")
        for row in range(spec.rows)})
    values = [
        F.expr(f"{sign_text(f'_h{row}')} * get(cells, int({cell_text(f'_h{row}', spec.width)} + {row * spec.width}))")
        for row in range(spec.rows)]
    joined = hashed.join(F.broadcast(_dense_levels(counters, spec, levels)), "level")
    return joined.select(*pairs.columns, median_of_columns(values).alias("est"))


def universal_candidates(counts: DataFrame, spec: SketchSpec, mode: str = "tracked",
                         counters: DataFrame | None = None) -> DataFrame:
    """The ``capacity`` largest keys of each level, or all keys where it is None: ``(level, key, v)``.

    ``tracked`` ranks by exact counts. ``estimated`` ranks the distinct keys by
    ``max(1, estimate)`` from the counters, so it needs no exact count.
    """
    if mode == "tracked":
        sampled = sampled_levels(counts.select("key", F.col("f").alias("v")), spec).select("level", "key", "v")
    elif mode == "estimated":
        pairs = sampled_levels(counts.select("key"), spec).select("level", "key")
        estimates = universal_estimates(pairs, counters, spec)
        sampled = estimates.select(
            "level", "key", F.greatest(F.lit(1), F.floor("est")).cast("bigint").alias("v"))
    else:
        raise ValueError(f"unknown candidate mode {mode!r}")
    return cut_candidates(sampled, spec, "v" if mode == "tracked" else None)


def cut_candidates(sampled: DataFrame, spec: SketchSpec, value: str | None = None) -> DataFrame:
    """``value`` names a cheap exact count, to drop most keys before any sort.

    Without a capacity every key stays, and nothing is ranked.
    """
    if spec.capacity is None:
        return sampled.select("level", "key", "v")
    top = top_per_group(sampled, ["level"], [F.desc("v"), F.col("key")], spec.capacity, ["key"],
                        value=value, groups=spec.levels)
    return top.select("level", "key", "v")


def local_candidates(stream: DataFrame, spec: SketchSpec, share: int = 2) -> DataFrame:
    """Candidate pairs without a key shuffle: the heaviest local keys of every partition.

    Each task keeps at most ``share * capacity`` keys per level; the union is bounded by
    partitions x levels x that number and is re-estimated from the merged counters. Lists of more than
    ``LISTED_KEYS`` would fill a task; there all keys are candidates, told apart by Spark, which can spill them.
    """
    sampled = sampled_levels(long_tasks(stream.select("key", "weight")), spec)
    if spec.capacity is None or share * spec.capacity > LISTED_KEYS:
        return sampled.select("level", "key").distinct()
    return frequent_per_partition(sampled, ["level"], share * spec.capacity).select("level", "key").distinct()


def bounded_candidates(stream: DataFrame, counters: DataFrame, spec: SketchSpec) -> DataFrame:
    """Candidates of a stream too wide for exact counts: local lists, then re-estimated."""
    estimates = universal_estimates(local_candidates(stream, spec), counters, spec)
    sampled = estimates.select(
        "level", "key", F.greatest(F.lit(1), F.floor("est")).cast("bigint").alias("v"))
    return cut_candidates(sampled, spec)


def universal_topk(candidates: DataFrame) -> DataFrame:
    """Candidates with their rank inside the level, heaviest first."""
    from pyspark.sql import Window

    order = Window.partitionBy("level").orderBy(F.desc("v"), F.col("key"))
    return candidates.withColumn("rank", F.row_number().over(order))


def level_weight(spec: SketchSpec) -> Column:
    """Coefficient of a candidate in the closed form of the recursive estimator.

    A key living in levels 0..m contributes 2^m - (2^(m-1) + ... + 1) = 1 in total.
    """
    return F.expr(f"pow(2.0D, level) * CASE WHEN level < {spec.levels - 1} AND _depth > level THEN -1 ELSE 1 END")


def universal_gsum(candidates: DataFrame, spec: SketchSpec, g: G, value: str = "v",
                   by: Sequence[str] = ()) -> DataFrame:
    """``sum g(f)`` estimated from the candidates, as one aggregation.

    Summed over the histogram of values, where the coefficients are whole numbers and add up without rounding.
    """
    terms = with_depth(candidates, spec).select(*by, F.col(value).alias("_v"), level_weight(spec).alias("_w"))
    sizes = terms.groupBy(*by, "_v").agg(F.sum("_w").alias("_w"))
    return sizes.groupBy(*by).agg(F.coalesce(F.sum(g(F.col("_v")) * F.col("_w")), F.lit(0.0)).alias("gsum"))


def universal_gsum_subset(candidates: DataFrame, spec: SketchSpec, g: G, check: G) -> DataFrame:
    return universal_gsum(candidates.filter(check(F.col("key"))), spec, g)


def universal_cardinality(candidates: DataFrame, spec: SketchSpec) -> DataFrame:
    return universal_gsum(candidates, spec, g_cardinality).withColumnRenamed("gsum", "cardinality")


def universal_entropy(candidates: DataFrame, spec: SketchSpec, total: DataFrame) -> DataFrame:
    """Entropy in bits; ``total`` is one row with the stream weight ``packets``."""
    one = total.select(F.col("packets").cast("double").alias("_n")).withColumn("_one", F.lit(1))
    return universal_gsum(candidates, spec, g_entropy).withColumn("_one", F.lit(1)).join(
        F.broadcast(one), "_one").select((F.log2("_n") - F.col("gsum") / F.col("_n")).alias("entropy"))


def universal_heavy_hitters(candidates: DataFrame, threshold: int) -> DataFrame:
    """Keys whose largest value over the levels reaches the threshold."""
    return candidates.groupBy("key").agg(F.max("v").alias("v")).filter(F.col("v") >= threshold)


def universal_query(keys: DataFrame, counters: DataFrame, spec: SketchSpec) -> DataFrame:
    """Adds ``est``: the level-0 point estimate, floored at 0."""
    pairs = keys.withColumn("level", F.lit(0))
    estimates = universal_estimates(pairs, counters.filter(F.col("level") == 0), spec, levels=1)
    return estimates.withColumn("est", F.greatest(F.lit(0.0), F.col("est"))).select(*keys.columns, "est")


def heap_heavy_hitters(candidates: DataFrame, level: int, threshold: int) -> DataFrame:
    return candidates.filter((F.col("level") == level) & (F.col("v") >= threshold)).select("key", "v")


def level_f2(counters: DataFrame, level: int, rows: int) -> DataFrame:
    one = counters.filter(F.col("level") == level)
    squares = one.groupBy("row").agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("s"))
    return squares.agg(median_of_group(F.col("s")).alias("f2"))


def l2_heavy_hitters(candidates: DataFrame, counters: DataFrame, spec: SketchSpec, alpha: float,
                     level: int = 0) -> DataFrame:
    """Candidates of a level with ``v^2 >= alpha * F2``."""
    f2 = level_f2(counters, level, spec.rows).withColumn("_one", F.lit(1))
    square = F.col("v").cast("double") * F.col("v").cast("double")
    return candidates.filter(F.col("level") == level).withColumn("_one", F.lit(1)).join(
        F.broadcast(f2), "_one").filter(square >= F.lit(alpha) * F.col("f2")).select("key", "v")


def sum_candidates(cand_a: DataFrame, counters_a: DataFrame, cand_b: DataFrame,
                   counters_b: DataFrame, spec: SketchSpec) -> DataFrame:
    """Candidates of either stream, valued by the merged counters: ``(level, key, v)``."""
    pairs = cand_a.select("level", "key").union(cand_b.select("level", "key")).distinct()
    merged = universal_merge(counters_a, counters_b)
    return universal_estimates(pairs, merged, spec).withColumnRenamed("est", "v")


def product_candidates(cand_a: DataFrame, cand_b: DataFrame) -> DataFrame:
    """Keys present in both lists of a level, valued by the product: ``(level, key, v)``."""
    other = cand_b.select("level", "key", F.col("v").alias("v2"))
    return cand_a.join(other, ["level", "key"]).select(
        "level", "key", (F.col("v").cast("double") * F.col("v2")).alias("v")).filter(F.col("v") > 0)


def universal_gsum_add(cand_a, counters_a, cand_b, counters_b, spec: SketchSpec, g: G) -> DataFrame:
    """``sum g(fA + fB)``."""
    return universal_gsum(sum_candidates(cand_a, counters_a, cand_b, counters_b, spec), spec, g)


def universal_gsum_mul(cand_a: DataFrame, cand_b: DataFrame, spec: SketchSpec, g: G) -> DataFrame:
    """``sum g(fA * fB)``."""
    return universal_gsum(product_candidates(cand_a, cand_b), spec, g)
