"""Heavy buckets over one row of 8-bit saturating counters.

What leaves the heavy part updates one light cell per key: an arrival passed on and a flagged
eviction are added, an unflagged eviction raises the cell to its count. Both updates have the
form ``x -> max(x + a, m)``, which composes, so the light part needs no sequential replay: each
block of arrivals is reduced to one (a, m) per cell, and the blocks are combined in order.

A stream of several shards gives one summary: residents are added per key, each bucket keeps its
largest ones, and the counts of the others are added to their light cells. An unflagged eviction raises
its cell in the first shard only; in a later one earlier arrivals of the key may lie in the cell, so it adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_bucket
from tallyweave.operators.heavy import heavy_fold, heavy_table, merge_shards
from tallyweave.operators.linear import is_text
from tallyweave.spec import SHARD_ROWS, SketchSpec

G = Callable[[Column], Column]
# Usable slots of a bucket (the eighth holds the guard), and the largest value of a one-byte
# counter, for callers who ask for that limit.
ELASTIC_SLOTS = 7
LIGHT_MAX = 255


def light_cell(spec: SketchSpec, text: bool) -> Column:
    return hash_bucket(F.col("key"), spec.seed, spec.width, role="light", text=text)


def elastic_fold(stream: DataFrame, spec: SketchSpec, shard_rows: int | None = None) -> DataFrame:
    return heavy_fold(stream, spec.with_sizes(slots=ELASTIC_SLOTS), "elastic", shard_rows)


def elastic_tables(folded: DataFrame, spec: SketchSpec, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(heavy, light)`` of a fold, however many shards it has."""
    return elastic_heavy(folded, spec), elastic_light(folded, spec, limit=limit)


def elastic_heavy(folded: DataFrame, spec: SketchSpec) -> DataFrame:
    """Residents ``(bucket, key, v, flag)``, one row per key and at most seven a bucket.

    A key that is not resident in every shard is flagged, as the rest of it is in the light part.
    """
    return merge_shards(folded, spec.with_sizes(slots=ELASTIC_SLOTS))[0]


def elastic_light(folded: DataFrame, spec: SketchSpec, block: int | None = None, limit: int | None = None) -> DataFrame:
    """Light counters ``(idx, v)`` from what a fold has passed on, evicted, and found too small to keep.

    Values stop at ``limit`` where one is given.
    """
    capped = (lambda v: F.least(v, F.lit(limit))) if limit else (lambda v: v)
    zero = F.lit(0).cast("bigint")
    cell = light_cell(spec, is_text(folded)).alias("idx")
    first = folded.agg(F.min("shard").alias("s")).scalar()
    raises = (F.col("kind") == "evict") & ~F.col("flag") & (F.col("shard") == F.col("_first"))
    moves = folded.filter(F.col("kind") != "heavy").withColumn("_first", first).select(
        cell, "seq", F.floor(F.col("seq") / F.lit(block or spec.shard_rows or SHARD_ROWS)).alias("block"),
        F.when(raises, zero).otherwise(F.col("f")).alias("a"),
        F.when(raises, capped(F.col("f"))).otherwise(zero).alias("m"))
    # Inside a block: what each raise is worth at the end of the block.
    after = Window.partitionBy("idx", "block").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        moves.withColumn("after", F.coalesce(F.sum("a").over(after), zero))
        .groupBy("idx", "block")
        .agg(F.sum("a").alias("a"),
             F.max(F.when(F.col("m") > 0, F.col("m") + F.col("after")).otherwise(zero)).alias("m")))
    later = Window.partitionBy("idx").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        blocks.withColumn("after", F.coalesce(F.sum("a").over(later), zero))
        .groupBy("idx")
        .agg(F.greatest(F.sum("a"), F.max(
            F.when(F.col("m") > 0, F.col("m") + F.col("after")).otherwise(zero))).alias("v")))
    held = folded.filter(F.col("kind") == "heavy").groupBy("bucket", "key").agg(F.sum("f").alias("v"))
    kept = heavy_table(elastic_heavy(folded, spec).select("bucket", "key"), spec)
    lost = held.join(kept, ["bucket", "key"], "left_anti").select(cell, "v")
    return cells.unionByName(lost).groupBy("idx").agg(capped(F.sum("v")).alias("v")).filter(F.col("v") > 0)


def elastic_query(keys: DataFrame, heavy: DataFrame, light: DataFrame, spec: SketchSpec) -> DataFrame:
    """Adds ``est``: the resident count, plus the light cell when absent or flagged."""
    cells = light.select("idx", F.col("v").alias("_light"))
    known = heavy.select("key", F.col("v").alias("_heavy"), F.col("flag").alias("_flag"))
    small = F.broadcast(cells) if spec.width <= 4_000_000 else cells
    joined = (
        keys.withColumn("idx", light_cell(spec, is_text(keys)))
        .join(heavy_table(known, spec), "key", "left").join(small, "idx", "left"))
    zero = F.lit(0).cast("bigint")
    light_part = F.when(F.col("_heavy").isNull() | F.col("_flag"), F.coalesce("_light", zero)).otherwise(zero)
    return joined.select(*keys.columns, (F.coalesce("_heavy", zero) + light_part).alias("est"))


def elastic_gsum(heavy: DataFrame, light: DataFrame, spec: SketchSpec, g: G) -> DataFrame:
    """``g`` over the histogram of light counters and over the residents.

    The light cell of a flagged resident is added to its count and taken out of the light sum.
    """
    text = is_text(heavy)
    cells = light.select("idx", F.col("v").alias("_light"))
    small = F.broadcast(cells) if spec.width <= 4_000_000 else cells
    residents = heavy.withColumn("idx", light_cell(spec, text)).join(small, "idx", "left")
    extra = F.when(F.col("flag"), F.coalesce("_light", F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0.0)
    upper = residents.select((g(F.col("v") + extra) - F.when(extra > 0, g(extra)).otherwise(zero)).alias("t"))
    sizes = light.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    lower = sizes.select((F.col("n") * g(F.col("v"))).alias("t"))
    return upper.unionByName(lower).agg(F.coalesce(F.sum("t"), zero).alias("gsum"))


def elastic_heavy_hitters(heavy: DataFrame, light: DataFrame, spec: SketchSpec, threshold: int) -> DataFrame:
    known = elastic_query(heavy.select("key"), heavy, light, spec)
    return known.filter(F.col("est") >= threshold)


def elastic_size(heavy: DataFrame, light: DataFrame, spec: SketchSpec) -> DataFrame:
    """Buckets, used slots and used light cells."""
    one = light.agg(F.count(F.lit(1)).alias("light_used")).withColumn("_one", F.lit(1))
    return heavy.agg(F.count(F.lit(1)).alias("slots_used")).withColumn("_one", F.lit(1)).join(
        F.broadcast(one), "_one").select(
        F.lit(spec.buckets).cast("bigint").alias("buckets"),
        F.lit(spec.buckets * 64).cast("bigint").alias("heavy_bytes"), "slots_used", "light_used")
