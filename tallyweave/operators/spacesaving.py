"""A mergeable summary of frequent keys with bounds, over shards of a stream.

A shard is a block of arrivals by their number, so a summary doesn't depend on how files or tasks cut the
stream. Each shard keeps its ``size`` most frequent keys exactly and the count of the next one as its
*floor*: no other key has more arrivals in the shard. Summaries are merged in a tree, ``fan`` of them at a time.
In a merged one each key has

* ``low``, the arrivals that were counted where the key was listed, and
* ``high``, those and the floors of the summaries that don't list it,

and lies between both. The ``size`` keys of largest ``high`` stay; the largest ``high`` that goes is the new
floor. Whatever the size, a key with more arrivals than the last floor is listed.

A task ranks one shard, ``shard_rows`` arrivals at most, or one group, ``fan * size`` keys at most. Weights are
added up before the only shuffle of arrivals, so a hot key is one row for each task and shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize
from tallyweave.spec import SHARD_ROWS

#: Summaries that are merged at a time.
FAN = 16


def _kept(rows: DataFrame, size: int) -> DataFrame:
    """Cuts each group of ``(shard, key, low, high, base)``; ``base`` is the floor where no key goes."""
    place = Window.partitionBy("shard").orderBy(F.desc("high"), "key")
    ranked = rows.withColumn("_at", F.row_number().over(place)).filter(F.col("_at") <= size + 1)
    next_one = F.max(F.when(F.col("_at") == size + 1, F.col("high"))).over(Window.partitionBy("shard"))
    return ranked.withColumn("floor", F.coalesce(next_one, F.col("base"))).filter(F.col("_at") <= size).select(
        "shard", "key", "low", "high", "floor")


def shard_summaries(stream: DataFrame, size: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(shard, key, low, high, floor)`` of each shard; a stream without numbers is sharded by its partitions."""
    numbered = "seq" in stream.columns
    shard = F.coalesce(F.floor(F.col("seq") / F.lit(shard_rows)).cast("bigint"), F.lit(0)) if numbered else F.spark_partition_id().cast("bigint")
    counts = stream.filter("key IS NOT NULL").withColumn("shard", shard).groupBy("shard", "key").agg(F.sum("weight").alias("low"))
    return _kept(counts.select("shard", "key", "low", F.col("low").alias("high"), F.lit(0).cast("bigint").alias("base")), size)


def merge_summaries(summaries: DataFrame, size: int, fan: int = FAN) -> DataFrame:
    """One level of the tree: summaries whose numbers agree but for the last digit to base ``fan`` become one."""
    up = F.floor(F.col("shard") / F.lit(fan)).cast("bigint")
    floors = summaries.groupBy("shard").agg(F.max("floor").alias("floor")).groupBy(up.alias("shard")).agg(F.sum("floor").alias("base"))
    added = summaries.groupBy(up.alias("shard"), "key").agg(
        F.sum("low").alias("low"), F.sum(F.col("high") - F.col("floor")).alias("over"))
    return _kept(added.join(floors, "shard").select("shard", "key", "low", (F.col("over") + F.col("base")).alias("high"), "base"), size)


def spacesaving_tree(stream: DataFrame, size: int, shard_rows: int = SHARD_ROWS, fan: int = FAN) -> DataFrame:
    """``(key, low, high, floor)`` of the whole stream."""
    if fan < 2 or size < 1:
        raise ValueError("summaries need room for a key, and a merge two of them at least")
    held = materialize(shard_summaries(stream, size, shard_rows))
    while True:
        ends = held.agg(F.min("shard").alias("a"), F.max("shard").alias("z")).first()
        if ends.a == ends.z:
            return held.drop("shard")
        if ends.a < 0:
            held = held.withColumn("shard", F.col("shard") - F.lit(ends.a))
        held = materialize(merge_summaries(held, size, fan))
