"""Buckets of eight residents over sixteen signed counters.

A newcomer to a full bucket replaces the smallest resident once its signed estimate reaches
that resident's count. A resident never replaced since its first arrival is error free; its
arrivals enter the signed counters only if it leaves.

Tables: ``slots(bucket, key, v, exact)`` and ``casts(bucket, pos, v)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_bucket, hash_sign
from tallyweave.operators.exact import top_per_group
from tallyweave.operators.folds import ordered_fold
from tallyweave.operators.heavy import heavy_table
from tallyweave.operators.linear import is_text
from tallyweave.spec import SketchSpec

G = Callable[[Column], Column]
# Fixed value: signed counters per bucket.
CASTS = 16


def cast_of(spec: SketchSpec, text: bool) -> Column:
    return hash_bucket(F.col("key"), spec.seed, CASTS, role="cast", text=text)


def wave_sign(spec: SketchSpec, text: bool) -> Column:
    return hash_sign(F.col("key"), spec.seed, role="wave", text=text)


def waving_bucket(spec: SketchSpec, text: bool, buckets: int) -> Column:
    """Bucket of a key. Taking the hash modulo n and 2n keeps halving and doubling consistent."""
    return hash_bucket(F.col("key"), spec.seed, buckets, role="waving", text=text)


class WavingBucket:
    """``key -> [count, exact, slot, cast, sign]`` plus the signed counters."""

    __slots__ = ("slots", "held", "casts")

    def __init__(self, slots: int):
        self.slots, self.held, self.casts = slots, {}, [0] * CASTS

    def step(self, seq, wave, f):
        key, cast, sign = wave
        here = self.held.get(key)
        if here is not None:
            here[0] += f
            if not here[1]:
                self.casts[cast] += sign * f
            return None
        if len(self.held) < self.slots:
            self.held[key] = [f, True, len(self.held), cast, sign]
            return None
        victim = min(self.held, key=lambda k: (self.held[k][0], self.held[k][2]))
        count, exact, slot, old_cast, old_sign = self.held[victim]
        if self.casts[cast] * sign >= count:
            if exact:
                self.casts[old_cast] += old_sign * count
            del self.held[victim]
            self.held[key] = [count + f, False, slot, cast, sign]
        self.casts[cast] += sign * f
        return None

    def close(self):
        for key, (count, exact, slot, _, _) in self.held.items():
            yield ("slot", None, slot, key, count, exact)
        for pos, value in enumerate(self.casts):
            if value:
                yield ("cast", None, pos, None, value, False)


class KeyedWave:
    """Unpacks the two per-key hashes that travel with each arrival inside ``weight``."""

    __slots__ = ("bucket",)

    def __init__(self, slots: int):
        self.bucket = WavingBucket(slots)

    def step(self, seq, key, packed):
        f, rest = divmod(packed, 2 * CASTS)
        cast, minus = divmod(rest, 2)
        return self.bucket.step(seq, (key, cast, -1 if minus else 1), f)

    def close(self):
        return self.bucket.close()


def waving_build(stream: DataFrame, spec: SketchSpec, shard_rows: int | None = None) -> DataFrame:
    """Fold of a stream: rows of kind ``slot`` and ``cast`` per shard and bucket.

    The cast position and the sign are computed as columns and packed behind the weight.
    """
    text, slots = is_text(stream), spec.slots
    minus = (F.lit(1) - wave_sign(spec, text)) / F.lit(2)
    packed = F.col("weight") * F.lit(2 * CASTS) + cast_of(spec, text) * F.lit(2) + minus.cast("bigint")
    rows = stream.select(
        waving_bucket(spec, text, spec.buckets).alias("bucket"), "seq", "key", packed.cast("bigint").alias("weight"))
    return ordered_fold(rows, lambda: KeyedWave(slots), shard_rows or spec.shard_rows)


def waving_slots(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("kind") == "slot").select(
        "shard", "bucket", "key", F.col("f").alias("v"), F.col("flag").alias("exact"))


def waving_casts(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("kind") == "cast").select("shard", "bucket", "pos", F.col("f").alias("v"))


def waving_merge(slots: DataFrame, casts: DataFrame, spec: SketchSpec,
                 parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """One summary from several with the same buckets: ``(slots, casts)``.

    Signed counters add up and counts of a key add up. A key is error free only if it was so in
    all ``parts`` summaries of the stream; otherwise its error-free share returns to the
    counters. Each bucket keeps its largest keys and error-free losers return as well.
    """
    text = is_text(slots)
    added = slots.groupBy("bucket", "key").agg(
        F.sum("v").alias("v"),
        (F.min("exact") & (F.count(F.lit(1)) == parts)).alias("exact"),
        F.sum(F.when(F.col("exact"), F.col("v")).otherwise(F.lit(0))).alias("_free"))
    top = top_per_group(added, ["bucket"], [F.desc("v"), F.col("key")], spec.slots, ["key"])
    kept = top.select("bucket", "key", "v", "exact")
    marks = heavy_table(kept.select("bucket", "key", F.lit(True).alias("_kept")), spec)
    pos, sign = cast_of(spec, text), wave_sign(spec, text)
    returned = (
        added.filter(F.col("_free") > 0).join(marks, ["bucket", "key"], "left")
        .filter(F.col("_kept").isNull() | ~F.col("exact"))
        .select("bucket", pos.alias("pos"), (sign * F.col("_free")).alias("v")))
    return kept, casts.select("bucket", "pos", "v").unionByName(returned).groupBy("bucket", "pos").agg(
        F.sum("v").alias("v")).filter(F.col("v") != 0)


def waving_tables(folded: DataFrame, spec: SketchSpec) -> tuple[DataFrame, DataFrame]:
    """``(slots, casts)`` of a fold as one summary, one row per key, however many shards it has."""
    shards = folded.agg(F.countDistinct("shard")).first()[0]
    return waving_merge(waving_slots(folded), waving_casts(folded), spec, max(1, shards))


def waving_shrink(slots: DataFrame, casts: DataFrame, spec: SketchSpec) -> tuple[DataFrame, DataFrame]:
    """Half as many buckets: bucket i + n/2 folds into bucket i."""
    if spec.buckets % 2:
        raise ValueError("an odd number of buckets cannot be halved")
    half = spec.buckets // 2
    fold = lambda df: df.withColumn("bucket", F.col("bucket") % half)
    return waving_merge(fold(slots), fold(casts), spec.with_sizes(buckets=half))


def waving_expand(slots: DataFrame, casts: DataFrame, spec: SketchSpec) -> tuple[DataFrame, DataFrame]:
    """Twice as many buckets: keys re-hash, each signed counter is halved into both copies.

    A resident moving to its new bucket leaves the other copy; if it was not error free, its
    share is taken out of that copy's counter first.
    """
    text, n = is_text(slots), spec.buckets
    moved = slots.withColumn("bucket", waving_bucket(spec, text, 2 * n))
    copies = casts.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + n)))
    leaving = moved.filter(~F.col("exact")).select(
        F.when(F.col("bucket") >= n, F.col("bucket") - n).otherwise(F.col("bucket") + n).alias("bucket"),
        cast_of(spec, text).alias("pos"), (-wave_sign(spec, text) * F.col("v")).alias("v"))
    sums = copies.select("bucket", "pos", "v").unionByName(leaving).groupBy("bucket", "pos").agg(
        F.sum("v").alias("v"))
    return moved, sums.withColumn("v", F.shiftright("v", 1)).filter(F.col("v") != 0)


def waving_query(keys: DataFrame, slots: DataFrame, casts: DataFrame, spec: SketchSpec,
                 only_slots: bool = False) -> DataFrame:
    """Adds ``est``: the slot value, else the signed counter floored at 0 (or plain 0)."""
    text = is_text(keys)
    known = heavy_table(slots.select("key", F.col("v").alias("_slot")), spec)
    zero = F.lit(0).cast("bigint")
    joined = keys.join(known, "key", "left")
    if only_slots:
        return joined.select(*keys.columns, F.coalesce("_slot", zero).alias("est"))
    cells = casts.select("bucket", "pos", F.col("v").alias("_cast"))
    small = F.broadcast(cells) if spec.buckets * CASTS <= 4_000_000 else cells
    joined = joined.withColumn("bucket", waving_bucket(spec, text, spec.buckets)).withColumn(
        "pos", cast_of(spec, text)).join(small, ["bucket", "pos"], "left")
    signed = F.greatest(zero, F.coalesce("_cast", zero) * wave_sign(spec, text))
    return joined.select(*keys.columns, F.coalesce("_slot", signed).alias("est"))


def waving_gsum(slots: DataFrame, g: G) -> DataFrame:
    return slots.agg(F.coalesce(F.sum(g(F.col("v"))), F.lit(0.0)).alias("gsum"))


def waving_heavy_hitters(slots: DataFrame, threshold: int) -> DataFrame:
    return slots.filter(F.col("v") >= threshold).select("key", "v")


def waving_size(slots: DataFrame, spec: SketchSpec, full_at: float = 1.0) -> DataFrame:
    """Bytes, used slots and whether the share ``full_at`` of all slots is in use."""
    total = spec.buckets * spec.slots
    return slots.agg(
        F.lit(spec.buckets * (spec.slots * 8 + 2 * CASTS)).cast("bigint").alias("bytes"),
        F.count(F.lit(1)).alias("used"),
        (F.count(F.lit(1)) >= F.lit(total * full_at)).alias("full"))
