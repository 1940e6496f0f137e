"""Join-size sketches that set heavy keys apart: skimmed and three-tier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_bucket
from tallyweave.functions.medians import median_of_group
from tallyweave.operators.exact import top_per_group
from tallyweave.operators.folds import ordered_fold
from tallyweave.operators.linear import (
    count_sketch_build, count_sketch_query, counter_gsum, is_text, row_products, sketch_merge,
)
from tallyweave.sources.scratch import materialize
from tallyweave.spec import SketchSpec

# Count at which a key enters the heavy tier, and how many times that a skimmed
# key must reach; keys per middle bucket.
HEAVY_THRESHOLD = 500
SKIM_FACTOR = 10
MIDDLE_SLOTS = 8
ROLE = "join"


def join_sketch_build(stream: DataFrame, spec: SketchSpec) -> DataFrame:
    return count_sketch_build(stream, spec, role=ROLE)


# --- skimmed sketch ---------------------------------------------------------------------

def skim_heavy(keys: DataFrame, counters: DataFrame, spec: SketchSpec,
               threshold: int = SKIM_FACTOR * HEAVY_THRESHOLD) -> DataFrame:
    """Keys ``(key, k)`` whose estimate reaches the threshold."""
    found = count_sketch_query(keys.select("key").distinct(), counters, spec, role=ROLE)
    return found.select("key", F.floor("est").cast("bigint").alias("k")).filter(F.col("k") >= threshold)


def skim_out(counters: DataFrame, heavy: DataFrame, spec: SketchSpec) -> DataFrame:
    """Counters after the skimmed keys have been taken out."""
    return sketch_merge(counters, join_sketch_build(heavy.select("key", (-F.col("k")).alias("weight")), spec))


def skim_join(heavy_a: DataFrame, skimmed_a: DataFrame, heavy_b: DataFrame, skimmed_b: DataFrame,
              spec: SketchSpec) -> DataFrame:
    """Exact heavy x heavy plus the sketched rest; one-sided heavies go back to the sketch."""
    back = lambda mine, others: join_sketch_build(
        mine.join(others.select("key"), "key", "left_anti").select("key", F.col("k").alias("weight")), spec)
    rest_a = sketch_merge(skimmed_a, back(heavy_a, heavy_b))
    rest_b = sketch_merge(skimmed_b, back(heavy_b, heavy_a))
    exact = heavy_a.join(heavy_b.withColumnRenamed("k", "k2"), "key").agg(
        F.coalesce(F.sum(F.col("k").cast("double") * F.col("k2")), F.lit(0.0)).alias("t"))
    light = row_products(rest_a, rest_b, spec.rows).agg(median_of_group(F.col("p")).alias("t"))
    return exact.unionByName(light).agg(F.sum("t").alias("join_size"))


# --- three tiers ------------------------------------------------------------------------

@dataclass(frozen=True)
class Tiers:
    """Exact heavy keys, middle keys with partial counts, a Count-Sketch for the rest."""

    heavy: DataFrame  # key, v
    middle: DataFrame  # key, v
    light: DataFrame  # row, idx, v
    spec: SketchSpec


class TierBucket:
    """Middle slots of one bucket; a key reaching the threshold moves up for good."""

    __slots__ = ("threshold", "slots", "heavy")

    def __init__(self, threshold: int):
        self.threshold = threshold
        self.slots = [None] * MIDDLE_SLOTS
        self.heavy = {}

    def step(self, seq, key, f):
        if key in self.heavy:
            self.heavy[key] += f
            return None
        for i, slot in enumerate(self.slots):
            if slot is None or slot[0] == key:
                count = f + (0 if slot is None else slot[1])
                if count >= self.threshold:
                    self.heavy[key] = count
                    self.slots[i] = None
                else:
                    self.slots[i] = (key, count)
                return None
        i = min(range(MIDDLE_SLOTS), key=lambda j: self.slots[j][1])
        gone, count = self.slots[i]
        self.slots[i] = (key, f)
        return ("light", seq, i, gone, count, False)

    def close(self):
        for key, count in self.heavy.items():
            yield ("heavy", None, None, key, count, False)
        for i, slot in enumerate(self.slots):
            if slot is not None:
                yield ("middle", None, i, slot[0], slot[1], False)


def three_tier_fold(stream: DataFrame, spec: SketchSpec, threshold: int = HEAVY_THRESHOLD,
                    shard_rows: int | None = None) -> DataFrame:
    """Replay a stream in order: rows of kind ``heavy``, ``middle`` and ``light``."""
    bucket = hash_bucket(F.col("key"), spec.seed, spec.buckets, role="middle", text=is_text(stream))
    rows = stream.select(bucket.alias("bucket"), "seq", "key", "weight")
    return ordered_fold(rows, lambda: TierBucket(threshold), shard_rows or spec.shard_rows)


def tiers_of_fold(folded: DataFrame, spec: SketchSpec, threshold: int = HEAVY_THRESHOLD) -> Tiers:
    """The three tables of a fold, each written once: a join reads all of them several times.

    What shards and slots hold of a key is added up, so that it sits in one tier: heavy where a shard moved
    it up or the sum reaches the threshold, else middle if among the largest of its bucket, else light.
    """
    held = materialize(folded.filter(F.col("kind") != "light").groupBy("bucket", "key").agg(
        F.sum("f").alias("v"), F.max(F.col("kind") == "heavy").alias("up")))
    up = F.col("up") | (F.col("v") >= threshold)
    below = held.filter(~up)
    middle = materialize(
        top_per_group(below, ["bucket"], [F.desc("v"), F.col("key")], MIDDLE_SLOTS, ["key"]).select("key", "v"))
    rest = below.join(middle.select("key"), "key", "left_anti").select("key", F.col("v").alias("weight"))
    gone = folded.filter(F.col("kind") == "light").select("key", F.col("f").alias("weight"))
    return Tiers(
        materialize(held.filter(up).select("key", "v")), middle,
        materialize(join_sketch_build(gone.unionByName(rest), spec)), spec)


def three_tier_split(counts: DataFrame, spec: SketchSpec, threshold: int = HEAVY_THRESHOLD) -> Tiers:
    """Order-free form from exact counts: by threshold, then by rank inside the bucket."""
    bucket = hash_bucket(F.col("key"), spec.seed, spec.buckets, role="middle", text=is_text(counts))
    heavy = counts.filter(F.col("f") >= threshold).select("key", F.col("f").alias("v"))
    below = counts.filter(F.col("f") < threshold).select("key", "f", bucket.alias("bucket"))
    middle = top_per_group(below, ["bucket"], [F.desc("f"), F.col("key")], MIDDLE_SLOTS, ["key"]).select(
        "key", F.col("f").alias("v"))
    rest = below.join(middle.select("key"), "key", "left_anti")
    return Tiers(heavy, middle, join_sketch_build(rest.select("key", F.col("f").alias("weight")), spec), spec)


def _held(keys: DataFrame, t: Tiers, *names: str) -> DataFrame:
    """Adds one column per named tier with the count of each key there, or 0."""
    for name in names:
        table = getattr(t, name).select("key", F.col("v").alias(f"_{name}"))
        keys = keys.join(table, "key", "left").withColumn(f"_{name}", F.coalesce(f"_{name}", F.lit(0)))
    return keys


def three_tier_query(keys: DataFrame, t: Tiers) -> DataFrame:
    """Adds ``est``: what the three tiers hold of each key."""
    light = count_sketch_query(keys, t.light, t.spec, role=ROLE)
    return _held(light, t, "heavy", "middle").select(
        *keys.columns, (F.col("est") + F.col("_heavy") + F.col("_middle")).alias("est"))


def three_tier_query_middle(keys: DataFrame, t: Tiers) -> DataFrame:
    """Adds ``est`` without the heavy tier."""
    light = count_sketch_query(keys, t.light, t.spec, role=ROLE)
    return _held(light, t, "middle").select(*keys.columns, (F.col("est") + F.col("_middle")).alias("est"))


def three_tier_heavy_check(keys: DataFrame, t: Tiers) -> DataFrame:
    """Keys that sit in the heavy tier."""
    return keys.join(t.heavy.select("key"), "key", "left_semi")


def three_tier_join(a: Tiers, b: Tiers, g=None) -> DataFrame:
    """Join size as the five products of the expansion (h + m + l)A x (h + m + l)B.

    light x light, heavy A x all of B, (middle + light) A x heavy B,
    middle A x (middle + light) B, light A x middle B. With ``g`` each product of two counts goes through it
    before it is added, in the light part those of common cells, row by row; ``g(0)`` should be 0.
    """
    spec = a.spec
    weigh = g or (lambda product: product)
    dot = lambda df: df.agg(F.coalesce(F.sum(weigh(F.col("v").cast("double") * F.col("est"))), F.lit(0.0)).alias("t"))
    light = row_products(a.light, b.light, spec.rows, g).agg(median_of_group(F.col("p")).alias("t"))
    terms = [
        dot(three_tier_query(a.heavy, b)),
        dot(three_tier_query_middle(b.heavy, a)),
        dot(three_tier_query_middle(a.middle, b)),
        dot(count_sketch_query(b.middle, a.light, spec, role=ROLE)),
    ]
    for term in terms:
        light = light.unionByName(term)
    return light.agg(F.sum("t").alias("join_size"))


def three_tier_gsum(t: Tiers, g) -> DataFrame:
    """``g`` over heavy and middle counts and over the raw light counters.

    The last part is meaningful for ``g(x) = x^2`` only.
    """
    held = t.heavy.select("v").unionByName(t.middle.select("v")).agg(
        F.coalesce(F.sum(g(F.col("v"))), F.lit(0.0)).alias("gsum"))
    return held.unionByName(counter_gsum(t.light, g, t.spec.rows)).agg(F.sum("gsum").alias("gsum"))


def baseline_inner_product(a: Tiers, b: Tiers) -> DataFrame:
    return three_tier_join(a, b).withColumnRenamed("join_size", "inner_product")


def baseline_cosine(a: Tiers, b: Tiers) -> DataFrame:
    """Join size over the root of the two square sums."""
    square = lambda v: v.cast("double") * v.cast("double")
    one = lambda df, name: df.toDF(name).withColumn("_one", F.lit(1))
    row = one(three_tier_join(a, b), "j").join(F.broadcast(one(three_tier_gsum(a, square), "a")), "_one").join(
        F.broadcast(one(three_tier_gsum(b, square), "b")), "_one")
    return row.select((F.col("j") / F.sqrt("a") / F.sqrt("b")).alias("cosine"))
