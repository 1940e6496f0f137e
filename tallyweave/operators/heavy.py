"""Heavy part: keep the frequent keys with exact counters, pass the rest on.

Three routes give the same kind of result, a ``heavy`` table and what is left over:

* ``lossless_split`` ranks exact counts inside each bucket;
* ``bounded_split`` finds candidates with small mergeable summaries and then counts
  them exactly;
* ``heavy_fold`` replays arrivals in order through one small state machine per bucket.

A fold is sequential inside a bucket, so its unit of work is (shard, bucket), where a shard is
a fixed-length block of arrivals, ``SketchSpec.shard_rows``: no task ever replays more arrivals of a
bucket, however hot. ``merge_shards`` adds the shards up.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_bucket, hash_fn
from tallyweave.operators.exact import top_per_group
from tallyweave.operators.frequent import frequent_per_partition
from tallyweave.operators.folds import ordered_fold
from tallyweave.operators.linear import is_text
from tallyweave.operators.spacesaving import FAN, spacesaving_tree
from tallyweave.operators.tasks import long_tasks
from tallyweave.spec import ELASTIC_FACTOR, GUARDIAN_BASE, GUARDIAN_GAP, SHARD_ROWS, STRATEGIES, SketchSpec

# A heavy table is broadcast up to this many rows.
BROADCAST_HEAVY = 2_000_000
# Keys whose hand-ons one bucket adds up before it lets go of the oldest.
REST_KEYS = 100_000


def with_bucket(df: DataFrame, spec: SketchSpec) -> DataFrame:
    return df.withColumn("bucket", hash_bucket(F.col("key"), spec.seed, spec.buckets, text=is_text(df)))


def heavy_table(df: DataFrame, spec: SketchSpec) -> DataFrame:
    """Hint a broadcast only where the spec bounds the table."""
    return F.broadcast(df) if spec.heavy_rows <= BROADCAST_HEAVY else df


# --- batch routes -----------------------------------------------------------------------

def lossless_split(counts: DataFrame, spec: SketchSpec) -> tuple[DataFrame, DataFrame]:
    """Exact split of key counts: ``(heavy, residual)``.

    The ``slots`` most frequent keys of each bucket stay, with their exact counts; every
    other key goes to the residual ``(key, weight)``.
    """
    bucketed = with_bucket(counts.select("key", "f"), spec)
    top = top_per_group(bucketed, ["bucket"], [F.desc("f"), F.col("key")], spec.slots, ["key"],
                        value="f", groups=spec.buckets)
    heavy = top.select("bucket", "key", F.col("f").alias("v"), F.lit(False).alias("flag"))
    return heavy, residual_of(counts, heavy, spec)


def residual_of(counts: DataFrame, heavy: DataFrame, spec: SketchSpec) -> DataFrame:
    """Counts of the keys that are not heavy, as a weighted stream."""
    rest = counts.join(heavy_table(heavy.select("key"), spec), "key", "left_anti")
    return rest.select("key", F.col("f").alias("weight"))


def heavy_spacesaving(stream: DataFrame, size: int, shard_rows: int = SHARD_ROWS, fan: int = FAN) -> DataFrame:
    """Mergeable summary of the whole stream: at most ``size`` keys ``(key, v, upper, floor)``.

    A key has from ``v`` to ``upper`` arrivals; one that isn't listed has ``floor`` at most.
    """
    found = spacesaving_tree(stream, size, shard_rows, fan)
    return found.select("key", F.col("low").alias("v"), F.col("high").alias("upper"), "floor")


def partition_candidates(stream: DataFrame, size: int) -> DataFrame:
    """Frequent keys from lists of one task each, for streams without arrival numbers: ``(key,)``."""
    merged = frequent_per_partition(long_tasks(stream), [], size).groupBy("key").agg(F.sum("weight").alias("v"))
    return merged.orderBy(F.desc("v"), F.col("key")).limit(size).select("key")


def bounded_split(stream: DataFrame, spec: SketchSpec, size: int | None = None,
                  shard_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two passes: ``(heavy, residual)`` with exact heavy counts.

    Pass one finds candidates, by the summaries of shards where arrivals have numbers and by those of partitions
    where not; pass two counts them. The residual is the untouched rest of the stream, ready for ``universal_build``.
    """
    size = size or max(1, spec.heavy_rows)
    if "seq" in stream.columns:
        found = spacesaving_tree(stream, size, shard_rows or spec.shard_rows or SHARD_ROWS).select("key")
    else:
        found = partition_candidates(stream, size)
    small = F.broadcast(found) if size <= BROADCAST_HEAVY else found
    inside = stream.join(small, "key", "left_semi")
    heavy = inside.groupBy("key").agg(F.sum("weight").alias("v"))
    heavy = with_bucket(heavy, spec).select("bucket", "key", "v", F.lit(False).alias("flag"))
    return heavy, stream.join(small, "key", "left_anti").select("key", "weight")


# --- ordered folds ----------------------------------------------------------------------

class Guard(Protocol):
    """When does a newcomer to a full bucket replace the smallest resident?

    ``grow`` answers whether the guard counter advances for this arrival, ``full`` whether the
    guard now outweighs the smallest resident.
    """

    def grow(self, guard: int, smallest: int, seq: int) -> bool: ...

    def full(self, guard: int, smallest: int) -> bool: ...


class ElasticGuard:
    def grow(self, guard, smallest, seq):
        return True

    def full(self, guard, smallest):
        return guard > ELASTIC_FACTOR * smallest


class FrequentGuard(ElasticGuard):
    def full(self, guard, smallest):
        return guard > smallest


class GuardianGuard(FrequentGuard):
    """Advances with a probability that falls exponentially in the distance to the guard.

    The coin is a hash of the arrival number, so replays agree.
    """

    def __init__(self, seed: int):
        self.fn = hash_fn(seed, "coin")

    def grow(self, guard, smallest, seq):
        return coin(self.fn, seq) % int(GUARDIAN_BASE ** min(smallest - guard, GUARDIAN_GAP)) == 0


def coin(fn, seq: int) -> int:
    """Integer form of ``HashFn.column`` for one arrival number."""
    p = 2147483647
    x = (fn.a0 * (seq & 268435455) + fn.a1 * ((seq >> 28) & 268435455) + fn.a2 * ((seq >> 56) & 255) + fn.b) % p
    return (((fn.c3 * x + fn.c2) % p * x + fn.c1) % p * x + fn.c0) % p


def heavy_make(strategy: str, seed: int = 1) -> Guard:
    """Guard of an ordered strategy, by name."""
    guards: dict[str, Callable[[], Guard]] = {
        "elastic": ElasticGuard, "frequent": FrequentGuard, "guardian": lambda: GuardianGuard(seed)}
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    if strategy == "spacesaving":
        raise ValueError("spacesaving is not a per-bucket fold; use heavy_spacesaving or bounded_split")
    return guards[strategy]()


class BucketState:
    """Residents of one bucket: key -> [count, admitted by a swap?, slot]."""

    __slots__ = ("rule", "slots", "guard", "held", "victim")

    def __init__(self, rule: Guard, slots: int):
        self.rule, self.slots, self.guard, self.held = rule, slots, 0, {}
        self.victim = None  # the smallest resident, while nothing has happened that could change it

    def step(self, seq: int, key, f: int):
        """Returns None when the arrival is kept, else what is handed on."""
        held = self.held
        here = held.get(key)
        if here is not None:
            here[0] += f
            if f < 0 or key == self.victim:
                self.victim = None
            return None
        if len(held) < self.slots:
            held[key] = [f, False, len(held)]
            return None
        victim = self.victim
        if victim is None:
            victim = self.victim = min(held, key=lambda k: (held[k][0], held[k][2]))
        smallest, admitted, slot = held[victim]
        guard = self.guard + 1 if self.rule.grow(self.guard, smallest, seq) else self.guard
        if not self.rule.full(guard, smallest):
            self.guard = guard
            return ("pass", seq, None, key, f, False)
        self.guard, self.victim = 0, None
        del held[victim]
        held[key] = [f, True, slot]
        return ("evict", seq, slot, victim, smallest, admitted)

    def close(self):
        for key, (count, admitted, slot) in self.held.items():
            yield ("heavy", None, slot, key, count, admitted)


class BucketTotals(BucketState):
    """The same with hand-ons added up by key: rows of kind ``pass`` without an arrival number."""

    __slots__ = ("rest", "most")

    def __init__(self, rule: Guard, slots: int, most: int):
        super().__init__(rule, slots)
        self.rest, self.most = {}, most

    def step(self, seq: int, key, f: int):
        row = super().step(seq, key, f)
        if row is None:
            return None
        rest, gone = self.rest, row[3]
        rest[gone] = rest.get(gone, 0) + row[4]
        if len(rest) <= self.most:
            return None
        oldest = next(iter(rest))
        return ("pass", None, None, oldest, rest.pop(oldest), False)

    def close(self):
        yield from super().close()
        for key, weight in self.rest.items():
            yield ("pass", None, None, key, weight, False)


def heavy_fold(stream: DataFrame, spec: SketchSpec, strategy: str,
               shard_rows: int | None = None, totals: bool = False) -> DataFrame:
    """Replay a stream in ``seq`` order through its buckets.

    Rows of ``kind`` ``heavy`` are the residents at the end (``seq`` null), ``evict`` a resident
    swapped out by the arrival ``seq``, ``pass`` an arrival handed on. ``flag`` tells whether
    the resident had been admitted by a swap. With ``totals`` what is handed on is added up by key, for those
    who only sum it: about a row for each key instead of one for each arrival.
    """
    rule, slots, most = heavy_make(strategy, spec.seed), spec.slots, REST_KEYS
    machine = (lambda: BucketTotals(rule, slots, most)) if totals else (lambda: BucketState(rule, slots))
    return ordered_fold(with_bucket(stream, spec), machine, shard_rows or spec.shard_rows)


def heavy_query_all(folded: DataFrame) -> DataFrame:
    """Residents ``(shard, bucket, key, v, flag)``."""
    return folded.filter(F.col("kind") == "heavy").select(
        "shard", "bucket", "key", F.col("f").alias("v"), "flag")


def heavy_evictions(folded: DataFrame) -> DataFrame:
    """What was passed on or swapped out, in the form of a stream."""
    return folded.filter(F.col("kind") != "heavy").select(
        "kind", "shard", "bucket", "seq", "key", F.col("f").alias("weight"))


def heavy_query(keys: DataFrame, heavy: DataFrame, spec: SketchSpec) -> DataFrame:
    """Adds ``v``: the resident count of each key, or 0."""
    table = heavy_table(heavy.groupBy("key").agg(F.sum("v").alias("v")), spec)
    return keys.join(table, "key", "left").withColumn("v", F.coalesce("v", F.lit(0)))


def merge_residents(residents: DataFrame, spec: SketchSpec) -> tuple[DataFrame, DataFrame]:
    """One heavy table from the residents ``(shard, bucket, key, v, flag)`` of several shards, and what it can't hold.

    Residents are added per key over the shards and each bucket keeps its ``slots`` largest; the others
    are handed on as ``(key, weight)``. A key is flagged when it was admitted by a swap or was not
    resident in every shard, because part of it may then be elsewhere.
    """
    shards = residents.agg(F.countDistinct("shard")).scalar()
    marked = residents.groupBy("bucket", "key").agg(
        F.sum("v").alias("v"), F.max("flag").alias("_flag"), F.count(F.lit(1)).alias("_in")).select(
        "bucket", "key", "v", (F.col("_flag") | (F.col("_in") < shards)).alias("flag"))
    top = top_per_group(marked, ["bucket"], [F.desc("v"), F.col("key")], spec.slots, ["key"])
    heavy = top.select("bucket", "key", "v", "flag")
    return heavy, marked.join(heavy_table(heavy.select("key"), spec), "key", "left_anti").select("key", F.col("v").alias("weight"))


def merge_shards(folded: DataFrame, spec: SketchSpec) -> tuple[DataFrame, DataFrame]:
    """Heavy and residual tables of a fold: ``(heavy, residual)``; no weight is lost."""
    heavy, losers = merge_residents(heavy_query_all(folded), spec)
    return heavy, heavy_evictions(folded).select("key", "weight").unionByName(losers)


def heavy_mass(heavy: DataFrame, residual: DataFrame) -> DataFrame:
    """Weight on each side of a split; the two add up to the stream."""
    inside = heavy.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("heavy")).withColumn("_one", F.lit(1))
    outside = residual.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("residual")).withColumn("_one", F.lit(1))
    return inside.join(F.broadcast(outside), "_one").select(
        "heavy", "residual", (F.col("heavy") + F.col("residual")).alias("total"))
