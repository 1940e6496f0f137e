"""Combined estimator: exact counters for the heavy keys, a universal sketch for the rest.

A summary is four tables. ``heavy(bucket, key, v, flag)`` holds at most buckets x slots keys;
``flag`` marks keys part of whose weight went to the sketch. A key that sits in both parts
is always put together before a weight function is applied to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.heavy import (
    bounded_split, heavy_fold, heavy_table, lossless_split, merge_shards, residual_of,
)
from tallyweave.operators.exact import key_counts
from tallyweave.operators.universal import (
    bounded_candidates, product_candidates, sum_candidates, universal_build, universal_candidates,
    universal_gsum, universal_heavy_hitters, universal_query,
)
from tallyweave.sources.scratch import materialize
from tallyweave.spec import SketchSpec

G = Callable[[Column], Column]


@dataclass(frozen=True)
class Summary:
    heavy: DataFrame
    counters: DataFrame
    candidates: DataFrame
    spec: SketchSpec


def _summarize(heavy: DataFrame, residual: DataFrame, spec: SketchSpec, mode: str) -> Summary:
    """Sketch a residual stream. ``bounded`` mode never groups it by key.

    Counters and candidates are written once: they are small, fixed by the spec, and every later
    question would otherwise read the whole stream again.
    """
    counters = materialize(universal_build(residual, spec))
    if mode == "bounded":
        candidates = bounded_candidates(residual, counters, spec)
    else:
        counts = residual.groupBy("key").agg(F.sum("weight").alias("f"))
        candidates = universal_candidates(counts, spec, mode, counters)
    return Summary(heavy, counters, materialize(candidates), spec)


def extract_build(stream: DataFrame, spec: SketchSpec, route: str = "lossless",
                  mode: str = "tracked", shard_rows: int | None = None) -> Summary:
    """Summary of a stream; runs the jobs and writes each of its tables once.

    ``route`` is ``lossless`` (exact counts first), ``bounded`` (candidates from bounded summaries, then counts) or
    the name of an ordered strategy, which replays arrivals. With a heavy share of 0 all goes
    to the sketch; with a share of 1 the sketch stays empty and what the heavy part hands on is
    dropped.
    """
    if not spec.uses_heavy:
        nothing = stream.select(F.lit(0).cast("bigint").alias("bucket"), "key",
                                F.lit(0).cast("bigint").alias("v"), F.lit(False).alias("flag")).limit(0)
        heavy, residual = nothing, stream.select("key", "weight")
        if mode != "bounded":
            residual = materialize(key_counts(residual).select("key", F.col("f").alias("weight")))
    elif route == "lossless":
        # The counts are read three times, so they are written once.
        counts = materialize(key_counts(stream))
        heavy = materialize(lossless_split(counts, spec)[0])
        residual = residual_of(counts, heavy, spec)
    elif route in ("bounded", "spacesaving"):
        heavy = materialize(bounded_split(stream, spec, shard_rows=shard_rows)[0])
        residual = stream.join(heavy_table(heavy.select("key"), spec), "key", "left_anti").select("key", "weight")
    else:
        # Both outputs come from one replay, so it is written once.
        heavy, residual = merge_shards(materialize(heavy_fold(stream, spec, route, shard_rows, totals=True)), spec)
        heavy = materialize(heavy)
    if not spec.uses_universal:
        residual = residual.limit(0)
    return _summarize(heavy, residual, spec, mode)


def extract_heavy_values(s: Summary) -> DataFrame:
    """Resident counts without the flag."""
    return s.heavy.select("key", "v")


def extract_query(keys: DataFrame, s: Summary) -> DataFrame:
    """Adds ``est``: the heavy count, plus the sketch estimate when absent or flagged."""
    known = heavy_table(s.heavy.select("key", F.col("v").alias("_heavy"), F.col("flag").alias("_flag")), s.spec)
    zero = F.lit(0.0)
    if not s.spec.uses_universal:
        return keys.join(known, "key", "left").select(
            *keys.columns, F.coalesce(F.col("_heavy").cast("double"), zero).alias("est"))
    sketched = universal_query(keys, s.counters, s.spec).withColumnRenamed("est", "_light")
    joined = sketched.join(known, "key", "left")
    light = F.when(F.col("_heavy").isNull() | F.col("_flag"), F.col("_light")).otherwise(zero)
    return joined.select(*keys.columns, (F.coalesce("_heavy", F.lit(0)) + light).alias("est"))


def _without(candidates: DataFrame, keys: DataFrame, spec: SketchSpec) -> DataFrame:
    return candidates.join(heavy_table(keys.select("key"), spec), "key", "left_anti")


def _add_parts(upper: DataFrame, lower: DataFrame) -> DataFrame:
    return upper.select(F.col("gsum")).unionByName(lower.select("gsum")).agg(F.sum("gsum").alias("gsum"))


def _sum_g(values: DataFrame, g: G, value: str = "est") -> DataFrame:
    return values.agg(F.coalesce(F.sum(g(F.col(value))), F.lit(0.0)).alias("gsum"))


def extract_gsum(s: Summary, g: G) -> DataFrame:
    """``sum g(f)``: heavy keys by their full value, all others from the sketch."""
    upper = _sum_g(extract_query(s.heavy.select("key"), s), g)
    return _add_parts(upper, universal_gsum(_without(s.candidates, s.heavy, s.spec), s.spec, g))


def extract_gsum_subset(s: Summary, g: G, check: G) -> DataFrame:
    """``sum g(f)`` over the keys passing ``check``."""
    inside = Summary(s.heavy.filter(check(F.col("key"))), s.counters,
                     s.candidates.filter(check(F.col("key"))), s.spec)
    return extract_gsum(inside, g)


def extract_heavy_hitters(s: Summary, threshold: int) -> DataFrame:
    """Heavy counts and sketch candidates added per key, at or above the threshold."""
    sketched = universal_heavy_hitters(s.candidates, 1)
    return s.heavy.select("key", "v").unionByName(sketched.select("key", "v")).groupBy("key").agg(
        F.sum("v").alias("v")).filter(F.col("v") >= threshold)


def extract_g_heavy_hitters(s: Summary, g: G, threshold: float) -> DataFrame:
    """Keys whose weight ``g(estimate)`` reaches a threshold on weights."""
    return extract_heavy_hitters(s, 1).withColumn("g", g(F.col("v"))).filter(F.col("g") >= threshold)


def _either_heavy(a: Summary, b: Summary) -> DataFrame:
    """Full values in both streams of the keys heavy in either: ``(key, est, est_b)``."""
    keys = a.heavy.select("key").union(b.heavy.select("key")).distinct()
    return extract_query(extract_query(keys, a).withColumnRenamed("est", "est_a"), b).withColumnRenamed("est", "est_b")


def extract_gsum_add(a: Summary, b: Summary, g: G) -> DataFrame:
    """``sum g(fA + fB)``."""
    both = _either_heavy(a, b)
    upper = _sum_g(both.withColumn("est", F.col("est_a") + F.col("est_b")), g)
    merged = sum_candidates(a.candidates, a.counters, b.candidates, b.counters, a.spec)
    return _add_parts(upper, universal_gsum(_without(merged, both, a.spec), a.spec, g))


def extract_gsum_mul(a: Summary, b: Summary, g: G) -> DataFrame:
    """``sum g(fA * fB)``, cross terms heavy x sketched included."""
    both = _either_heavy(a, b)
    upper = _sum_g(both.withColumn("est", F.col("est_a") * F.col("est_b")), g)
    products = product_candidates(a.candidates, b.candidates)
    return _add_parts(upper, universal_gsum(_without(products, both, a.spec), a.spec, g))
