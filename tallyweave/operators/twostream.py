"""Two streams compared by their key frequencies, exactly and from summaries.

Streams are always reduced to one row per key before they meet, so a key that is hot on both
sides is still one row on each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_bucket, hash_value
from tallyweave.functions.weights import g1_one, g1_sqr
from tallyweave.operators.exact import gsum_exact
from tallyweave.operators.extract import Summary, extract_gsum, extract_gsum_add, extract_gsum_mul
from tallyweave.operators.linear import is_text
from tallyweave.operators.tasks import long_tasks
from tallyweave.spec import SketchSpec

G = Callable[[Column], Column]
# Fixed value: chance that the larger of two compared registers is reached by one key only.
UNIQUE_SHARE = 0.7213


def pair_counts(stream: DataFrame) -> DataFrame:
    """``(key, fa, fb)`` of one stream with a ``stream`` column in {A, B}, in one aggregation."""
    side = lambda s: F.sum(F.when(F.col("stream") == s, F.col("weight")).otherwise(F.lit(0)))
    return stream.groupBy("key").agg(side("A").alias("fa"), side("B").alias("fb"))


def join_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(key, fa, fb)`` from two tables of key counts."""
    zero = F.lit(0).cast("bigint")
    return a.select("key", F.col("f").alias("fa")).join(
        b.select("key", F.col("f").alias("fb")), "key", "full_outer").select(
        "key", F.coalesce("fa", zero).alias("fa"), F.coalesce("fb", zero).alias("fb"))


def gsum2_exact(pairs: DataFrame, g: Callable[[Column, Column], Column]) -> DataFrame:
    """``sum g(fA, fB)`` over the keys of A."""
    return pairs.filter(F.col("fa") > 0).agg(
        F.coalesce(F.sum(g(F.col("fa"), F.col("fb"))), F.lit(0.0)).alias("gsum"))


def inner_product_exact(pairs: DataFrame) -> DataFrame:
    """Exact also beyond 64 bits: a DECIMAL(38,0)."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.agg(F.coalesce(F.sum(whole("fa") * whole("fb")), F.lit(0)).cast("decimal(38,0)").alias("inner_product"))


def cosine_exact(pairs: DataFrame) -> DataFrame:
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    dot = F.sum(whole("fa") * whole("fb")).cast("double")
    norm = lambda c: F.sqrt(F.sum(whole(c) * whole(c)).cast("double"))
    return pairs.agg((dot / norm("fa") / norm("fb")).alias("cosine"))


def jaccard_exact(pairs: DataFrame) -> DataFrame:
    both = F.sum(F.when((F.col("fa") > 0) & (F.col("fb") > 0), 1).otherwise(0))
    return pairs.agg((both / F.count(F.lit(1))).alias("jaccard"))


def gsum_add_exact(pairs: DataFrame, g: G) -> DataFrame:
    return gsum_exact(pairs.select("key", (F.col("fa") + F.col("fb")).alias("f")), g)


def gsum_mul_exact(pairs: DataFrame, g: G) -> DataFrame:
    common = pairs.filter((F.col("fa") > 0) & (F.col("fb") > 0))
    return gsum_exact(common.select("key", (F.col("fa").cast("double") * F.col("fb")).alias("f")), g)


def _one_row(**parts: DataFrame) -> DataFrame:
    """Several one-row tables side by side."""
    joined = None
    for name, df in parts.items():
        one = df.select(F.col("gsum").alias(name)).withColumn("_one", F.lit(1))
        joined = one if joined is None else joined.join(F.broadcast(one), "_one")
    return joined.drop("_one")


def inner_product_est(a: Summary, b: Summary) -> DataFrame:
    """Half of what the square sum of the union exceeds the two square sums by."""
    row = _one_row(ab=extract_gsum_add(a, b, g1_sqr), a=extract_gsum(a, g1_sqr), b=extract_gsum(b, g1_sqr))
    return row.select(((F.col("ab") - F.col("a") - F.col("b")) / 2).alias("inner_product"))


def cosine_est(a: Summary, b: Summary) -> DataFrame:
    row = _one_row(ab=extract_gsum_add(a, b, g1_sqr), a=extract_gsum(a, g1_sqr), b=extract_gsum(b, g1_sqr))
    return row.select(
        ((F.col("ab") - F.col("a") - F.col("b")) / 2 / F.sqrt("a") / F.sqrt("b")).alias("cosine"))


def jaccard_est(a: Summary, b: Summary) -> DataFrame:
    row = _one_row(j=extract_gsum_mul(a, b, g1_one), a=extract_gsum(a, g1_one), b=extract_gsum(b, g1_one))
    return row.select((F.col("j") / (F.col("a") + F.col("b") - F.col("j"))).alias("jaccard"))


# --- one-permutation registers ----------------------------------------------------------

def maxlog_level(h: Column) -> Column:
    """``floor(-log2(h / 2^31))`` of a 31-bit value, from its binary length."""
    return (F.lit(31) - F.length(F.bin(h)) + F.when(h == 0, F.lit(1)).otherwise(F.lit(0))).cast("int")


def maxlog_build(stream: DataFrame, spec: SketchSpec) -> DataFrame:
    """Registers ``(bucket, lvl, unique)``: the largest level of the keys of a bucket, and
    whether a single key reaches it (its smallest and largest such key agree)."""
    text = is_text(stream)
    lvl = maxlog_level(hash_value(F.col("key"), spec.seed, "maxlog", text=text))
    bucket = hash_bucket(F.col("key"), spec.seed, spec.width, role="register", text=text)
    top = long_tasks(stream).select(bucket.alias("bucket"), lvl.alias("lvl"), "key").groupBy("bucket").agg(
        F.max(F.struct("lvl", "key")).alias("hi"), F.min(F.struct((-F.col("lvl")).alias("neg"), "key")).alias("lo"))
    return top.select("bucket", F.col("hi.lvl").alias("lvl"), (F.col("hi.key") == F.col("lo.key")).alias("unique"))


def maxlog_jaccard(a: DataFrame, b: DataFrame, spec: SketchSpec) -> DataFrame:
    """``1 - conflicts / (k * 0.7213)``; a conflict is a larger register reached by one key."""
    other = b.select("bucket", F.col("lvl").alias("lvl2"), F.col("unique").alias("unique2"))
    pair = a.join(other, "bucket", "full_outer").select(
        F.coalesce("lvl", F.lit(0)).alias("la"), F.coalesce("unique", F.lit(False)).alias("ua"),
        F.coalesce("lvl2", F.lit(0)).alias("lb"), F.coalesce("unique2", F.lit(False)).alias("ub"))
    conflict = ((F.col("la") > F.col("lb")) & F.col("ua")) | ((F.col("la") < F.col("lb")) & F.col("ub"))
    return pair.agg((F.lit(1.0) - F.coalesce(F.sum(conflict.cast("int")), F.lit(0)) /
                     F.lit(spec.width * UNIQUE_SHARE)).alias("jaccard"))
