"""Exact answers: counts, weighted sums, heavy hitters, set and order operators.

Everything starts from ``key_counts``: partial aggregation runs before the only shuffle, so a
hot key costs one row per input partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions.weights import g_cardinality, g_entropy, g_sqr, g_sum

G = Callable[[Column], Column]

# First-stage groups of a spread-out top-k; keeps the last stage at SPREAD * k rows per group.
SPREAD = 64
# Per-group cutoffs are broadcast up to this many groups; more groups are small anyway.
BROADCAST_GROUPS = 1_000_000
# Parts in which the numbers of a stream are counted at a time, to find a cut.
LIMIT_BINS = 4096
# Keys of a hash part, about; the frequent-items aggregate tracks at most a million.
PART_KEYS = 200_000
# Up to so many rows of a group Spark cuts a ranking inside each task, before the shuffle.
RANK_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
# Up to here every task simply hands on its first rows.
SMALL_LIMIT = 1000


def keyed_stream(df: DataFrame, key: str | Column, seq: str | Column | None = None,
                 weight: str | Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Any table becomes a stream: a key, a weight, and optionally an arrival number.

    Rows without a key, and without a number where one is asked for, are no arrivals and are left out.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    cols = [as_col(key).alias("key")]
    if seq is not None:
        cols.append(as_col(seq).cast("bigint").alias("seq"))
    cols.append((F.lit(1) if weight is None else as_col(weight)).cast("bigint").alias("weight"))
    stream = df.select(*carry, *cols)
    return stream.filter("key IS NOT NULL" if seq is None else "key IS NOT NULL AND seq IS NOT NULL")


def read_limit(stream: DataFrame, n: int, bins: int = LIMIT_BINS) -> DataFrame:
    """First ``n`` arrivals by ``seq``; -1 keeps all. Of equal numbers at the cut any stay.

    Large cuts never sort the stream: its range of numbers is counted in ``bins`` equal parts, then the part that
    holds the cut, and so on, until what is left of it is small or one number. Each step is one count with at
    most ``bins`` rows, however sparse the numbers are.
    """
    if n < 0:
        return stream
    if n <= SMALL_LIMIT:
        return stream.orderBy("seq").limit(n)
    ends = stream.agg(F.min("seq").alias("a"), F.max("seq").alias("z")).first()
    low, high, wanted = ends.a, ends.z, n
    while low is not None:
        width = -(-(high - low + 1) // bins)
        inside = stream.filter((F.col("seq") >= low) & (F.col("seq") <= high))
        part = F.expr(f"CAST((CAST(seq AS DECIMAL(20,0)) - ({low})) DIV {width} AS BIGINT)")
        counts = sorted((r.part, r.n) for r in inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
        held = 0
        for place, count in counts:
            if held + count > wanted:
                break
            held += count
        else:
            return stream  # no more rows than wanted
        low, high, wanted = low + place * width, min(low + (place + 1) * width - 1, high), wanted - held
        if wanted == 0:
            return stream.filter(F.col("seq") < low)
        if width == 1 or count <= SMALL_LIMIT:
            rest = stream.filter((F.col("seq") >= low) & (F.col("seq") <= high))
            rest = rest.orderBy("seq").limit(wanted) if low < high else rest.limit(wanted)
            return stream.filter(F.col("seq") < low).unionByName(rest)
    return stream


def key_counts(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Frequency of every key: ``(by..., key, f)``."""
    return stream.groupBy(*by, "key").agg(F.sum("weight").alias("f"))


def stream_totals(counts: DataFrame) -> DataFrame:
    """Arrivals and distinct keys, as one row."""
    return counts.agg(
        F.coalesce(F.sum("f"), F.lit(0)).cast("bigint").alias("packets"),
        F.count(F.lit(1)).alias("flows"),
    )


def gsum_exact(counts: DataFrame, g: G, by: Sequence[str] = ()) -> DataFrame:
    """``sum g(f)`` over all keys.

    Summed over the histogram of frequencies, so that each distinct frequency enters once.
    """
    sizes = counts.groupBy(*by, "f").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*by).agg(
        F.coalesce(F.sum(g(F.col("f")) * F.col("n")), F.lit(0.0)).alias("gsum")
    )


def gsum_exact_subset(counts: DataFrame, g: G, check: G) -> DataFrame:
    return gsum_exact(filter_subset(counts, check), g)


def gsum_all(counts: DataFrame) -> DataFrame:
    """Cardinality, sum, entropy and square sum in one pass."""
    sizes = counts.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    named = {"cardinality": g_cardinality, "total": g_sum, "entropy": g_entropy, "self_join": g_sqr}
    return sizes.agg(*[
        F.coalesce(F.sum(g(F.col("f")) * F.col("n")), F.lit(0.0)).alias(name)
        for name, g in named.items()
    ])


def entropy_exact(counts: DataFrame) -> DataFrame:
    """Shannon entropy in bits of the key distribution."""
    sizes = counts.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(F.col("f") * F.col("n")).cast("double")
    weighted = F.sum(g_entropy(F.col("f")) * F.col("n"))
    return sizes.agg((F.log2(total) - weighted / total).alias("entropy"))


def with_total(counts: DataFrame, total: Column, name: str) -> DataFrame:
    """Attach a one-row aggregate of ``counts`` to each of its rows."""
    return counts.withColumn(name, counts.agg(total.alias(name)).scalar())


def g_weight_share(counts: DataFrame, g: G) -> DataFrame:
    """Weight of each key and its share of the total weight."""
    weighted = counts.select("key", "f", g(F.col("f")).alias("g"))
    return with_total(weighted, F.sum("g"), "_total").select(
        "key", "f", "g", (F.col("g") / F.col("_total")).alias("share"))


def heavy_hitters_exact(counts: DataFrame, g: G, lam: float, strict: bool = False) -> DataFrame:
    """Keys whose weight reaches the share ``lam`` of the total weight, heaviest first.

    The threshold is cut to an integer. One rule everywhere: ``>=``; ``strict`` asks for ``>``.
    """
    weighted = counts.select("key", "f", g(F.col("f")).alias("g"))
    marked = with_total(weighted, F.floor(F.sum("g") * F.lit(lam)), "threshold")
    keep = F.col("g") > F.col("threshold") if strict else F.col("g") >= F.col("threshold")
    return marked.filter(keep).orderBy(F.desc("g"), F.desc("key"))


def freq_histogram(counts: DataFrame) -> DataFrame:
    """How many keys have each frequency."""
    return counts.groupBy("f").agg(F.count(F.lit(1)).alias("n"))


def filter_threshold(counts: DataFrame, threshold: int, strict: bool = False,
                     value: str = "f") -> DataFrame:
    v = F.col(value)
    return counts.filter(v > threshold if strict else v >= threshold)


def filter_subset(df: DataFrame, check: G, key: str = "key") -> DataFrame:
    return df.filter(check(F.col(key)))


def filter_prefix(df: DataFrame, base: int, length: int, key: str = "key",
                  bits: int = 32) -> DataFrame:
    """Keys whose top ``length`` of ``bits`` bits equal those of ``base``; 0 keeps all."""
    if length == 0:
        return df
    return df.filter(F.shiftrightunsigned(F.col(key), bits - length) == F.lit(base >> (bits - length)))


def split_streams_blocks(stream: DataFrame, block: int) -> DataFrame:
    """Alternate blocks of arrivals between stream A and stream B."""
    odd = F.floor(F.col("seq") / F.lit(block)) % 2
    return stream.withColumn("stream", F.when(odd == 0, F.lit("A")).otherwise(F.lit("B")))


def split_streams_halves(stream: DataFrame) -> DataFrame:
    """First half of the arrivals is A, second half B (``seq`` counts from 0)."""
    half = with_total(stream, F.count(F.lit(1)), "_n")
    return half.withColumn(
        "stream", F.when(F.col("seq") < F.col("_n") / 2, F.lit("A")).otherwise(F.lit("B"))
    ).drop("_n")


def trace_duration(trace: DataFrame) -> DataFrame:
    """Time of the last arrival minus time of the first, by arrival order."""
    return trace.agg((F.max_by("ts", "seq") - F.min_by("ts", "seq")).alias("duration"))


def counts_sorted(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("f"), F.desc("key"))


def topk_exact(counts: DataFrame, k: int) -> DataFrame:
    return counts_sorted(counts).limit(k)


def value_cutoffs(df: DataFrame, group: Sequence[str], value: str, k: int) -> DataFrame:
    """The k-th largest value of every group (or its smallest): ``(group..., _cut)``.

    Found on the histogram of values, which is small for counts: n arrivals have at most about
    sqrt(2 n) different ones.
    """
    larger = Window.partitionBy(*group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    reached = sizes.withColumn("_larger", F.coalesce(F.sum("_n").over(larger), F.lit(0))).filter(F.col("_larger") < k)
    return reached.groupBy(*group).agg(F.min(value).alias("_cut"))


def cut_before_shuffle(spark: SparkSession, k: int) -> None:
    """Let Spark keep only the ``k`` first rows of each group and task before it shuffles them for a ranking."""
    if int(spark.conf.get(RANK_LIMIT)) < k:
        spark.conf.set(RANK_LIMIT, str(k))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  spread_on: Sequence[str], spread: int = SPREAD, value: str | None = None,
                  groups: int = 0) -> DataFrame:
    """The ``k`` first rows of every group, in two ranked stages.

    Groups may be few and huge, so each is first cut inside ``spread`` hash parts; the second
    stage sees at most ``spread * k`` rows of a group. Where the order is by a count ``value``,
    largest first, rows below the k-th largest value are dropped before anything is sorted;
    the cutoffs, one row per group, are broadcast while the number of ``groups`` allows.
    """
    if value is not None and groups <= BROADCAST_GROUPS:
        cutoffs = F.broadcast(value_cutoffs(df, group, value, k))
        df = df.join(cutoffs, list(group)).filter(F.col(value) >= F.col("_cut")).drop("_cut")
    part = F.pmod(F.xxhash64(*spread_on), F.lit(spread)).cast("int")
    cut_before_shuffle(df.sparkSession, k)
    local = Window.partitionBy(*group, "_part").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= k)
        .withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
        .drop("_part", "_rank")
    )


def topk_builtin(stream: DataFrame, k: int, tracked: int, by: Sequence[str] = ()) -> DataFrame:
    """Spark's own frequent-items aggregate; exact while ``tracked`` covers the distinct keys of each ``by``."""
    tops = stream.groupBy(*by).agg(F.expr(f"approx_top_k(key, {int(k)}, {int(tracked)})").alias("top"))
    return tops.select(F.inline("top")).select(
        F.col("item").alias("key"), F.col("count").cast("bigint").alias("f"))


def topk_builtin_merged(stream: DataFrame, by: str, k: int, tracked: int, parts: Sequence[str] = ()) -> DataFrame:
    """The same through stored per-group states, combined afterwards (within each of ``parts``)."""
    states = stream.groupBy(*parts, by).agg(
        F.expr(f"approx_top_k_accumulate(key, {int(tracked)})").alias("state"))
    merged = states.groupBy(*parts).agg(F.expr(f"approx_top_k_combine(state, {int(tracked)})").alias("state"))
    return merged.select(
        F.explode(F.expr(f"approx_top_k_estimate(state, {int(k)})")).alias("top")
    ).select(F.col("top.item").alias("key"), F.col("top.count").cast("bigint").alias("f"))


def distinct_keys(stream: DataFrame) -> int:
    """How many keys a stream has, 1 at least: the room in which a bounded summary keeps all of them."""
    return max(1, stream.select("key").distinct().count())


def dealt_keys(stream: DataFrame, part_keys: int = PART_KEYS) -> tuple[DataFrame, int]:
    """``stream`` with the hash part of its key, ``_part``, and the distinct keys of the fullest part, 1 at least."""
    parts = -(-distinct_keys(stream) // part_keys)
    dealt = stream.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    fullest = dealt.select("_part", "key").distinct().groupBy("_part").count().agg(F.max("count")).first()[0]
    return dealt, fullest or 1


def keys_distinct(stream: DataFrame) -> DataFrame:
    return stream.select("key").distinct()


def keys_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").union(b.select("key")).distinct()


def keys_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").intersect(b.select("key"))


def keys_only_in_a(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").distinct().join(b.select("key").distinct(), "key", "left_anti")
