"""Sources, projections, filters, exact aggregates, sorts and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.weights import WEIGHTS, g2_mul
from tallyweave.operators import exact as X
from tallyweave.operators import flow as W
from tallyweave.operators import twostream as T
from tallyweave.plans import streams as S
from tallyweave.plans.registry import query
from tallyweave.plans.sqltext import chain, g_sql

LAMBDA = 0.0006


def part_counts(spark, d):
    return X.key_counts(S.parts(spark, d))


PART_COUNTS = S.counts_sql(S.PARTS)


# --- streams and filters ----------------------------------------------------------------

@query("keyed_stream", S.USERS)
def _(spark, d):
    return S.users(spark, d)


@query("read_limit", f"SELECT * FROM ({S.USERS}) ORDER BY seq LIMIT 2500")
def _(spark, d):
    return X.read_limit(S.users(spark, d), 2500)


@query("read_limit_large", f"SELECT * FROM ({S.CUSTOMERS}) ORDER BY seq LIMIT 7321")
def _(spark, d):
    return X.read_limit(S.customers(spark, d), 7321, bins=64)


@query("read_limit_all", f"SELECT count(*) AS n FROM ({S.USERS})")
def _(spark, d):
    return X.read_limit(S.users(spark, d), -1).agg(F.count(F.lit(1)).alias("n"))


def flow_counts(trace, choice):
    """Arrivals per key, the key's fields as columns."""
    fields = W.KEY_CHOICES[choice]
    counts = X.key_counts(W.project_flow_key(trace, choice))
    return counts.select("key.*", "f") if len(fields) > 1 else counts.select(F.col("key").alias(fields[0]), "f")


for _choice, _fields in W.KEY_CHOICES.items():
    @query(f"project_flow_key_{_choice}",
           f"SELECT {', '.join(_fields)}, count(*) AS f FROM ({S.TRACE}) GROUP BY ALL")
    def _(spark, d, choice=_choice):
        return flow_counts(S.trace(spark, d), choice)


@query("key_src_dst", f"SELECT seq, (dst_ip << 32) | src_ip AS key FROM ({S.TRACE})")
def _(spark, d):
    return S.trace(spark, d).select("seq", W.key_src_dst().alias("key"))


@query("key_src_port", f"SELECT seq, (src_ip << 32) | src_port AS key FROM ({S.TRACE})")
def _(spark, d):
    return S.trace(spark, d).select("seq", W.key_src_port().alias("key"))


@query("key_dst_port", f"SELECT seq, (dst_ip << 32) | dst_port AS key FROM ({S.TRACE})")
def _(spark, d):
    return S.trace(spark, d).select("seq", W.key_dst_port().alias("key"))


@query("set_flow_field", f"SELECT seq, src_ip, dst_ip, src_port, 8080::BIGINT AS dst_port, proto, ts FROM ({S.TRACE})")
def _(spark, d):
    return W.set_flow_field(S.trace(spark, d), 3, 8080)


@query("drop_empty_tuples", f"SELECT * FROM ({S.TRACE}) WHERE src_ip <> 0 OR dst_ip <> 0 OR src_port <> 0 "
                            "OR dst_port <> 0 OR proto <> 0")
def _(spark, d):
    return W.drop_empty_tuples(S.trace(spark, d))


@query("flow_order", f"SELECT src_ip, dst_ip, src_port, dst_port, proto, seq FROM ({S.TRACE}) ORDER BY ALL")
def _(spark, d):
    return W.flow_order(S.trace(spark, d).select(*W.FLOW_FIELDS, "seq"))


@query("filter_prefix", f"SELECT key, f FROM ({PART_COUNTS}) WHERE key >> (32 - 24) = 256 >> 8")
def _(spark, d):
    return X.filter_prefix(part_counts(spark, d), base=256, length=24)


@query("filter_prefix_all", PART_COUNTS)
def _(spark, d):
    return X.filter_prefix(part_counts(spark, d), base=0, length=0)


@query("filter_subset", f"SELECT key, f FROM ({PART_COUNTS}) WHERE key % 3 = 1")
def _(spark, d):
    return X.filter_subset(part_counts(spark, d), lambda k: k % 3 == 1)


@query("filter_threshold", f"SELECT key, f FROM ({PART_COUNTS}) WHERE f >= 35")
def _(spark, d):
    return X.filter_threshold(part_counts(spark, d), 35)


@query("filter_threshold_strict", f"SELECT key, f FROM ({PART_COUNTS}) WHERE f > 35")
def _(spark, d):
    return X.filter_threshold(part_counts(spark, d), 35, strict=True)


@query("split_streams_blocks", f"SELECT stream, count(*) AS n, count(DISTINCT key) AS flows FROM ({S.CUSTOMERS_AB}) GROUP BY stream")
def _(spark, d):
    return S.customers_ab(spark, d).groupBy("stream").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("flows"))


@query("split_streams_halves", f"SELECT *, CASE WHEN seq < (SELECT count(*) FROM events) / 2 THEN 'A' ELSE 'B' END AS stream FROM ({S.USERS})")
def _(spark, d):
    return X.split_streams_halves(S.users(spark, d))


@query("trace_duration", f"SELECT arg_max(ts, seq) - arg_min(ts, seq) AS duration FROM ({S.TRACE})")
def _(spark, d):
    return X.trace_duration(S.trace(spark, d))


# --- exact aggregates -------------------------------------------------------------------

@query("key_counts", PART_COUNTS)
def _(spark, d):
    return part_counts(spark, d)


@query("key_counts_weighted", S.counts_sql(S.PART_QUANTITIES))
def _(spark, d):
    return X.key_counts(S.part_quantities(spark, d))


@query("key_counts_text", S.counts_sql(S.WORDS))
def _(spark, d):
    return X.key_counts(S.words(spark, d))


@query("stream_totals", f"SELECT count(*) AS packets, count(DISTINCT key) AS flows FROM ({S.PARTS})")
def _(spark, d):
    return X.stream_totals(part_counts(spark, d))


def _gsum_sql(g, where="TRUE"):
    return f"SELECT round(sum({g_sql(g, 'f')}), 6) AS gsum FROM ({PART_COUNTS}) WHERE {where}"


def rounded(df, *names, digits=6):
    """The named double columns rounded, as the oracles do."""
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("gsum_exact", chain(
    "SELECT round(sum(n * " + g_sql("entropy", "f") + "), 6) AS gsum FROM h",
    c=S.counts_sql(S.WORDS), h="SELECT f, count(*) AS n FROM c GROUP BY f"))
def _(spark, d):
    return rounded(X.gsum_exact(X.key_counts(S.words(spark, d)), WEIGHTS["entropy"]), "gsum")


for _g in WEIGHTS:
    @query(f"gsum_exact_{_g}", _gsum_sql(_g))
    def _(spark, d, g=_g):
        return rounded(X.gsum_exact(part_counts(spark, d), WEIGHTS[g]), "gsum")


@query("gsum_exact_subset", _gsum_sql("entropy", "key % 10 < 4"))
def _(spark, d):
    return rounded(X.gsum_exact_subset(part_counts(spark, d), WEIGHTS["entropy"], lambda k: k % 10 < 4), "gsum")


@query("gsum_all", f"SELECT {', '.join(f'round(sum({g_sql(g, chr(102))}), 6) AS {n}' for g, n in (('cardinality', 'cardinality'), ('sum', 'total'), ('entropy', 'entropy'), ('sqr', 'self_join')))} FROM ({PART_COUNTS})")
def _(spark, d):
    return rounded(X.gsum_all(part_counts(spark, d)), "cardinality", "total", "entropy", "self_join")


ENTROPY_SQL = "SELECT round(log2(sum(f)) - sum(f * log2(f)) / sum(f), 6) AS entropy FROM ({})"


@query("entropy_exact", ENTROPY_SQL.format(PART_COUNTS))
def _(spark, d):
    return rounded(X.entropy_exact(part_counts(spark, d)), "entropy")


@query("g_weight_share", f"SELECT key, f, round({g_sql('sqr', 'f')}, 6) AS g, "
       f"round({g_sql('sqr', 'f')} / (SELECT sum({g_sql('sqr', 'f')}) FROM ({PART_COUNTS})), 9) AS share FROM ({PART_COUNTS})")
def _(spark, d):
    return rounded(rounded(X.g_weight_share(part_counts(spark, d), WEIGHTS["sqr"]), "g"), "share", digits=9)


@query("freq_histogram", f"SELECT f, count(*) AS n FROM ({PART_COUNTS}) GROUP BY f")
def _(spark, d):
    return X.freq_histogram(part_counts(spark, d))


@query("heavy_hitters_exact", chain(
    "SELECT key, f, g, threshold FROM c, t WHERE g >= threshold",
    c=f"SELECT key, f, {g_sql('sqr', 'f')} AS g FROM ({PART_COUNTS})",
    t=f"SELECT floor(sum(g) * {LAMBDA})::BIGINT AS threshold FROM c"))
def _(spark, d):
    return X.heavy_hitters_exact(part_counts(spark, d), WEIGHTS["sqr"], LAMBDA)


# --- order and sets ---------------------------------------------------------------------

@query("counts_sorted", f"SELECT key, f FROM ({PART_COUNTS}) ORDER BY f DESC, key DESC")
def _(spark, d):
    return X.counts_sorted(part_counts(spark, d))


@query("topk_exact", f"SELECT key, f FROM ({S.counts_sql(S.WORDS)}) ORDER BY f DESC, key DESC LIMIT 50")
def _(spark, d):
    return X.topk_exact(X.key_counts(S.words(spark, d)), 50)


@query("topk_builtin", S.counts_sql(S.SUPPLIERS))
def _(spark, d):
    """Room for every key, however many there are, as all counts are asked for."""
    dealt, most = X.dealt_keys(S.suppliers(spark, d))
    return X.topk_builtin(dealt, k=most, tracked=most, by=["_part"])


@query("topk_builtin_merged", S.counts_sql("SELECT event_type AS key, 1::BIGINT AS weight FROM events"))
def _(spark, d):
    events = S.table(spark, d, "events")
    stream = X.keyed_stream(events.withColumn("part", F.col("event_id") % 16), "event_type", carry=["part"])
    dealt, most = X.dealt_keys(stream)
    return X.topk_builtin_merged(dealt, "part", k=most, tracked=most, parts=["_part"])


def _ab_keys(spark, d):
    both = S.customers_ab(spark, d)
    return S.side(both, "A"), S.side(both, "B")


A, B = S.side_sql(S.CUSTOMERS_AB, "A"), S.side_sql(S.CUSTOMERS_AB, "B")


@query("keys_distinct", "SELECT DISTINCT o_custkey AS key FROM orders")
def _(spark, d):
    return X.keys_distinct(S.customers(spark, d))


@query("keys_union", f"SELECT key FROM ({A}) UNION SELECT key FROM ({B})")
def _(spark, d):
    return X.keys_union(*_ab_keys(spark, d))


@query("keys_intersect", f"SELECT key FROM ({A}) INTERSECT SELECT key FROM ({B})")
def _(spark, d):
    return X.keys_intersect(*_ab_keys(spark, d))


@query("keys_only_in_a", f"SELECT key FROM ({A}) EXCEPT SELECT key FROM ({B})")
def _(spark, d):
    return X.keys_only_in_a(*_ab_keys(spark, d))


# --- two streams, exact -----------------------------------------------------------------

PAIRS = ("SELECT key, sum(CASE WHEN stream = 'A' THEN weight ELSE 0 END)::BIGINT AS fa, "
         f"sum(CASE WHEN stream = 'B' THEN weight ELSE 0 END)::BIGINT AS fb FROM ({S.CUSTOMERS_AB}) GROUP BY key")


def pairs(spark, d):
    return T.pair_counts(S.customers_ab(spark, d))


@query("pair_counts", PAIRS)
def _(spark, d):
    return pairs(spark, d)


@query("join_counts", PAIRS)
def _(spark, d):
    return T.join_counts(*(X.key_counts(s) for s in _ab_keys(spark, d)))


@query("gsum2_exact", f"SELECT round(sum(CASE WHEN fa > 0 AND fb > 0 THEN fa * fb ELSE 0 END)::DOUBLE, 6) AS gsum FROM ({PAIRS}) WHERE fa > 0")
def _(spark, d):
    return rounded(T.gsum2_exact(pairs(spark, d), g2_mul), "gsum")


@query("inner_product_exact", f"SELECT TRY_CAST(p AS BIGINT) AS inner_product, CAST(p AS VARCHAR) AS digits FROM (SELECT coalesce(sum(fa::HUGEINT * fb), 0) AS p FROM ({PAIRS}))")
def _(spark, d):
    """As a BIGINT, null beyond 64 bits, and with all digits."""
    return T.inner_product_exact(pairs(spark, d)).select(
        F.col("inner_product").try_cast("bigint").alias("inner_product"), F.col("inner_product").cast("string").alias("digits"))


@query("cosine_exact", f"SELECT round(sum(fa * fb) / sqrt(sum(fa * fa)) / sqrt(sum(fb * fb)), 9) AS cosine FROM ({PAIRS})")
def _(spark, d):
    return rounded(T.cosine_exact(pairs(spark, d)), "cosine", digits=9)


@query("jaccard_exact", f"SELECT round(count(*) FILTER (fa > 0 AND fb > 0) / count(*), 9) AS jaccard FROM ({PAIRS})")
def _(spark, d):
    return rounded(T.jaccard_exact(pairs(spark, d)), "jaccard", digits=9)


@query("gsum_add_exact", f"SELECT round(sum({g_sql('entropy', 'fa + fb')}), 6) AS gsum FROM ({PAIRS})")
def _(spark, d):
    return rounded(T.gsum_add_exact(pairs(spark, d), WEIGHTS["entropy"]), "gsum")


@query("gsum_mul_exact", f"SELECT round(sum({g_sql('entropy', 'fa * fb')}), 6) AS gsum FROM ({PAIRS}) WHERE fa > 0 AND fb > 0")
def _(spark, d):
    return rounded(T.gsum_mul_exact(pairs(spark, d), WEIGHTS["entropy"]), "gsum")
