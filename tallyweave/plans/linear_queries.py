"""Hash functions, medians and linear sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import hashing as H
from tallyweave.functions.medians import median_of_group
from tallyweave.functions.weights import g1_one, g1_sqr, g1_sum, g2_mul, WEIGHTS
from tallyweave.operators import linear as L
from tallyweave.operators import salsa as A
from tallyweave.operators.exact import key_counts
from tallyweave.plans import sqltext as Q
from tallyweave.plans import streams as S
from tallyweave.plans.exact_queries import rounded
from tallyweave.plans.registry import query
from tallyweave.spec import SketchSpec

SPEC = SketchSpec(rows=5, width=256, seed=11)
EVEN = SketchSpec(rows=4, width=256, seed=12)
WORD_SPEC = SketchSpec(rows=5, width=512, seed=13)
SALSA = SketchSpec(rows=3, width=250, seed=14)


# --- scalar functions -------------------------------------------------------------------

def _signed_keys(spark, d):
    """Part keys spread over all 64 bits, negatives included; products beyond them keep their lowest 64 bits."""
    # In halves of 32 bits, where no step passes 64; exact while part keys are below 2^31.
    halves = S.table(spark, d, "lineitem").selectExpr(
        "l_partkey - 700 AS a", "shiftright((l_suppkey + 1) * 4000000007L, 32) AS high", "(l_suppkey + 1) * 4000000007L & 4294967295L AS low")
    carried = "a * high + shiftright(a * low, 32)"
    return halves.selectExpr(f"shiftleft({carried}, 32) | (a * low & 4294967295L) AS key")


SIGNED_KEYS = "SELECT (l_partkey - 700) * 4000000007 * (l_suppkey + 1) AS key FROM lineitem"


@query("hash_bucket", f"SELECT key, {Q.bucket_sql('key', 5, 1000)} AS bucket, {Q.sign_sql('key', 5, 'sign')} AS sign, "
       f"{Q.one_hash('key', 5, 'bit')} & 1 AS bit FROM ({SIGNED_KEYS})")
def _(spark, d):
    k = F.col("key")
    return _signed_keys(spark, d).select(
        "key", H.hash_bucket(k, 5, 1000).alias("bucket"), H.hash_sign(k, 5).alias("sign"), H.hash_bit(k, 5).alias("bit"))


@query("hash_bucket_text", f"SELECT key, {Q.bucket_sql('key', 5, 1000, text=True)} AS bucket FROM (SELECT DISTINCT key FROM ({S.WORDS}))")
def _(spark, d):
    return S.words(spark, d).select("key").distinct().select(
        "key", H.hash_bucket(F.col("key"), 5, 1000, text=True).alias("bucket"))


_lin, _lanes = H.hash_fn(5, "linear"), H.lanes_sql("key")


@query("hash_two_universal", f"SELECT key, ({_lin.a0} * {_lanes[0]} + {_lin.a1} * {_lanes[1]} + {_lin.a2} * {_lanes[2]} + {_lin.b}) "
       f"% {H.PRIME} % 1000 AS bucket FROM ({SIGNED_KEYS})")
def _(spark, d):
    return _signed_keys(spark, d).select("key", H.hash_two_universal(F.col("key"), 5, 1000).alias("bucket"))


@query("uniform_from_seed", f"SELECT event_id AS key, round(({Q.one_hash('event_id', 5, 'uniform')} + 0.5)::DOUBLE / {H.PRIME}.0::DOUBLE, 9) AS u FROM events")
def _(spark, d):
    return rounded(S.table(spark, d, "events").select(
        F.col("event_id").alias("key"), H.uniform_from_seed(F.col("event_id"), 5).alias("u")), "u", digits=9)


@query("g_functions", f"SELECT x, {', '.join(f'round({Q.g_sql(g, chr(120))}, 6) AS g_{g}' for g in WEIGHTS)} FROM (SELECT l_partkey - 500 AS x FROM lineitem)")
def _(spark, d):
    x = S.table(spark, d, "lineitem").select((F.col("l_partkey") - 500).alias("x"))
    return x.select("x", *[F.round(g(F.col("x")), 6).alias(f"g_{n}") for n, g in WEIGHTS.items()])


@query("g_positive_functions", "SELECT x, y, CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END AS one, CASE WHEN x > 0 THEN x::DOUBLE ELSE 0 END AS total, "
       "CASE WHEN x > 0 THEN x::DOUBLE * x ELSE 0 END AS sqr, CASE WHEN x > 0 AND y > 0 THEN x::DOUBLE * y ELSE 0 END AS mul "
       "FROM (SELECT l_partkey - 500 AS x, l_suppkey - 50 AS y FROM lineitem)")
def _(spark, d):
    t = S.table(spark, d, "lineitem").select((F.col("l_partkey") - 500).alias("x"), (F.col("l_suppkey") - 50).alias("y"))
    x, y = F.col("x"), F.col("y")
    return t.select("x", "y", g1_one(x).alias("one"), g1_sum(x).alias("total"), g1_sqr(x).alias("sqr"), g2_mul(x, y).alias("mul"))


@query("median_of_rows", "SELECT l_orderkey AS key, median(l_partkey)::DOUBLE AS med FROM lineitem GROUP BY 1")
def _(spark, d):
    lines = S.table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("key")).agg(median_of_group(F.col("l_partkey")).alias("med"))


# --- Count-Sketch -----------------------------------------------------------------------

CELLS = Q.cells(S.PARTS, SPEC, "count")


def _parts_sketch(spark, d, spec=SPEC):
    return L.count_sketch_build(S.parts(spark, d), spec)


@query("count_sketch_build", CELLS)
def _(spark, d):
    return _parts_sketch(spark, d)


@query("count_sketch_build_text", Q.cells(S.WORDS, WORD_SPEC, "count", text=True))
def _(spark, d):
    return L.count_sketch_build(S.words(spark, d), WORD_SPEC)


@query("count_sketch_query", Q.chain(Q.estimates(S.PARTS, "t", SPEC, "count"), t=CELLS))
def _(spark, d):
    return L.count_sketch_query(S.parts(spark, d).select("key").distinct(), _parts_sketch(spark, d), SPEC)


@query("count_sketch_query_even", Q.chain(Q.estimates(S.PARTS, "t", EVEN, "count"), t=Q.cells(S.PARTS, EVEN, "count")))
def _(spark, d):
    return L.count_sketch_query(S.parts(spark, d).select("key").distinct(), _parts_sketch(spark, d, EVEN), EVEN)


@query("count_sketch_query_text", Q.chain(Q.estimates(S.WORDS, "t", WORD_SPEC, "count", True),
                                          t=Q.cells(S.WORDS, WORD_SPEC, "count", text=True)))
def _(spark, d):
    words = S.words(spark, d)
    return L.count_sketch_query(words.select("key").distinct(), L.count_sketch_build(words, WORD_SPEC), WORD_SPEC)


@query("count_sketch_f2", Q.chain("SELECT median(s)::DOUBLE AS f2 FROM (SELECT row, sum(v * v)::BIGINT AS s FROM t GROUP BY row)", t=CELLS))
def _(spark, d):
    return L.count_sketch_f2(_parts_sketch(spark, d))


@query("sketch_merge", Q.cells(f"{S.PARTS} UNION ALL SELECT o_custkey AS key, 1::BIGINT AS weight FROM orders", SPEC, "count"))
def _(spark, d):
    return L.sketch_merge(_parts_sketch(spark, d), L.count_sketch_build(S.customers(spark, d), SPEC))


@query("sketch_epochs", Q.chain(
    f"SELECT epoch, row, (h >> 1) % {SPEC.width} AS idx, sum(1 - 2 * (h & 1))::BIGINT AS v FROM t GROUP BY ALL HAVING v <> 0",
    t=f"SELECT seq // 2000 AS epoch, c.row, {Q.table_hash('s.key', False)} AS h FROM ({S.USERS}) s CROSS JOIN {Q.values(SPEC.seed, 'count', SPEC.rows)}"))
def _(spark, d):
    from tallyweave.streaming.summaries import reset_epoch
    return L.count_sketch_build(reset_epoch(S.users(spark, d), 2000), SPEC, by=["epoch"])


# --- Count-Min, k-ary -------------------------------------------------------------------

MIN_CELLS = Q.cells(S.PARTS, SPEC, "min", signed=False)
MIN_PROBES = Q.probes(S.PARTS, "t", SPEC, "min", signed=False)


@query("count_min_build", MIN_CELLS)
def _(spark, d):
    return L.count_min_build(S.parts(spark, d), SPEC)


@query("count_min_query", Q.chain(f"SELECT key, min(x)::BIGINT AS est FROM ({MIN_PROBES}) GROUP BY key", t=MIN_CELLS))
def _(spark, d):
    stream = S.parts(spark, d)
    return L.count_min_query(stream.select("key").distinct(), L.count_min_build(stream, SPEC), SPEC)


SHARED = f"SELECT 0 AS row, idx, sum(v)::BIGINT AS v FROM ({MIN_CELLS}) GROUP BY idx"


@query("count_min_shared_build", SHARED)
def _(spark, d):
    return L.count_min_build(S.parts(spark, d), SPEC, shared_row=True)


@query("count_min_shared_query", Q.chain(
    f"SELECT key, min(x)::BIGINT AS est FROM ({MIN_PROBES}) GROUP BY key", shared=SHARED,
    t=f"SELECT r.row, s.idx, s.v FROM shared s CROSS JOIN (SELECT unnest(range({SPEC.rows})) AS row) r"))
def _(spark, d):
    stream = S.parts(spark, d)
    return L.count_min_query(stream.select("key").distinct(), L.count_min_build(stream, SPEC, True), SPEC, True)


def _kary(cell_table: str, total: str, keys: str) -> str:
    fix = f"(x - ({total})::DOUBLE / {SPEC.width}.0) / (1.0 - 1.0 / {SPEC.width}.0)"
    return f"SELECT key, round(median({fix}), 6) AS est FROM ({Q.probes(keys, cell_table, SPEC, 'kary', signed=False)}) GROUP BY key"


@query("kary_build", Q.cells(S.PART_QUANTITIES, SPEC, "kary", signed=False))
def _(spark, d):
    return L.kary_build(S.part_quantities(spark, d), SPEC)


@query("kary_query", Q.chain(_kary("t", "SELECT sum(v) FROM t WHERE row = 0", S.PARTS),
                             t=Q.cells(S.PART_QUANTITIES, SPEC, "kary", signed=False)))
def _(spark, d):
    stream = S.part_quantities(spark, d)
    return rounded(L.kary_query(stream.select("key").distinct(), L.kary_build(stream, SPEC), SPEC), "est")


_cust_a, _cust_b = S.side_sql(S.CUSTOMERS_AB, "A"), S.side_sql(S.CUSTOMERS_AB, "B")


@query("kary_copy_config", Q.chain(
    _kary("t", "SELECT coalesce(sum(v), 0) FROM t WHERE row = 0", S.CUSTOMERS),
    t=Q.cells(f"SELECT key, -weight AS weight FROM ({_cust_a}) UNION ALL {_cust_b}", SPEC, "kary", signed=False)))
def _(spark, d):
    both = S.customers_ab(spark, d)
    before, after = (L.kary_build(S.side(both, s), SPEC) for s in ("A", "B"))
    return rounded(L.kary_change(both.select("key").distinct(), before, after, SPEC), "est")


# --- AGMS and fast AGMS -----------------------------------------------------------------

AGMS_ROWS, AGMS_WIDTH, AGMS_SEED = 4, 20, 15


def _agms_sql(stream: str) -> str:
    blocks = (AGMS_ROWS * AGMS_WIDTH + 29) // 30
    hashes = ", ".join(f"{Q.one_hash('key', AGMS_SEED, 'agms', row=j)}" for j in range(blocks))
    return (f"SELECT (c // {AGMS_WIDTH})::INTEGER AS row, c % {AGMS_WIDTH} AS idx, "
            f"sum((1 - 2 * ((hs[c // 30 + 1] >> (c % 30)) & 1)) * weight)::BIGINT AS v "
            f"FROM (SELECT [{hashes}] AS hs, weight FROM ({stream})) "
            f"CROSS JOIN (SELECT unnest(range({AGMS_ROWS * AGMS_WIDTH})) AS c) GROUP BY ALL")


def _agms(stream):
    return L.agms_build(stream, AGMS_ROWS, AGMS_WIDTH, AGMS_SEED)


@query("agms_build", _agms_sql(S.CUSTOMERS))
def _(spark, d):
    return _agms(S.customers(spark, d))


@query("agms_join", Q.chain("SELECT round(sum(a.v * b.v)::DOUBLE / count(*), 6) AS join_size FROM a JOIN b USING (row, idx)",
                            a=_agms_sql(_cust_a), b=_agms_sql(_cust_b)))
def _(spark, d):
    both = S.customers_ab(spark, d)
    return rounded(L.agms_join(*(_agms(S.side(both, s)) for s in ("A", "B"))), "join_size")


def both_sides(a, b):
    """What the streams A and B give, with a column that tells them apart."""
    return a.withColumn("stream", F.lit("A")).unionByName(b.withColumn("stream", F.lit("B")))


def _fagms_ab(spark, d):
    both = S.customers_ab(spark, d)
    return [L.fagms_build(S.side(both, s), SPEC) for s in ("A", "B")]


FAGMS = {"a": Q.cells(_cust_a, SPEC, "fagms"), "b": Q.cells(_cust_b, SPEC, "fagms")}


@query("fagms_build", Q.chain("SELECT 'A' AS stream, * FROM a UNION ALL SELECT 'B', * FROM b", **FAGMS))
def _(spark, d):
    return both_sides(*_fagms_ab(spark, d))


@query("fagms_delete", FAGMS["b"])
def _(spark, d):
    both = S.customers_ab(spark, d)
    return L.fagms_delete(L.fagms_build(both, SPEC), S.side(both, "A"), SPEC)


@query("fagms_join", Q.chain("SELECT median(p)::DOUBLE AS join_size FROM (SELECT r.row, coalesce(sum(a.v * b.v), 0)::BIGINT AS p "
                             f"FROM (SELECT unnest(range({SPEC.rows})) AS row) r LEFT JOIN (a JOIN b USING (row, idx)) ON a.row = r.row GROUP BY r.row)", **FAGMS))
def _(spark, d):
    return L.fagms_join(*_fagms_ab(spark, d), SPEC)


@query("fagms_query", Q.chain(f"SELECT 'A' AS stream, * FROM ({Q.estimates(_cust_a, 'a', SPEC, 'fagms')}) "
                              f"UNION ALL SELECT 'B', * FROM ({Q.estimates(_cust_b, 'b', SPEC, 'fagms')})", **FAGMS))
def _(spark, d):
    streams = S.customers_ab(spark, d)
    return both_sides(*(L.fagms_query(S.side(streams, s).select("key").distinct(), built, SPEC) for s, built in zip("AB", _fagms_ab(spark, d))))


@query("counter_gsum", Q.chain("SELECT median(s)::DOUBLE AS gsum FROM (SELECT row, sum(v::DOUBLE * v) AS s FROM t GROUP BY row)", t=CELLS))
def _(spark, d):
    square = lambda v: v.cast("double") * v.cast("double")
    return L.counter_gsum(_parts_sketch(spark, d), square, SPEC.rows)


SPARSE = SketchSpec(rows=3, width=8192, seed=16)


@query("linear_counting", Q.chain(
    f"SELECT round(min({SPARSE.width} * ln({SPARSE.width}.0 / greatest(1, {SPARSE.width} - n))), 6) AS cardinality FROM (SELECT row, count(*) AS n FROM t GROUP BY row)",
    t=Q.cells(S.PARTS, SPARSE, "min", signed=False)))
def _(spark, d):
    return rounded(L.linear_counting(L.count_min_build(S.parts(spark, d), SPARSE), SPARSE), "cardinality")


@query("sketch_size", Q.chain(f"SELECT {SPEC.rows * SPEC.width}::BIGINT AS cells, {SPEC.rows * SPEC.width * 4}::BIGINT AS bytes, count(*) AS used, "
                              f"round(count(*) / {SPEC.rows * SPEC.width}.0, 6) AS fill FROM t", t=CELLS))
def _(spark, d):
    return rounded(L.sketch_size(_parts_sketch(spark, d), SPEC), "fill")


# --- salsa ------------------------------------------------------------------------------

def _salsa_sql(stream: str, spec: SketchSpec, text: bool = False) -> str:
    """Bottom-up over block sizes, by joins on the enclosing block."""
    w = spec.width
    return Q.chain(
        f"""SELECT row, idx, CASE WHEN whole THEN idx // 4 * 4 WHEN pair THEN idx // 2 * 2 ELSE idx END AS start,
 CASE WHEN whole THEN 4 WHEN pair THEN 2 ELSE 1 END AS size,
 CASE WHEN whole THEN t4 WHEN pair THEN t2 ELSE v END::BIGINT AS v
 FROM four WHERE v > 0 OR pair OR whole""",
        c=Q.cells(stream, spec, "salsa", signed=False, text=text),
        one=f"SELECT r.row, i.idx, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT row FROM c) r "
            f"CROSS JOIN (SELECT unnest(range({w})) AS idx) i LEFT JOIN c ON c.row = r.row AND c.idx = i.idx",
        two=f"SELECT *, sum(v) OVER p AS t2, max(v) OVER p >= 256 AND idx // 2 * 2 + 1 < {w} AS pair "
            "FROM one WINDOW p AS (PARTITION BY row, idx // 2)",
        four=f"SELECT *, sum(v) OVER q AS t4, bool_or(pair AND t2 >= 65536) OVER q AND idx // 4 * 4 + 3 < {w} AS whole "
             "FROM two WINDOW q AS (PARTITION BY row, idx // 4)")


@query("salsa_build", _salsa_sql(S.PARTS, SALSA))
def _(spark, d):
    return A.salsa_build(S.parts(spark, d), SALSA)


# Scaled weights reach all three block sizes.
HEAVY_WORDS = "SELECT l_suppkey AS key, l_partkey * l_linenumber AS weight FROM lineitem"
WIDE_SALSA = SketchSpec(rows=3, width=1001, seed=17)


@query("salsa_build_wide_counts", _salsa_sql(HEAVY_WORDS, WIDE_SALSA))
def _(spark, d):
    lines = S.table(spark, d, "lineitem")
    from tallyweave.operators.exact import keyed_stream
    return A.salsa_build(keyed_stream(lines, "l_suppkey", weight=F.col("l_partkey") * F.col("l_linenumber")), WIDE_SALSA)


@query("salsa_query", Q.chain(f"SELECT key, min(x)::BIGINT AS est FROM ({Q.probes(S.PARTS, 't', SALSA, 'salsa', signed=False)}) GROUP BY key",
                              t=_salsa_sql(S.PARTS, SALSA)))
def _(spark, d):
    stream = S.parts(spark, d)
    return A.salsa_query(stream.select("key").distinct(), A.salsa_build(stream, SALSA), SALSA)


@query("salsa_cardinality", Q.chain(
    f"SELECT round(min({SPARSE.width} * ln({SPARSE.width}.0 / greatest(1, {SPARSE.width} - n))), 6) AS cardinality FROM (SELECT row, count(*) AS n FROM t GROUP BY row)",
    t=_salsa_sql(S.PARTS, SPARSE)))
def _(spark, d):
    return rounded(A.salsa_cardinality(A.salsa_build(S.parts(spark, d), SPARSE), SPARSE), "cardinality")
