"""Error bounds on skewed streams, and brute force for the rest."""

import math
from collections import Counter
from itertools import combinations_with_replacement

import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions.weights import g_entropy, g_sqr
from tallyweave.operators import bundle as B
from tallyweave.operators import exact as X
from tallyweave.operators import extract as E
from tallyweave.operators import heavy as H
from tallyweave.operators import linear as L
from tallyweave.operators import salsa as S
from tallyweave.operators import sizes as Z
from tallyweave.operators import universal as U
from tallyweave.plans import evaluate as A
from tallyweave.sources.scratch import materialize
from tallyweave.sources.zipf import cumulative, zipf_stream
from tallyweave.spec import SketchSpec
from tests.test_invariants import one, rows, stream

N, KEYS = 100_000, 10_000
SPEC = SketchSpec(rows=5, width=512, levels=14, capacity=256, buckets=64, seed=42)


@pytest.fixture(scope="module")
def zipf(spark):
    return materialize(zipf_stream(spark, N, KEYS, 1.2, 42))


@pytest.fixture(scope="module")
def counts(zipf):
    return materialize(X.key_counts(zipf))


def test_zipf_shape(spark, zipf):
    top = zipf.groupBy("rank").count().orderBy(F.desc("count")).first()
    assert top["rank"] == 1
    assert top["count"] == pytest.approx(N * cumulative(KEYS, 1.2)[0], rel=0.05)
    assert rows(zipf_stream(spark, 500, KEYS, 1.2, 42).repartition(3)) == rows(zipf_stream(spark, 500, KEYS, 1.2, 42))


@pytest.mark.parametrize("route", ["lossless", "bounded", "elastic", "guardian", "frequent"])
def test_combined_estimates(zipf, counts, route):
    mode = "bounded" if route == "bounded" else "estimated"
    s = E.extract_build(zipf, SPEC, route, mode, shard_rows=30_000)
    assert one(A.relative_error(E.extract_gsum(s, g_sqr), X.gsum_exact(counts, g_sqr))) < 0.02
    assert one(A.relative_error(E.extract_gsum(s, g_entropy), X.gsum_exact(counts, g_entropy))) < 0.15
    f2 = one(X.gsum_exact(counts, g_sqr))
    errors = E.extract_query(counts, s).agg(F.max(F.abs(F.col("est") - F.col("f")))).first()[0]
    assert errors < 4 * math.sqrt(f2 / SPEC.width)


def test_heavy_part_beats_the_sketch_alone(zipf, counts):
    both = A.average_absolute_error(E.extract_query(counts, E.extract_build(zipf, SPEC, mode="estimated")))
    alone = A.average_absolute_error(
        E.extract_query(counts, E.extract_build(zipf, SPEC.with_sizes(heavy_ratio=0.0), mode="estimated")))
    assert one(both) < one(alone)


def test_count_sketch_error(zipf, counts):
    est = L.count_sketch_query(counts, L.count_sketch_build(zipf, SPEC), SPEC)
    f2 = one(X.gsum_exact(counts, g_sqr))
    assert est.filter(F.abs(F.col("est") - F.col("f")) > 3 * math.sqrt(f2 / SPEC.width)).count() < KEYS * 0.01
    assert one(L.count_sketch_f2(L.count_sketch_build(zipf, SPEC))) == pytest.approx(f2, rel=0.15)


def test_summary_keeps_frequent_keys(zipf, counts):
    size = 200
    kept = {r["key"]: r["v"] for r in H.heavy_spacesaving(zipf.repartition(6), size).collect()}
    real = {r["key"]: r["f"] for r in counts.collect()}
    assert len(kept) <= size
    assert all(v <= real[k] for k, v in kept.items())
    assert all(k in kept for k, f in real.items() if f > 2 * N / size)


def test_bounded_candidates_find_the_top(zipf, counts):
    counters = materialize(U.universal_build(zipf, SPEC))
    found = U.bounded_candidates(zipf.repartition(6), counters, SPEC).filter("level = 0")
    top = {r["key"] for r in X.topk_exact(counts, 50).collect()}
    assert len(top - {r["key"] for r in found.collect()}) <= 2


def test_linear_counting_error(zipf, counts):
    spec = SPEC.with_sizes(rows=3, width=30_000)
    for built in (L.count_min_build(zipf, spec), S.salsa_build(zipf, spec)):
        assert one(L.linear_counting(built, spec)) == pytest.approx(counts.count(), rel=0.05)


@pytest.mark.parametrize("use_elastic", [True, False])
def test_bundle_answers(zipf, counts, use_elastic):
    spec = SPEC.with_sizes(rows=3, width=20_000, buckets=128)
    b = B.bundle_build(zipf, spec, use_elastic)
    top = X.topk_exact(counts, 20)
    assert one(A.heavy_hitter_scores(B.bundle_heavy_hitters(b, 300), counts.filter("f >= 300")).select("f1")) > 0.8
    assert B.bundle_query(top, b).filter(F.abs(F.col("est") - F.col("f")) > 0.1 * F.col("f")).count() <= 2
    assert one(A.relative_error(B.bundle_inner_product(b, b), X.gsum_exact(counts, g_sqr))) < 0.05
    assert one(B.bundle_jaccard(b, b)) == 1.0
    assert one(B.bundle_cosine(b, b)) == pytest.approx(1.0, abs=0.05)


# --- brute force ------------------------------------------------------------------------

def salsa_by_arrivals(cells, w):
    """Counters that merge while they grow, one arrival at a time."""
    size, value = [1] * w, {}
    start = list(range(w))
    for c in cells:
        b = start[c]
        value[b] = value.get(b, 0) + 1
        while value[b] >= 2 ** (8 * size[b]) and size[b] < 4:
            n = size[b]
            left = b - b % (2 * n)
            if left + 2 * n > w:
                break  # without a buddy it keeps counting
            value[left] = sum(value.get(x, 0) for x in {start[i] for i in range(left, left + 2 * n)})
            for i in range(left, left + 2 * n):
                start[i] = left
            b, size[left] = left, 2 * n
    return {i: value.get(start[i], 0) for i in range(w) if value.get(start[i], 0)}


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@example([(2, 256)], 3)
@example([(k, 70_000) for k in range(3)], 6)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 700)), min_size=1, max_size=30), st.integers(3, 12))
def test_salsa_equals_arrival_order(spark, groups, width):
    spec = SketchSpec(rows=1, width=width, seed=3)
    keys = [k for k, n in groups for _ in range(n)]
    s = stream(spark, [k for k, _ in groups], [n for _, n in groups])
    cell = {r["key"]: r["idx"] for r in L.with_row_hash(s.select("key").distinct(), spec, S.ROLE).selectExpr(
        "key", f"shiftright(h, 1) % {width} AS idx").collect()}
    built = {r["idx"]: r["v"] for r in S.salsa_build(s, spec).collect()}
    assert built == salsa_by_arrivals([cell[k] for k in keys], width)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=30))
def test_counts_of_any_keys(spark, keys):
    assert {r["key"]: r["f"] for r in X.key_counts(stream(spark, keys)).collect()} == Counter(keys)


def test_size_distribution_against_enumeration(spark):
    histogram = {1: 40, 2: 25, 3: 12, 5: 4, 8: 1, 60: 2, 350: 1, 700: 1}
    width = 500
    rate = {s: n / width for s, n in histogram.items()}
    want = Counter()
    for v, n in histogram.items():
        ways = [c for m in range(1, Z.max_parts(v) + 1) for c in combinations_with_replacement(sorted(histogram), m) if sum(c) == v]
        p = [math.prod(rate[s] ** t / math.factorial(t) for s, t in Counter(c).items()) for c in ways]
        for c, weight in zip(ways, p):
            for size in c:
                want[size] += n * weight / sum(p)
    df = spark.createDataFrame(list(histogram.items()), "v bigint, n bigint")
    got = {r["size"]: r["n"] for r in Z.flow_size_distribution_em(df, width, rounds=1).collect()}
    assert got.keys() == {s for s in want if want[s] > 0}
    assert all(got[s] == pytest.approx(want[s]) for s in got)
    later = Z.flow_size_distribution_em(df, width, rounds=4)
    total = later.agg(F.sum(F.col("size") * F.col("n"))).first()[0]
    assert total == pytest.approx(sum(v * n for v, n in histogram.items()))


def test_jobs_report_every_setting(spark, zipf):
    part = zipf.filter("seq < 5000")
    result = A.eval_gsum_job(part, "sum", [20_000, 40_000], trials=2, algos=("E", "S", A.UNIVERSAL, A.BASELINE)).collect()
    assert {(r["mem"], r["algo"]) for r in result} == {(m, a) for m in (20, 40) for a in ("E", "S", A.UNIVERSAL, A.BASELINE)}
    assert all(r["value"] is not None and r["value"] < 0.5 for r in result)


def test_hot_key_is_spread_over_shards(spark):
    """A third of all arrivals in one key: no (shard, bucket) exceeds a shard, and nothing is lost."""
    n, shard_rows = 30_000, 1_000
    s = spark.range(n).selectExpr("id AS seq", "CASE WHEN id % 3 = 0 THEN 0 ELSE 1 + id % 499 END AS key", "1L AS weight")
    spec = SketchSpec(rows=3, width=256, levels=10, capacity=64, buckets=4, slots=4, seed=2)
    folded = materialize(H.heavy_fold(s, spec, "elastic", shard_rows))
    assert folded.select("shard").distinct().count() == n // shard_rows
    heavy, residual = H.merge_shards(folded, spec)
    assert H.heavy_mass(heavy, residual).first()["total"] == n
    hot = E.extract_query(spark.createDataFrame([(0,)], "key bigint"), E.extract_build(s, spec, "elastic", shard_rows=shard_rows))
    assert hot.first()["est"] == pytest.approx(n / 3, rel=0.05)


def test_cutoffs_keep_ties(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([5, 5, 5, 3, 3, 1])] + [(1, 9, 7)], "g int, key bigint, v bigint")
    order = [F.desc("v"), F.col("key")]
    for k in (1, 3, 4, 10):
        plain = X.top_per_group(df, ["g"], order, k, ["key"])
        assert rows(X.top_per_group(df, ["g"], order, k, ["key"], value="v", groups=2)) == rows(plain)
