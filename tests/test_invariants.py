"""Theorems that hold for any stream: edge cases, layouts, full capacity, conservation."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions.weights import WEIGHTS, g_cardinality, g_sqr, g_sum
from tallyweave.operators import exact as X
from tallyweave.operators import extract as E
from tallyweave.operators import heavy as H
from tallyweave.operators import joinsketch as J
from tallyweave.operators import linear as L
from tallyweave.operators import twostream as T
from tallyweave.operators import universal as U
from tallyweave.operators import waving as V
from tallyweave.sources.scratch import materialize
from tallyweave.spec import SketchSpec, distinct_seeds, levels_for, sketch_params_from_memory

FULL = SketchSpec(rows=3, width=64, levels=8, capacity=10_000, buckets=4, slots=3, seed=5)
ODD_KEYS = [0, 0, 0, -1, -1, -(2**62), 2**62, 2**31 + 5, 7, 7, 7, 7, 0, 9, 10, 11, 12, 13]


def stream(spark, keys, weights=None, type_="bigint"):
    weights = weights or [1] * len(keys)
    rows = [(i, k, w) for i, (k, w) in enumerate(zip(keys, weights))]
    return spark.createDataFrame(rows, f"seq bigint, key {type_}, weight bigint")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(df):
    return df.first()[0]


CASES = {
    "odd_keys": (ODD_KEYS, "bigint"), "one_key": ([5] * 20, "bigint"), "all_distinct": (list(range(40)), "bigint"),
    "text": (list("the quick brown fox jumps over the lazy dog"), "string"), "empty": ([], "bigint"),
}


@pytest.mark.parametrize("case", CASES)
def test_full_capacity_is_exact(spark, case):
    keys, type_ = CASES[case]
    s = stream(spark, keys, type_=type_)
    counts = X.key_counts(s)
    cand = U.universal_candidates(counts, FULL)
    summary = E.extract_build(s, FULL)
    for g in WEIGHTS.values():
        real = one(X.gsum_exact(counts, g))
        assert one(U.universal_gsum(cand, FULL, g)) == pytest.approx(real)
        assert one(E.extract_gsum(summary, g)) == pytest.approx(real)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("strategy", ["elastic", "guardian", "frequent"])
def test_fold_keeps_all_weight(spark, case, strategy):
    keys, type_ = CASES[case]
    s = stream(spark, keys, type_=type_)
    folded = materialize(H.heavy_fold(s, FULL, strategy, shard_rows=7))
    mass = H.heavy_mass(*H.merge_shards(folded, FULL)).first()
    assert mass["total"] == len(keys)


@pytest.mark.parametrize("strategy", ["elastic", "guardian", "frequent"])
def test_fold_does_not_depend_on_layout(spark, strategy):
    s = stream(spark, [(i * i) % 23 for i in range(400)])
    results = [rows(H.heavy_fold(s.orderBy(F.rand(3)).repartition(n), FULL, strategy)) for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2]


def test_unknown_strategies_are_refused():
    for name in ("spacesaving", "other"):
        with pytest.raises(ValueError):
            H.heavy_make(name)


def test_linear_sketches_merge_and_delete(spark):
    a, b = stream(spark, [i % 11 for i in range(100)]), stream(spark, [i % 7 for i in range(50)], [3] * 50)
    both = a.unionByName(b)
    assert rows(L.sketch_merge(*(L.count_sketch_build(s, FULL) for s in (a, b)))) == rows(L.count_sketch_build(both, FULL))
    assert rows(U.universal_merge(*(U.universal_build(s, FULL) for s in (a, b)))) == rows(U.universal_build(both, FULL))
    assert rows(L.fagms_delete(L.fagms_build(both, FULL), b, FULL)) == rows(L.fagms_build(a, FULL))
    assert L.fagms_delete(L.fagms_build(a, FULL), a, FULL).count() == 0


def test_summary_of_counts_equals_summary_of_arrivals(spark):
    s = stream(spark, ODD_KEYS)
    counted = X.key_counts(s).select("key", F.col("f").alias("weight"))
    assert rows(U.universal_build(s, FULL)) == rows(U.universal_build(counted, FULL))


def test_count_min_never_underestimates(spark):
    s = stream(spark, [i % 97 for i in range(1000)])
    counts = X.key_counts(s)
    for shared in (False, True):
        spec = FULL.with_sizes(width=50)
        est = L.count_min_query(counts, L.count_min_build(s, spec, shared), spec, shared)
        assert est.filter(F.col("est") < F.col("f")).count() == 0


def test_wide_sketches_join_by_cell(spark, monkeypatch):
    """Beyond the broadcast bound the answers stay the same."""
    s = stream(spark, [(i * i) % 31 for i in range(300)])
    keys, counts = s.select("key").distinct(), X.key_counts(s)

    def answers():
        cells = L.count_sketch_build(s, FULL)
        return [
            rows(L.count_sketch_query(keys, cells, FULL)),
            rows(L.count_min_query(keys, L.count_min_build(s, FULL), FULL)),
            rows(L.kary_query(keys, L.kary_build(s, FULL), FULL)),
            rows(U.universal_query(keys, U.universal_build(s, FULL), FULL)),
            rows(U.universal_candidates(counts, FULL, "estimated", U.universal_build(s, FULL))),
        ]

    near = answers()
    monkeypatch.setattr(L, "BROADCAST_CELLS", 1)
    monkeypatch.setattr(U, "BROADCAST_CELLS", 1)
    assert answers() == near


def test_same_stream_twice(spark):
    s = stream(spark, ODD_KEYS)
    pairs = T.join_counts(X.key_counts(s), X.key_counts(s))
    assert one(T.cosine_exact(pairs)) == pytest.approx(1.0)
    assert one(T.jaccard_exact(pairs)) == 1.0
    a = E.extract_build(s, FULL)
    assert one(T.jaccard_est(a, a)) == pytest.approx(1.0)
    assert one(T.maxlog_jaccard(*[T.maxlog_build(s, FULL)] * 2, FULL)) == 1.0


def test_disjoint_streams(spark):
    a, b = stream(spark, list(range(20))), stream(spark, list(range(100, 130)))
    pairs = T.join_counts(X.key_counts(a), X.key_counts(b))
    assert one(T.inner_product_exact(pairs)) == 0 and one(T.jaccard_exact(pairs)) == 0.0
    wide = FULL.with_sizes(rows=5, width=4096)
    x, y = (E.extract_build(s, wide) for s in (a, b))
    assert one(T.jaccard_est(x, y)) == pytest.approx(0.0)
    assert one(E.extract_gsum_add(x, y, g_cardinality)) == pytest.approx(50.0)


def test_only_one_part(spark):
    s = stream(spark, ODD_KEYS)
    only_sketch = E.extract_build(s, FULL.with_sizes(heavy_ratio=0.0))
    assert only_sketch.heavy.count() == 0
    assert one(E.extract_gsum(only_sketch, g_sqr)) == one(X.gsum_exact(X.key_counts(s), g_sqr))
    only_heavy = E.extract_build(s, FULL.with_sizes(heavy_ratio=1.0))
    assert only_heavy.counters.count() == 0
    assert one(E.extract_gsum(only_heavy, g_sum)) <= len(ODD_KEYS)


def test_capacity_one(spark):
    s = stream(spark, [1] * 9 + [2] * 4 + [3])
    tiny = FULL.with_sizes(capacity=1, slots=1, buckets=1)
    cand = U.universal_candidates(X.key_counts(s), tiny)
    assert cand.groupBy("level").count().filter("count > 1").count() == 0
    heavy, residual = H.lossless_split(X.key_counts(s), tiny)
    assert [tuple(r) for r in heavy.select("key", "v").collect()] == [(1, 9)]
    assert one(residual.agg(F.sum("weight"))) == 5


def test_three_tiers_lose_nothing(spark):
    s = stream(spark, [(i * i) % 37 for i in range(800)])
    spec = FULL.with_sizes(rows=5, width=2048, buckets=2)
    tiers = J.tiers_of_fold(materialize(J.three_tier_fold(s, spec, 25, shard_rows=300)), spec)
    est = J.three_tier_query(X.key_counts(s), tiers)
    # With hardly any collisions the three tiers add up to every count.
    assert est.filter(F.col("est") != F.col("f")).count() == 0


def test_waving_bucket_counts_round_trip(spark):
    s = stream(spark, list(range(12)) * 3)
    spec = FULL.with_sizes(buckets=2, slots=20)
    folded = materialize(V.waving_build(s, spec))
    slots, casts = V.waving_slots(folded), V.waving_casts(folded)
    assert rows(slots.select("key", F.col("v").alias("f"))) == rows(X.key_counts(s).select("key", "f"))
    half = V.waving_shrink(*V.waving_expand(slots, casts, spec), spec.with_sizes(buckets=4))
    assert rows(half[0].select("key", "v")) == rows(slots.select("key", "v"))
    with pytest.raises(ValueError):
        V.waving_shrink(slots, casts, spec.with_sizes(buckets=3))


def test_sizes_from_memory(spark):
    from tallyweave.operators.params import sketch_params_table

    budgets = [100_000, 123_457, 900_001]
    table = sketch_params_table(spark.createDataFrame([(m,) for m in budgets], "mem bigint"))
    for r in table.collect():
        spec = sketch_params_from_memory(r["mem"])
        assert (spec.buckets, spec.width, spec.capacity) == (r["buckets"], r["width"], r["capacity"])
    assert sketch_params_from_memory(100_000, heavy_ratio=0.0, rows=1).rows == 5
    assert len(set(distinct_seeds(50))) == 50


@pytest.mark.parametrize("bins", [50, 4096])
@pytest.mark.parametrize("kind", ["dense", "sparse", "ends", "ties"])
def test_read_limit_cuts_exactly(spark, monkeypatch, kind, bins):
    monkeypatch.setattr(X, "SMALL_LIMIT", 3)
    numbers = {"dense": list(range(100)), "sparse": [i ** 9 for i in range(100)], "ends": [-(1 << 63), -5, 0, 7, (1 << 63) - 1] * 20,
               "ties": [4] * 60 + [5] * 40}[kind]
    s = spark.createDataFrame([(k, k, 1) for k in numbers], "seq long, key long, weight long").repartition(4)
    for n in (1, 37, 60, 100):
        kept = [r["seq"] for r in X.read_limit(s, n, bins=bins).collect()]
        assert sorted(kept) == sorted(numbers)[:n]
    assert X.read_limit(s, -1).count() == 100 and X.read_limit(s.limit(0), 50).count() == 0


def test_ranking_is_cut_before_the_shuffle(spark):
    counts = spark.range(20_000).selectExpr("id AS key", "id % 997 AS f")
    spec = SketchSpec(rows=3, width=64, levels=5, capacity=1024, seed=2)
    plan = U.universal_candidates(counts, spec, "estimated", U.universal_build(counts.selectExpr("key", "f AS weight"), spec))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text
    assert plan.groupBy("level").count().agg(F.max("count")).first()[0] == 1024


def test_levels_follow_the_keys():
    assert [levels_for(n, 256) for n in (1, 256, 257, 1 << 20, 10 ** 12, 10 ** 30)] == [1, 1, 2, 13, 31, 31]
