"""Counts near 10^10, repeated query rows on wide sketches, and guards far behind."""

import math

import pytest

from tallyweave.functions.weights import WEIGHTS
from tallyweave.operators import elastic as E
from tallyweave.operators import extract as E2
from tallyweave.operators import heavy as H
from tallyweave.operators import joinsketch as J
from tallyweave.operators import linear as L
from tallyweave.operators import salsa as S
from tallyweave.operators import twostream as T
from tallyweave.operators import universal as U
from tallyweave.spec import SketchSpec, sketch_params_from_memory
from tallyweave.streaming.summaries import load_stream_extract

SPEC = SketchSpec(rows=3, width=64, levels=4, capacity=16, buckets=8, seed=9)
MANY = 5_000_000_000


@pytest.fixture(scope="module")
def heavy_stream(spark):
    return spark.createDataFrame([(1, 0, MANY), (2, 1, MANY)], "key long, seq long, weight long")


def test_products_of_large_counts(spark, heavy_stream):
    counters = L.fagms_build(heavy_stream, SPEC)
    assert L.fagms_join(counters, counters, SPEC).first()[0] >= MANY * MANY
    assert L.count_sketch_f2(L.count_sketch_build(heavy_stream, SPEC)).first()[0] >= MANY * MANY
    pairs = spark.createDataFrame([(1, MANY, MANY), (2, MANY, 0)], "key long, fa long, fb long")
    assert math.isclose(T.cosine_exact(pairs).first()[0], math.sqrt(0.5))
    assert T.inner_product_exact(pairs).first()[0] == MANY * MANY
    assert math.isclose(T.gsum_mul_exact(pairs, WEIGHTS["sum"]).first()[0], float(MANY) * MANY)
    listed = spark.createDataFrame([(0, 1, MANY), (0, 2, 1)], "level int, key long, v long")
    assert U.product_candidates(listed, listed).agg({"v": "max"}).first()[0] == float(MANY) * MANY
    built = E2.extract_build(heavy_stream, SPEC)
    assert math.isclose(E2.extract_gsum_mul(built, built, WEIGHTS["sum"]).first()[0], 2 * float(MANY) * MANY)
    assert T.jaccard_est(built, built).first()[0] == 1.0
    heavy = spark.createDataFrame([(1, MANY)], "key long, k long")
    empty = L.count_sketch_build(heavy_stream.limit(0), SPEC)
    assert J.skim_join(heavy, empty, heavy, empty, SPEC).first()[0] == float(MANY) * MANY


@pytest.mark.parametrize("module, build, query", [
    (L, L.count_sketch_build, L.count_sketch_query), (L, L.count_min_build, L.count_min_query),
    (L, L.kary_build, L.kary_query), (S, S.salsa_build, S.salsa_query)])
def test_repeated_query_rows_stay_on_wide_sketches(spark, monkeypatch, module, build, query):
    stream = spark.createDataFrame([(i % 7, i, 1) for i in range(100)], "key long, seq long, weight long")
    keys = spark.createDataFrame([(1,), (1,), (5,), (99,)], "key long")
    counters = build(stream, SPEC)
    dense = sorted(query(keys, counters, SPEC).collect())
    monkeypatch.setattr(L, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(module, "BROADCAST_CELLS", 0)
    wide = sorted(query(keys, counters, SPEC).collect())
    assert len(wide) == 4 and all(a.key == b.key and math.isclose(a.est, b.est) for a, b in zip(dense, wide))


def test_universal_estimates_keep_repeated_rows(spark, monkeypatch):
    stream = spark.createDataFrame([(i % 7, i, 1) for i in range(100)], "key long, seq long, weight long")
    counters, keys = U.universal_build(stream, SPEC), spark.createDataFrame([(1,), (1,), (3,)], "key long")
    dense = sorted(U.universal_query(keys, counters, SPEC).collect())
    monkeypatch.setattr(U, "BROADCAST_CELLS", 0)
    assert sorted(U.universal_query(keys, counters, SPEC).collect()) == dense and len(dense) == 3


def test_guardian_coin_takes_any_gap():
    guard = H.GuardianGuard(3)
    assert not any(guard.grow(0, gap, seq) for gap in (300, 10_000, 10**9) for seq in range(50))
    assert all(guard.grow(5, 5, seq) for seq in range(20))


def test_small_budgets_have_a_bucket():
    assert sketch_params_from_memory(100).buckets == 1 and sketch_params_from_memory(100_000, heavy_ratio=0.0).buckets == 0


def test_elastic_counts_what_a_shard_passed_on(spark):
    spec = SketchSpec(rows=3, width=4096, levels=4, capacity=16, buckets=1, seed=9)
    first = [k for k in range(1, 8) for _ in range(3)] + [8] * 20
    arrivals = first + [8] * 10
    stream = spark.createDataFrame([(k, i, 1) for i, k in enumerate(arrivals)], "key long, seq long, weight long")
    keys = spark.createDataFrame([(8,)], "key long")
    for shard_rows in (1_000, len(first)):
        folded = E.elastic_fold(stream, spec, shard_rows)
        heavy, light = E.elastic_tables(folded, spec)
        assert [tuple(r) for r in E.elastic_query(keys, heavy, light, spec).collect()] == [(8, 30)]


def test_streamed_residents_are_one_row_per_key(spark, tmp_path):
    rows = [(0, 0, 1, 5, False, "heavy", 1, 0), (1, 0, 1, 6, False, "heavy", 2, 0), (0, 0, 2, 4, False, "heavy", 1, 1)]
    spark.createDataFrame(rows, "shard int, bucket long, key long, f long, flag boolean, kind string, seq long, pos long").write.parquet(
        str(tmp_path / "residents" / "batch=0"))
    spark.createDataFrame([(0, 0, 1, 1)], "level int, row int, idx long, v long").write.parquet(str(tmp_path / "counters" / "batch=0"))
    heavy, _ = load_stream_extract(spark, str(tmp_path), SPEC)
    assert sorted((r.key, r.v, r.flag) for r in heavy.collect()) == [(1, 11, False), (2, 4, True)]


def test_a_heavy_part_without_buckets_is_refused():
    with pytest.raises(ValueError):
        SketchSpec(buckets=0)
    assert SketchSpec(buckets=0, heavy_ratio=0.0).heavy_rows == 0
