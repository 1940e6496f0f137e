"""Rows without a key, keys of 64 bits, crowded counters, odd widths, large ranks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import elastic as E
from tallyweave.operators import heavy as P
from tallyweave.operators import joinsketch as J
from tallyweave.operators import salsa as A
from tallyweave.operators import sizes as Z
from tallyweave.operators import waving as V
from tallyweave.operators.exact import key_counts, keyed_stream
from tallyweave.sources.zipf import cumulative, head_weights, ranks, tail_weight
from tallyweave.spec import SketchSpec

SPEC = SketchSpec(rows=3, width=64, buckets=2, slots=4, seed=5)
ODD = [9007199254740993, 9007199254740995, -(2**63), 2**63 - 1]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, None if i % 3 == 0 else ODD[i % 4]) for i in range(120)] + [(None, 7)]
    return keyed_stream(spark.createDataFrame(rows, "seq long, id long"), "id", seq="seq")


def counted(df):
    return {r[0]: r[1] for r in df.collect()}


def test_rows_without_key_or_number_are_no_arrivals(odd):
    assert set(counted(key_counts(odd))) == set(ODD)
    assert sum(counted(key_counts(odd)).values()) == 80


@pytest.mark.parametrize("strategy", ["elastic", "guardian", "frequent"])
def test_folds_keep_whole_64_bit_keys(odd, strategy):
    truth = counted(key_counts(odd))
    heavy, residual = P.merge_shards(P.heavy_fold(odd, SPEC, strategy, shard_rows=50), SPEC)
    assert {r.key: r.v for r in heavy.collect()} == truth
    assert residual.count() == 0
    assert counted(P.heavy_spacesaving(odd, 10)) == truth


def test_sketches_with_tables_keep_whole_64_bit_keys(odd):
    truth = counted(key_counts(odd))
    keys = odd.select("key").distinct()
    slots, casts = V.waving_tables(V.waving_build(odd, SPEC, 50), SPEC)
    assert counted(V.waving_query(keys, slots, casts, SPEC)) == truth
    tiers = J.tiers_of_fold(J.three_tier_fold(odd, SPEC, 15, 50), SPEC, 15)
    assert counted(J.three_tier_query(keys, tiers)) == truth


def test_one_row_a_key_and_no_lost_weight_over_shards(spark):
    rows = spark.range(4000).select(F.col("id").alias("seq"), (F.col("id") * F.col("id") % 300).alias("id"))
    stream = keyed_stream(rows, "id", seq="seq")
    keys, truth = stream.select("key").distinct(), counted(key_counts(stream))
    heavy, light = E.elastic_tables(E.elastic_fold(stream, SPEC, 500), SPEC)
    assert heavy.groupBy("bucket").count().agg(F.max("count")).first()[0] <= E.ELASTIC_SLOTS
    found = counted(E.elastic_query(keys, heavy, light, SPEC))
    assert all(found[k] >= truth[k] for k in truth)
    slots, casts = V.waving_tables(V.waving_build(stream, SPEC, 500), SPEC)
    assert V.waving_query(keys, slots, casts, SPEC).count() == len(truth)
    tiers = J.tiers_of_fold(J.three_tier_fold(stream, SPEC, 40, 500), SPEC, 40)
    assert tiers.middle.count() <= SPEC.buckets * J.MIDDLE_SLOTS
    assert tiers.heavy.join(tiers.middle, "key").count() == 0
    assert all(r.v >= 40 for r in tiers.heavy.collect()) and all(r.v < 40 for r in tiers.middle.collect())


@pytest.mark.parametrize("width", [5, 6, 7, 8])
def test_salsa_is_never_below_the_truth(spark, width):
    rows = spark.range(200).select(F.col("id").alias("key"), F.lit(1000 * 2**20).cast("long").alias("weight"))
    spec = SketchSpec(rows=2, width=width, seed=9)
    found = A.salsa_query(rows.select("key"), A.salsa_build(rows, spec), spec)
    assert found.agg(F.min("est")).first()[0] >= 1000 * 2**20


def test_size_distribution_of_crowded_counters(spark):
    values = spark.range(4053).select((F.col("id") % 7 + 1).alias("v"))
    found = counted(Z.flow_size_distribution_em(Z.counter_histogram(values), width=4, rounds=2))
    assert sum(k * n for k, n in found.items()) == pytest.approx(sum(i % 7 + 1 for i in range(4053)))
    single = counted(Z.flow_size_distribution_em(Z.counter_histogram(values), width=4, rounds=2, parts=1))
    assert sum(single.values()) == pytest.approx(4053)


@pytest.mark.parametrize("alpha", [0.5, 1.0, 1.7])
def test_ranks_beyond_the_table(alpha):
    u = (np.arange(2000) + 0.5) / 2000
    whole = cumulative(50_000, alpha)
    assert (ranks(u, head_weights(500, alpha), 50_000, alpha) == np.searchsorted(whole, u) + 1).mean() > 0.999
    assert head_weights(50_000, alpha)[-1] == pytest.approx(head_weights(500, alpha)[-1] + tail_weight(50_000, 500, alpha), rel=1e-11)
    assert ranks(np.array([1.0 - 1e-12]), head_weights(500, alpha), 10**12, alpha)[0] <= 10**12
