"""The mergeable summary of frequent keys: bounds, order, skew and shape of its plan."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import heavy as P
from tallyweave.operators.exact import key_counts, keyed_stream
from tallyweave.operators.spacesaving import merge_summaries, shard_summaries, spacesaving_tree
from tallyweave.spec import SketchSpec


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all arrivals is key 7; key 5000 comes late, in one run; the rest is spread."""
    rows = spark.range(12_000).selectExpr(
        "id AS seq", "CASE WHEN id % 3 = 0 THEN 7 WHEN id >= 11000 THEN 5000 ELSE id * id % 1901 END AS k", "1 + id % 2 AS w")
    return keyed_stream(rows, "k", seq="seq", weight="w").persist()


def model(rows, size, shard_rows, fan):
    """The same tree in plain Python."""
    shards = {}
    for key, seq, weight in rows:
        own = shards.setdefault(seq // shard_rows, {})
        own[key] = own.get(key, 0) + weight

    def cut(found, base):
        ranked = sorted(found.items(), key=lambda kv: (-kv[1][1], kv[0]))
        return dict(ranked[:size]), ranked[size][1][1] if len(ranked) > size else base

    level = {s: cut({k: (f, f) for k, f in own.items()}, 0) for s, own in shards.items()}
    while len(level) > 1:
        groups = {}
        for s, summary in level.items():
            groups.setdefault(s // fan, []).append(summary)
        level = {}
        for g, members in groups.items():
            base, added = sum(floor for _, floor in members), {}
            for own, floor in members:
                for k, (low, high) in own.items():
                    a, b = added.get(k, (0, base))
                    added[k] = a + low, b + high - floor
            level[g] = cut(added, base)
    (found, floor), = level.values()
    return sorted((k, low, high, floor) for k, (low, high) in found.items())


@pytest.mark.parametrize("size, shard_rows, fan", [(20, 500, 16), (20, 500, 2), (3, 97, 4), (1, 1000, 3), (5000, 500, 16), (40, 10**9, 16)])
def test_tree_equals_model_whatever_the_layout(skewed, size, shard_rows, fan):
    wanted = model([(r.key, r.seq, r.weight) for r in skewed.collect()], size, shard_rows, fan)
    for parts in (1, 5):
        found = spacesaving_tree(skewed.repartition(parts), size, shard_rows, fan)
        assert sorted(map(tuple, found.select("key", "low", "high", "floor").collect())) == wanted


@pytest.mark.parametrize("size", [2, 25, 300])
def test_bounds_hold_and_heavy_keys_stay(skewed, size):
    truth = {r.key: r.f for r in key_counts(skewed).collect()}
    found = P.heavy_spacesaving(skewed, size, 400, 4).collect()
    floor = found[0].floor
    assert len(found) == min(size, len(truth)) and all(r.v <= truth[r.key] <= r.upper for r in found)
    assert max((f for k, f in truth.items() if k not in {r.key for r in found}), default=0) <= floor
    assert floor <= 5 * sum(truth.values()) / size
    assert 7 in {r.key for r in found}


def test_text_keys_streams_without_numbers_and_no_rows(spark, skewed):
    named = skewed.withColumn("key", F.concat(F.lit("k"), "key"))
    assert "k7" in {r.key for r in P.heavy_spacesaving(named, 5, 1000).collect()}
    loose = skewed.select("key", "weight").repartition(7)
    truth = {r.key: r.f for r in key_counts(loose).collect()}
    assert all(r.v <= truth[r.key] <= r.upper for r in P.heavy_spacesaving(loose, 30).collect())
    assert P.heavy_spacesaving(skewed.limit(0), 5).count() == 0
    late = skewed.withColumn("seq", F.col("seq") - 5000)  # numbers may begin below zero
    assert sum(r.v <= truth[r.key] <= r.upper for r in P.heavy_spacesaving(late, 30, 300, 4).collect()) == 30
    with pytest.raises(ValueError):
        spacesaving_tree(skewed, 5, fan=1)


def test_no_task_ranks_more_than_a_shard_or_a_group(skewed):
    shards = shard_summaries(skewed, 10, 500)
    for df in (shards, merge_summaries(shards, 10)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "SinglePartition" not in plan and "CollectLimit" not in plan
    assert shards.groupBy("shard").count().agg(F.max("count")).first()[0] == 10


def test_bounded_split_is_one_whatever_the_layout(skewed):
    spec = SketchSpec(rows=3, width=64, levels=8, capacity=50, buckets=4, slots=5, seed=3)
    splits = []
    for parts in (1, 6):
        heavy, residual = P.bounded_split(skewed.repartition(parts), spec, shard_rows=700)
        splits.append((sorted((r.key, r.v) for r in heavy.collect()), residual.agg(F.sum("weight")).first()[0]))
    assert splits[0] == splits[1] and len(splits[0][0]) == 20
    truth = {r.key: r.f for r in key_counts(skewed).collect()}
    assert all(truth[k] == v for k, v in splits[0][0]) and sum(v for _, v in splits[0][0]) + splits[0][1] == sum(truth.values())
