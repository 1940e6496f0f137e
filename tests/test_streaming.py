"""Several micro-batches give what one batch run gives."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import exact as X
from tallyweave.operators import heavy as H
from tallyweave.operators import universal as U
from tallyweave.plans import streams as S
from tallyweave.sources.scratch import materialize, scratch_path
from tallyweave.spec import SketchSpec
from tallyweave.streaming import summaries as G
from tests.test_invariants import rows, stream

SPEC = SketchSpec(rows=3, width=64, levels=6, capacity=100, buckets=3, slots=4, seed=8)
SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "seq bigint, key bigint, weight bigint"


@pytest.fixture(scope="module")
def arrivals(spark):
    return stream(spark, [(i * i) % 29 for i in range(900)])


@pytest.fixture(scope="module")
def folder(spark, arrivals):
    """Three files in arrival order, written one after the other."""
    import time

    path = scratch_path(spark, "arrivals")
    for i in range(3):
        part = arrivals.filter((F.col("seq") >= 300 * i) & (F.col("seq") < 300 * (i + 1)))
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_counts(spark, folder, arrivals):
    done = G.last_update(G.drain(G.stream_key_counts(source(spark, folder)), "update"), ["key"])
    assert rows(done.select("key", "f")) == rows(X.key_counts(arrivals))


def test_linear_sketch(spark, folder, arrivals):
    out = G.drain(G.stream_linear_sketch(source(spark, folder), SPEC, "universal"), "complete")
    assert out.select("batch").distinct().count() == 3
    built = U.universal_build(arrivals, SPEC)
    assert rows(G.last_batch(out).select(*built.columns)) == rows(built)


@pytest.mark.parametrize("strategy", ["elastic", "guardian", "frequent"])
def test_heavy_fold(spark, folder, arrivals, strategy):
    out = G.drain(G.stream_heavy_fold(source(spark, folder), SPEC, strategy, shards=1))
    whole = H.heavy_fold(arrivals, SPEC, strategy)
    columns = ("bucket", "key", "v", "flag")
    assert rows(G.latest_residents(out).select(*columns)) == rows(H.heavy_query_all(whole).select(*columns))
    moved = ("kind", "bucket", "seq", "key", "f")
    assert rows(out.filter("kind != 'heavy'").select(*moved)) == rows(whole.filter("kind != 'heavy'").select(*moved))


def test_shards_keep_all_weight(spark, folder, arrivals):
    out = G.drain(G.stream_heavy_fold(source(spark, folder), SPEC, "frequent", shards=4))
    held = G.latest_residents(out).agg(F.sum("v")).first()[0]
    handed = out.filter("kind != 'heavy'").agg(F.sum("f")).first()[0] or 0
    assert held + handed == arrivals.count()


@pytest.mark.parametrize("shards", [1, 3])
def test_extract(spark, folder, arrivals, shards):
    path = scratch_path(spark, "extract")
    G.stream_extract(source(spark, folder), SPEC, "elastic", path, shards)
    heavy, counters = G.load_stream_extract(spark, path, SPEC)
    dealt = arrivals.withColumn("seq", F.col("seq") % shards * 10_000 + F.floor(F.col("seq") / shards))
    residents, residual = H.merge_shards(H.heavy_fold(dealt, SPEC, "elastic", 10_000), SPEC)
    built = U.universal_build(residual, SPEC)
    assert rows(counters.select(*built.columns)) == rows(built)
    assert rows(heavy.select("key", "v", "flag")) == rows(residents.select("key", "v", "flag"))


def test_only_changed_slots_are_emitted_and_restarts_go_on(spark):
    """Six triggers, the query stopped after each; all but the first touch one key."""
    source_path, path = scratch_path(spark, "drip"), scratch_path(spark, "drip-out")
    spec = SPEC.with_sizes(buckets=2, slots=8)
    keys = list(range(14)) + [3] * 5
    whole = []
    for i, keys_now in enumerate([keys[:14], *([k] for k in keys[14:])]):
        part = [(len(whole) + j, k, 1) for j, k in enumerate(keys_now)]
        whole += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source_path)
        stream_ = spark.readStream.schema(SCHEMA).parquet(source_path)
        G.run_available(G.stream_heavy_fold(stream_, spec, "frequent", shards=1), "append", path)
    out = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    emitted = {r["batch"]: r["count"] for r in out.filter("kind = 'heavy'").groupBy("batch").count().collect()}
    assert len(emitted) == 6 and all(emitted[b] <= 1 for b in list(sorted(emitted))[1:])
    folded = H.heavy_fold(spark.createDataFrame(whole, SCHEMA), spec, "frequent")
    columns = ("bucket", "key", "v", "flag")
    assert rows(G.latest_residents(out).select(*columns)) == rows(H.heavy_query_all(folded).select(*columns))


def test_micro_batches_are_bounded_and_in_order(spark):
    """However the arrivals lie in files, states see blocks of them in order and end where one replay ends."""
    users = S.users(spark, SF_DIR).repartition(5)
    spec = SketchSpec(rows=3, width=64, levels=8, capacity=64, buckets=8, slots=4, seed=3, shard_rows=None)
    rows = materialize(G.drain(G.stream_heavy_fold(G.land_in_order(users, 1500), spec, "frequent", shards=1)))
    assert rows.select("batch").distinct().count() == 7
    assert rows.filter("kind <> 'heavy'").groupBy("batch").count().agg({"count": "max"}).first()[0] <= 1500
    folded = H.heavy_fold(users, spec, "frequent")
    whole = lambda df: sorted(map(tuple, df.select("bucket", "key", "v", "flag").collect()))
    assert whole(G.latest_residents(rows)) == whole(H.heavy_query_all(folded))
    moved = lambda df: sorted(map(tuple, df.filter("kind <> 'heavy'").select("kind", "seq", "key", "f", "flag").collect()))
    assert moved(rows) == moved(folded)


def test_sparse_and_negative_numbers_land_whole(spark):
    numbers = [-(2**61), -1501, -1, 0, 7, 1499, 1500, 2**60 + 1, 2**60 + 3]
    users = spark.createDataFrame([(i, n, 1) for i, n in enumerate(numbers)], "key bigint, seq bigint, weight bigint")
    found = G.drain(G.land_in_order(users, 3)).select("batch", "seq").orderBy("batch", "seq").collect()
    assert [r.seq for r in found] == numbers and {r.batch for r in found} == {0, 1, 2}
