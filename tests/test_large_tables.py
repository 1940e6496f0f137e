"""Registered queries beside their SQL on tables that reach what only larger ones hold: long streams, wide keys."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyweave.functions.weights import WEIGHTS
from tallyweave.operators import heavy
from tallyweave.operators.heavy import heavy_fold
from tallyweave.operators.universal import local_candidates, universal_candidates
from tallyweave.plans import io_queries, load_queries
from tallyweave.plans import streams as S
from tallyweave.plans.linear_queries import SIGNED_KEYS
from tallyweave.sources.scratch import materialize
from tallyweave.spec import SketchSpec
from tests.compare import TABLES, difference

SF_DIR = "/root/testdata/sf0.01"
CHANGED = {
    # Arrival numbers on both sides of the first edge of a default shard.
    "events": "SELECT * REPLACE (event_id + 3995000 AS event_id) FROM src",
}


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    folder = tmp_path_factory.mktemp("large")
    for name in TABLES:
        sql = CHANGED.get(name, "SELECT * FROM src").replace("src", f"'{SF_DIR}/{name}.parquet'")
        duckdb.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["waving_heavy_hitters", "baseline_bundle_heavy_hitters", "waving_casts", "elastic_light",
                                  "three_tier_build", "heavy_fold_elastic", "extract_frequent_gsum"])
def test_replays_do_not_end_at_an_edge_of_shards(spark, large, name):
    q = load_queries()[name]
    assert difference(q.build(spark, large), q.sql, large) is None


@pytest.mark.parametrize("name", ["hash_bucket", "hash_two_universal"])
def test_keys_beyond_64_bits_keep_their_lowest_bits(spark, tmp_path, name):
    pairs = [(1, 0), (701, 5), (1_199_999, 59_999), (300_000, 40_000), (650, 59_999), (1, 4_000_000), (90_000_000, 2_000_000)]
    spark.createDataFrame(pairs, "l_partkey bigint, l_suppkey bigint").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = [((p - 700) * 4000000007 * (s + 1) + 2**63) % 2**64 - 2**63 for p, s in pairs]
    q = load_queries()[name]
    given = " UNION ALL ".join(f"SELECT {k}::BIGINT AS key" for k in keys)
    wanted = duckdb.execute(q.sql.replace(SIGNED_KEYS, given)).fetchall()
    assert sorted(map(tuple, q.build(spark, str(tmp_path)).collect())) == sorted(wanted)


WHOLE_SUMS = [f"universal_gsum_{g}" for g in WEIGHTS] + [
    "universal_gsum_subset", "universal_entropy", "universal_gsum_mul", "extract_gsum_full", "extract_gsum_subset", "extract_only_universal"]


@pytest.mark.parametrize("name", WHOLE_SUMS)
def test_full_sketches_give_the_exact_sum(spark, name):
    """Every key counts: the SQL is a plain sum over all of them, without lists, levels or limits."""
    q = load_queries()[name]
    assert difference(q.build(spark, SF_DIR), q.sql, SF_DIR) is None
    assert "QUALIFY" not in q.sql and "level" not in q.sql


def test_uncut_levels_are_not_ranked(spark, capsys):
    counts = spark.range(5000).selectExpr("id AS key", "id % 7 + 1 AS f")
    spec = SketchSpec(levels=6, capacity=None, seed=5)
    found = universal_candidates(counts, spec)
    found.explain()
    assert found.filter("level = 0").count() == 5000 and "Window" not in capsys.readouterr().out


def test_long_lists_are_not_kept_by_tasks(spark, capsys):
    stream = spark.range(3000).selectExpr("id % 1000 AS key", "1L AS weight")
    found = local_candidates(stream, SketchSpec(levels=4, capacity=1 << 20, seed=5))
    found.explain()
    assert "Pandas" not in capsys.readouterr().out and found.filter("level = 0").count() == 1000


def test_tasks_of_the_sweep_hold_a_fixed_number_of_positions(spark, monkeypatch):
    monkeypatch.setattr(io_queries, "SWEPT_ROWS", 1000)
    swept, dealt = io_queries.Z.zipf_sweep, []
    monkeypatch.setattr(io_queries.Z, "zipf_sweep", lambda numbers, *args: dealt.append(numbers.rdd.getNumPartitions()) or swept(numbers, *args))
    q = load_queries()["zipf_sweep"]
    assert difference(q.build(spark, SF_DIR), q.sql, SF_DIR) is None and dealt == [10]


@pytest.mark.parametrize("strategy", ["elastic", "guardian", "frequent"])
def test_hand_ons_are_added_up_by_key(spark, monkeypatch, strategy):
    spec, users = SketchSpec(buckets=4, slots=5, seed=9, shard_rows=None), S.users(spark, SF_DIR)
    plain = materialize(heavy_fold(users, spec, strategy))
    sums = lambda folded: sorted(map(tuple, folded.groupBy("key", F.expr("kind = 'heavy'")).agg(F.sum("f")).collect()))
    for most in (100_000, 3):
        monkeypatch.setattr(heavy, "REST_KEYS", most)
        totals = materialize(heavy_fold(users, spec, strategy, totals=True))
        assert sums(totals) == sums(plain)
        rest = totals.filter("kind <> 'heavy'")
        assert most == 3 or rest.count() == rest.select("key").distinct().count()
