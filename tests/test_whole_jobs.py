"""Registered queries do the whole job, also where tables outgrow the sizes of the given ones."""

import pytest

from tallyweave.operators import exact as X
from tallyweave.plans import evaluate as A
from tallyweave.plans import load_queries
from tests.compare import TABLES, difference

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["eval_gsum_job_grid", "eval_frequency_job_grid", "eval_gsum_job_self_join", "eval_heavy_hitter_job", "eval_similarity_job"])
def test_jobs_cover_every_setting(spark, monkeypatch, name):
    monkeypatch.setattr(A, "run_sweep", lambda *args: args[-3:-1])
    specs, algos = load_queries()[name].build(spark, SF_DIR)
    assert [mem for mem, _ in specs] == [m for m in A.DEFAULT_MEMORY for _ in range(5)] and len({s for _, s in specs}) == 25
    assert sorted(algos) == sorted(A.ALGORITHMS)


@pytest.fixture(scope="module")
def many_keys(spark, tmp_path_factory):
    """More keys than any size that was fixed: 6000 suppliers, 210,000 users, 1500 event types, each twice at least."""
    folder = tmp_path_factory.mktemp("many")
    for name in TABLES:
        frame = spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(1)
        if name == "lineitem":
            frame = spark.range(13_000).selectExpr("id % 6000 AS l_suppkey", "id % 3000 AS l_partkey", "id AS l_orderkey")
        elif name == "events":
            frame = spark.range(420_000).selectExpr("id AS event_id", "id % 210000 AS user_id", "concat('t', id % 1500) AS event_type")
        frame.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        part, = (folder / f"{name}.parquet").glob("*.parquet")
        (folder / "flat").mkdir(exist_ok=True)
        (folder / "flat" / f"{name}.parquet").write_bytes(part.read_bytes())
    return str(folder / "flat")


@pytest.mark.parametrize("name", ["topk_builtin", "topk_builtin_merged", "heavy_spacesaving"])
def test_summaries_hold_every_key(spark, many_keys, name):
    q = load_queries()[name]
    assert difference(q.build(spark, many_keys), q.sql, many_keys) is None


def test_keys_dealt_to_several_parts_are_all_counted(spark):
    stream = spark.range(10_000).selectExpr("id % 3000 AS key")
    dealt, most = X.dealt_keys(stream, part_keys=400)
    assert 375 <= most < 600 and dealt.select("_part").distinct().count() == 8
    found = X.topk_builtin(dealt, most, most, ["_part"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stream.groupBy("key").count().collect()))
