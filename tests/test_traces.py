"""Binary traces: record edges, numbering, byte order, commits, and a plan without jobs."""

import numpy as np
import pytest

from tallyweave.sources import binary as R

FLOW = R.record_type("flow")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = np.zeros(5000, FLOW)
    for name, kind in R.LAYOUTS["flow"]:
        out[name] = rng.random(5000) if name == "ts" else rng.integers(0, 1 << (8 * int(kind[1])), 5000, dtype=np.uint64)
    return out


def as_tuples(rows, first=0):
    return [(first + i, *(float(x) if isinstance(x, float) else int(x) for x in r.tolist())) for i, r in enumerate(rows)]


def read_back(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("split", ["1000", "128m"])
def test_files_are_cut_on_record_edges_and_numbered(spark, tmp_path, rows, split):
    for i, (a, z) in enumerate([(0, 1), (1, 1700), (1700, 1700), (1700, 5000)]):
        (tmp_path / f"{i}.dat").write_bytes(rows[a:z].tobytes())
    (tmp_path / ".hidden.dat").write_bytes(b"x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = R.read_trace_dir(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == (3 if split == "128m" else 1 + -(-1699 // 47) + -(-3300 // 47))
        assert read_back(df) == as_tuples(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_planning_runs_no_job(spark, tmp_path, rows):
    (tmp_path / "a.dat").write_bytes(rows.tobytes())
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "reader")
    R.read_flow_trace(spark, str(tmp_path / "a.dat")).filter("proto = 6")._jdf.queryExecution().executedPlan()
    assert len(tracker.getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("byte_order", ["little", "big"])
def test_round_trip(spark, tmp_path, rows, byte_order):
    names = "seq bigint, src_ip bigint, dst_ip bigint, src_port bigint, dst_port bigint, proto bigint, ts double"
    stream = spark.createDataFrame(as_tuples(rows, 100), names).repartition(5)
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/named"):
        parts = R.write_trace(stream, folder, "flow", byte_order).collect()
        assert sum(p.records for p in parts) == 5000
        assert read_back(R.read_trace_dir(spark, folder, byte_order=byte_order)) == as_tuples(rows)
        assert read_back(R.read_flow_trace(spark, folder, byte_order)) == as_tuples(rows)


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    broken = spark.range(1000).selectExpr("id AS seq", "IF(id = 777, CAST(raise_error('x') AS BIGINT), id) AS key").repartition(4)
    with pytest.raises(Exception, match="x"):
        R.write_trace(broken, str(tmp_path / "t"), "id").collect()
    assert not list((tmp_path / "t").glob("part-*")) if (tmp_path / "t").exists() else True


def test_empty_torn_and_missing_traces(spark, tmp_path):
    (tmp_path / "none.dat").write_bytes(b"")
    assert R.read_id_stream(spark, str(tmp_path / "none.dat")).count() == 0
    (tmp_path / "torn.dat").write_bytes(b"12345")
    with pytest.raises(ValueError):
        R.read_id_stream(spark, str(tmp_path / "torn.dat"))
    with pytest.raises(FileNotFoundError):
        R.read_id_stream(spark, str(tmp_path / "*.absent"))
    assert R.write_trace(spark.createDataFrame([], "seq long, key long"), str(tmp_path / "empty"), "id").count() == 0
