"""Jobs over many settings at once beside the operators of one setting, and replays beside the machines they replace."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions.weights import WEIGHTS
from tallyweave.operators import bundle as B
from tallyweave.operators import extract as E
from tallyweave.operators import grid, replay
from tallyweave.operators import twostream as T
from tallyweave.operators.exact import gsum_exact, heavy_hitters_exact, key_counts
from tallyweave.operators.grid import Grid, grid_estimates
from tallyweave.operators.heavy import heavy_fold
from tallyweave.operators.universal import universal_build, universal_estimates
from tallyweave.operators.waving import waving_build
from tallyweave.plans import evaluate as A
from tallyweave.sources.scratch import materialize

MEMORY, TRIALS = [1500], 2


@pytest.fixture(scope="module")
def streams(spark):
    return arrivals(spark, "bigint")


def arrivals(spark, key_type):
    """4000 arrivals of 700 keys, a third of them in one key, with weights of 1 to 3, in streams A and B by turns."""
    key = "CASE WHEN id % 3 = 0 THEN -7 ELSE (id * 7919 + id * id) % 700 END"
    rows = spark.range(4000).selectExpr(f"CAST({key} AS {key_type}) AS key", "id * 3 AS seq", "1 + id % 3 AS weight",
                                        "CASE WHEN id DIV 100 % 2 = 0 THEN 'A' ELSE 'B' END AS stream")
    return materialize(rows)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(replay, "BLOCK_ROWS", 1000)
    monkeypatch.setattr(replay, "FEW_BUCKETS", 3)


def one_by_one(specs, algos, value):
    """The mean over the trials of ``value(mem, spec, algo)``, found by the plain operators."""
    found = {}
    for mem, spec in specs:
        for algo in algos:
            found.setdefault((mem // 1000, algo), []).append(value(mem, spec, algo).first()[0])
    return {k: pytest.approx(np.mean(v), rel=1e-9, abs=1e-12) for k, v in found.items()}


def summary(stream, mem, spec, algo):
    if algo == A.UNIVERSAL:
        return E.extract_build(stream, A.universal_spec(mem, spec), mode="estimated")
    return E.extract_build(stream, spec, A.ROUTES[algo], mode="estimated")


def of(result):
    return {(r["mem"], r["algo"]): r["value"] for r in result.collect()}


def test_frequency_job(spark, streams):
    counts, g = materialize(key_counts(streams)), WEIGHTS["sum"]
    asked = lambda mem, spec, algo: (B.bundle_query(counts, B.bundle_build(streams, spec, parts=("point",))) if algo == A.BASELINE
                                     else E.extract_query(counts, summary(streams, mem, spec, algo)))
    wanted = one_by_one(A.sweep_specs(MEMORY, TRIALS), A.ALGORITHMS, lambda *setting: A.frequency_error(asked(*setting), g))
    assert of(A.eval_frequency_job(streams, "sum", MEMORY, TRIALS)) == wanted


@pytest.mark.parametrize("weight", ["entropy", "sqr"])
def test_gsum_job(spark, streams, weight):
    g, algos = WEIGHTS[weight], ["H", A.BASELINE]
    real = materialize(gsum_exact(key_counts(streams), g))

    def value(mem, spec, algo):
        if algo != A.BASELINE:
            return A.relative_error(E.extract_gsum(summary(streams, mem, spec, algo), g), real)
        if weight == "sqr":
            b = B.bundle_build(streams, spec, parts=("join",))
            return A.relative_error(B.bundle_inner_product(b, b), real)
        return A.relative_error(B.bundle_gsum(B.bundle_build(streams, spec, parts=("point",)), weight), real)

    assert of(A.eval_gsum_job(streams, weight, MEMORY, TRIALS, algos)) == one_by_one(A.sweep_specs(MEMORY, TRIALS), algos, value)


def test_heavy_hitter_job(spark, streams):
    counts, g, lam, algos = materialize(key_counts(streams)), WEIGHTS["sum"], 0.002, ["L", A.UNIVERSAL, A.BASELINE]
    truth = materialize(heavy_hitters_exact(counts, g, lam))
    threshold = float(int(gsum_exact(counts, g).first()["gsum"] * lam))

    def value(mem, spec, algo):
        if algo == A.BASELINE:
            b = B.bundle_build(streams, spec, use_elastic=False, parts=("point",))
            reported = B.bundle_heavy_hitters(b, 1).filter(g(F.col("v")) >= threshold)
        else:
            reported = E.extract_g_heavy_hitters(summary(streams, mem, spec, algo), g, threshold)
        return A.heavy_hitter_scores(reported, truth).select("f1")

    assert of(A.eval_heavy_hitter_job(streams, "sum", lam, MEMORY, TRIALS, algos)) == one_by_one(A.sweep_specs(MEMORY, TRIALS), algos, value)


@pytest.mark.parametrize("task", list(A.SIMILARITIES))
def test_similarity_job(spark, streams, task):
    exact, estimate, baseline, part = {
        "cosine": (T.cosine_exact, T.cosine_est, B.bundle_cosine, "join"),
        "jaccard": (T.jaccard_exact, T.jaccard_est, B.bundle_jaccard, "registers"),
        "inner_product": (T.inner_product_exact, T.inner_product_est, B.bundle_inner_product, "join")}[task]
    real, algos = materialize(exact(T.pair_counts(streams))), ["E", A.BASELINE]
    a, b = (streams.filter(F.col("stream") == s) for s in ("A", "B"))

    def value(mem, spec, algo):
        if algo == A.BASELINE:
            return A.relative_error(baseline(*(B.bundle_build(s, spec, parts=(part,)) for s in (a, b))), real)
        return A.relative_error(estimate(*(summary(s, mem, spec, algo) for s in (a, b))), real)

    found = {algo: v for (_, algo), v in one_by_one(A.sweep_specs([MEMORY[0] // 2], 1), algos, value).items()}
    assert {algo: v for (_, algo), v in of(A.eval_similarity_job(streams, task, MEMORY, 1, algos)).items()} == found


@pytest.mark.parametrize("few, most, key_type", [(1, 1 << 20, "bigint"), (10_000, 1 << 20, "bigint"), (8, 100, "string")])
def test_replays_are_those_of_the_machines(spark, monkeypatch, few, most, key_type):
    """Whether buckets are stepped through side by side or one by one, and when hand-ons are let go of."""
    monkeypatch.setattr(replay, "FEW_BUCKETS", few)
    monkeypatch.setattr(replay, "REST_ROWS", most)
    streams, spec = arrivals(spark, key_type), A.sweep_specs([4000], 1)[0][1]
    sums = lambda df: sorted(map(tuple, df.groupBy("key", F.expr("kind = 'heavy'")).agg(F.sum("f"), F.max("flag"), F.max("bucket")).filter(
        "`(kind = heavy)`").collect())) + sorted(map(tuple, df.filter("kind <> 'heavy'").groupBy("key").agg(F.sum("f")).collect()))
    found = materialize(replay.guard_replays(streams, [spec], ["elastic", "guardian", "frequent"]))
    for lane, strategy in enumerate(["elastic", "guardian", "frequent"]):
        assert sums(found.filter(F.col("lane") == lane)) == sums(heavy_fold(streams, spec, strategy))
    columns = ["kind", "bucket", "pos", "key", "f"]
    waves, plain = (df.select(*columns).collect() for df in (replay.waving_replays(streams, [spec]), waving_build(streams, spec)))
    assert sorted(map(str, waves)) == sorted(map(str, plain))


def test_wide_grids_are_joined(spark, streams, monkeypatch):
    specs = [s for _, s in A.sweep_specs([4000, 9000], 1)]
    counts = key_counts(streams).selectExpr("key", "f AS weight")
    both = Grid(tuple(specs))
    residual = grid.all_settings(counts, both)
    counters = materialize(grid.grid_build(residual, both))
    pairs = residual.selectExpr("cfg", "1 AS level", "key")
    small = sorted(map(tuple, grid_estimates(pairs, counters, both).collect()))
    monkeypatch.setattr(grid, "BROADCAST_CELLS", 1)
    assert sorted(map(tuple, grid_estimates(pairs, counters, both).collect())) == small
    for cfg, spec in enumerate(specs):
        plain = universal_estimates(counts.selectExpr("1 AS level", "key"), universal_build(counts, spec), spec)
        assert sorted((cfg, *r) for r in plain.collect()) == [r for r in small if r[0] == cfg]
