"""Accuracy of the summaries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.weights import WEIGHTS
from tallyweave.operators import exact as X
from tallyweave.operators import linear as L
from tallyweave.operators import universal as U
from tallyweave.operators import waving as V
from tallyweave.plans import baseline_queries as BQ
from tallyweave.plans import evaluate as A
from tallyweave.plans import linear_queries as LQ
from tallyweave.plans import sqltext as Q
from tallyweave.plans import streams as S
from tallyweave.plans import summary_queries as M
from tallyweave.plans.exact_queries import PART_COUNTS, part_counts, rounded
from tallyweave.plans.registry import query
from tallyweave.spec import SketchSpec

SPEC = LQ.SPEC
ESTIMATES = {"c": PART_COUNTS, "t": LQ.CELLS, "p": Q.estimates(S.PARTS, "t", SPEC, "count"),
             "e": "SELECT key, f, est FROM c JOIN p USING (key)"}


def estimates(spark, d):
    """Parts with their true counts and Count-Sketch estimates."""
    counts = part_counts(spark, d)
    return L.count_sketch_query(counts, L.count_sketch_build(M.as_stream(counts), SPEC), SPEC)


@query("eval_relative_error", Q.chain(
    f"SELECT round(abs(gsum - real) / real, 9) AS error FROM ({Q.level_gsum('SELECT * FROM k', M.CUT, 'entropy')}), "
    f"(SELECT sum({Q.g_sql('entropy', 'f')}) AS real FROM c)", **M.PART_LEVELS))
def _(spark, d):
    real = X.gsum_exact(part_counts(spark, d), WEIGHTS["entropy"])
    return rounded(A.relative_error(U.universal_gsum(M.tracked(spark, d), M.CUT, WEIGHTS["entropy"]), real), "error", digits=9)


@query("eval_frequency_error", Q.chain(f"SELECT round(avg(abs({Q.g_sql('entropy', 'est')} - {Q.g_sql('entropy', 'f')})), 6) AS error FROM e", **ESTIMATES))
def _(spark, d):
    return rounded(A.frequency_error(estimates(spark, d), WEIGHTS["entropy"]), "error")


@query("eval_aae", Q.chain("SELECT round(avg(abs(est - f)), 6) AS aae FROM e", **ESTIMATES))
def _(spark, d):
    return rounded(A.average_absolute_error(estimates(spark, d)), "aae")


@query("eval_heavy_hitter_f1", Q.chain(
    """SELECT r AS reported, t AS real, x AS hit, round(CASE WHEN r > 0 THEN x / r ELSE 0.0 END, 9) AS precision,
 round(CASE WHEN t > 0 THEN x / t ELSE 0.0 END, 9) AS recall, round(CASE WHEN r + t > 0 THEN 2.0::DOUBLE * x / (r + t) ELSE 0.0 END, 9) AS f1
 FROM (SELECT count(*) FILTER (est >= 40) AS r, count(*) FILTER (f >= 40) AS t, count(*) FILTER (est >= 40 AND f >= 40) AS x FROM e)""", **ESTIMATES))
def _(spark, d):
    e = estimates(spark, d)
    scores = A.heavy_hitter_scores(e.filter(F.col("est") >= 40), e.filter(F.col("f") >= 40))
    return rounded(scores, "precision", "recall", "f1", digits=9)


_share = lambda a, b: f"round(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END, 9)"
ARE_CR_PR = f"""round(coalesce(avg(abs(f - abs(est))) FILTER (f > 35 AND abs(est) > 35), 0.0), 6) AS aae,
 round(coalesce(avg(abs(f - abs(est)) / f) FILTER (f > 35 AND abs(est) > 35), 0.0), 6) AS are,
 {_share('count(*) FILTER (f > 35 AND abs(est) > 35)', 'count(*) FILTER (f > 35)')} AS recall,
 {_share('count(*) FILTER (f > 35 AND abs(est) > 35)', 'count(*) FILTER (abs(est) > 35)')} AS precision"""


def scored(df):
    return rounded(rounded(df, "aae", "are"), "recall", "precision", digits=9)


@query("eval_are_cr_pr", Q.chain(f"SELECT {ARE_CR_PR} FROM e", **ESTIMATES))
def _(spark, d):
    return scored(A.are_cr_pr(estimates(spark, d), 35))


EPOCHS, BATCH = 4, 25
_draws = "\n UNION ALL ".join(
    f"SELECT * FROM (SELECT {i} AS epoch, f, est FROM e WHERE f > 30 ORDER BY {Q.one_hash('key', 1, 'epoch', level=i)}, key LIMIT {BATCH})" for i in range(EPOCHS))


@query("eval_subset_batches", Q.chain(
    """SELECT round(avg(abs(r - p) / r), 6) AS sum_are, round(avg(abs(r - p)), 6) AS sum_aae,
 round(avg(abs(r / n - q / greatest(1, h)) / (r / n)), 6) AS avg_are, round(avg(abs(r / n - q / greatest(1, h))), 6) AS avg_aae FROM g""",
    **ESTIMATES, d=_draws,
    g="SELECT epoch, sum(f)::DOUBLE AS r, sum(est) AS p, count(*) AS n, coalesce(sum(est) FILTER (est > 30), 0) AS q, count(*) FILTER (est > 30) AS h FROM d GROUP BY epoch"))
def _(spark, d):
    result = A.subset_batches(estimates(spark, d), 30, EPOCHS, BATCH)
    return rounded(result, *result.columns)


SHARDS = 4
_shard_key = f"{Q.bucket_sql('key', 7, SHARDS, 'shard')}"
_sharded_cells = {
    "c": PART_COUNTS,
    "q": f"SELECT c.key, c.f, c.shard, v.row, {Q.table_hash('c.key', False)} AS h FROM (SELECT *, {_shard_key} AS shard FROM c) c CROSS JOIN {Q.values(SPEC.seed, 'count', SPEC.rows)}".replace(
        f"AS c(level, row", "AS v(level, row").replace("c.a", "v.a").replace("c.b", "v.b").replace("c.c", "v.c"),
    "t": f"SELECT shard, row, (h >> 1) % {SPEC.width} AS idx, sum((1 - 2 * (h & 1)) * f)::BIGINT AS v FROM q GROUP BY ALL",
    "e": f"SELECT key, any_value(f) AS f, median((1 - 2 * (h & 1)) * t.v) AS est FROM q JOIN t ON t.shard = q.shard AND t.row = q.row AND t.idx = (h >> 1) % {SPEC.width} GROUP BY key"}


@query("eval_sharded", Q.chain(f"SELECT {ARE_CR_PR} FROM e", **_sharded_cells))
def _(spark, d):
    """Keys spread over several sketches; each key is asked at its own."""
    from tallyweave.functions.hashing import cell_of, hash_bucket, sign_of
    from tallyweave.functions.medians import median_of_group

    counts = part_counts(spark, d).withColumn("shard", hash_bucket(F.col("key"), 7, SHARDS, "shard"))
    cells = L.count_sketch_build(counts.withColumn("weight", F.col("f")), SPEC, by=["shard"])
    probe = L.with_row_hash(counts, SPEC, "count").withColumn("idx", cell_of(F.col("h"), SPEC.width))
    seen = probe.join(cells, ["shard", "row", "idx"], "left").groupBy("key", "f").agg(
        median_of_group(sign_of(F.col("h")) * F.coalesce("v", F.lit(0))).alias("est"))
    return scored(A.are_cr_pr(seen, 35))


# --- sweeps -----------------------------------------------------------------------------

SWEEP = [(w, t, SketchSpec(rows=3, width=w, seed=41).with_trial(t)) for w in (128, 256, 512) for t in range(3)]
_settings = " UNION ALL ".join(
    f"SELECT {w}::BIGINT AS mem, {t}::BIGINT AS trial, (SELECT avg(abs(est - f)) FROM c JOIN ({Q.estimates('SELECT key FROM c', f't{w}_{t}', s, 'count')}) USING (key)) AS aae"
    for w, t, s in SWEEP)
SWEEP_CTES = {"c": PART_COUNTS} | {f"t{w}_{t}": Q.cells("SELECT key, f AS weight FROM c", s, "count") for w, t, s in SWEEP} | {"r": _settings}


def swept(spark, d):
    specs = [s for _, _, s in SWEEP]
    counts = part_counts(spark, d)
    errors = A.sweep_errors(counts, A.sweep_build(M.as_stream(counts), specs), specs)
    mem, trial = (F.get(F.expr(f"array({','.join(f'{x[i]}L' for x in SWEEP)})"), F.col("cfg")) for i in (0, 1))
    return errors.select(mem.alias("mem"), trial.alias("trial"), "aae")


@query("eval_memory_sweep", Q.chain("SELECT mem, trial, round(aae, 6) AS aae FROM r", **SWEEP_CTES))
def _(spark, d):
    return rounded(swept(spark, d), "aae")


@query("eval_trials", Q.chain("SELECT mem, round(avg(aae), 6) AS aae FROM r GROUP BY mem", **SWEEP_CTES))
def _(spark, d):
    return rounded(swept(spark, d).groupBy("mem").agg(F.avg("aae").alias("aae")), "aae")


# --- jobs -------------------------------------------------------------------------------

MEMORY = 3_000
LIKE = A.sweep_specs([MEMORY], 1)[0][1]
ALONE = A.universal_spec(MEMORY, LIKE)
ORDERED = ("E", "H", "L")
USER_COUNTS = S.counts_sql(S.USERS)


def estimated_ctes(strategy: str) -> dict[str, str]:
    """An ordered summary whose candidates are ranked by estimates."""
    ctes = M.replay_ctes(S.USERS, LIKE, strategy)
    ctes["e"] = Q.level_estimates("SELECT level, key FROM s", "u", LIKE)
    ctes["w"] = "SELECT level, key, greatest(1, floor(est))::BIGINT AS f FROM e"
    ctes.pop("k")
    return ctes | {"k": Q.cut("w", LIKE)}


def elastic_ctes() -> dict[str, str]:
    cell = Q.bucket_sql("key", LIKE.seed, LIKE.width, "light")
    return {"st": Q.heavy_replay(S.USERS, LIKE, "elastic", slots=BQ.E.ELASTIC_SLOTS), "h": Q.replay_heavy("st"), "m": Q.replay_moved("st"),
            "li": BQ.ELASTIC_CTES["li"].replace(BQ._cell, cell)}


def job_sql(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {MEMORY // 1000}::BIGINT AS mem, '{algo}' AS algo, round(value, 6)::DOUBLE AS value FROM ({body})" for algo, body in parts.items())


def _gsum_parts(g: str) -> dict[str, str]:
    error = f"abs(gsum - (SELECT sum({Q.g_sql(g, 'f')}) FROM ({USER_COUNTS}))) / (SELECT sum({Q.g_sql(g, 'f')}) FROM ({USER_COUNTS})) AS value"
    parts = {algo: f"SELECT {error} FROM ({Q.chain(M.gsum_sql(LIKE, g), **estimated_ctes(A.ROUTES[algo]))})" for algo in ORDERED}
    parts[A.UNIVERSAL] = f"SELECT {error} FROM ({Q.chain(Q.level_gsum('SELECT * FROM k', ALONE, g), **M.level_ctes(S.USERS, ALONE, 'estimated'))})"
    return parts


def _frequency_parts(g: str) -> dict[str, str]:
    error = f"avg(abs({Q.g_sql(g, 'e.est')} - {Q.g_sql(g, 'c.f')})) AS value"
    over = lambda body: f"SELECT {error} FROM ({body}) e JOIN ({USER_COUNTS}) c ON c.key = e.key"
    keys = "SELECT DISTINCT user_id AS key FROM events"
    parts = {algo: over(Q.chain(M.value_sql(keys, LIKE), **estimated_ctes(A.ROUTES[algo]))) for algo in ORDERED}
    levels = {k: v for k, v in M.level_ctes(S.USERS, ALONE).items() if k in "csu"}
    parts[A.UNIVERSAL] = over(Q.chain("SELECT key, greatest(0.0, est) AS est FROM p", **levels,
                                      p=Q.level_estimates("SELECT 0 AS level, key FROM c", "u", ALONE)))
    cell = Q.bucket_sql("k.key", LIKE.seed, LIKE.width, "light")
    parts[A.BASELINE] = over(Q.chain(
        f"SELECT k.key, coalesce(h.v, 0) + CASE WHEN h.v IS NULL OR h.flag THEN coalesce(li.v, 0) ELSE 0 END AS est "
        f"FROM ({keys}) k LEFT JOIN h ON h.key = k.key LEFT JOIN li ON li.idx = {cell}", **elastic_ctes()))
    return parts


# The sums of the ordered strategies and of the universal sketch alone, at one memory; the jobs below add the rest.
@query("eval_gsum_job", job_sql(_gsum_parts("entropy")))
def _(spark, d):
    return rounded(A.eval_gsum_job(S.users(spark, d), "entropy", [MEMORY], trials=1, algos=(*ORDERED, A.UNIVERSAL)), "value")


@query("eval_frequency_job", job_sql(_frequency_parts("sum")))
def _(spark, d):
    return rounded(A.eval_frequency_job(S.users(spark, d), "sum", [MEMORY], trials=1, algos=(*ORDERED, A.UNIVERSAL, A.BASELINE)), "value")


# The two jobs above are the one setting that their SQL can say; these are whole: every memory, trial and algorithm.
@query("eval_gsum_job_grid")
def _(spark, d):
    return A.eval_gsum_job(S.users(spark, d), "entropy")


@query("eval_frequency_job_grid")
def _(spark, d):
    return A.eval_frequency_job(S.users(spark, d), "sum")


@query("eval_gsum_job_self_join")
def _(spark, d):
    return A.eval_gsum_job(S.users(spark, d), "sqr")


@query("eval_heavy_hitter_job")
def _(spark, d):
    return A.eval_heavy_hitter_job(S.users(spark, d), "sum", lam=0.007)


@query("eval_similarity_job")
def _(spark, d):
    return A.eval_similarity_job(S.users_ab(spark, d), "cosine")
