"""Accuracy of the summaries as queries, and the evaluation jobs built from them.

Jobs return ``(mem, algo, value)``, averaged over trials; ``result_table`` turns that into one
column per algorithm. All settings of an algorithm are one plan with the setting as a column, so a stream is
read, replayed and asked once whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.hashing import cell_text, coefficients_at, hash_fn, hash_value, sign_of, with_hashes, with_lanes
from tallyweave.functions.medians import median_of_group
from tallyweave.functions.weights import WEIGHTS, g1_one, g1_sqr
from tallyweave.operators import grid as M
from tallyweave.operators.elastic import LIGHT_MAX
from tallyweave.operators.exact import gsum_exact, heavy_hitters_exact, key_counts, top_per_group
from tallyweave.operators.heavy import partition_candidates
from tallyweave.operators.joinsketch import HEAVY_THRESHOLD
from tallyweave.operators.linear import is_text
from tallyweave.operators.replay import elastic_replays, guard_replays, tier_replays, waving_replays
from tallyweave.operators.spacesaving import spacesaving_tree
from tallyweave.operators.twostream import cosine_exact, inner_product_exact, jaccard_exact, pair_counts
from tallyweave.sources.scratch import materialize
from tallyweave.spec import SHARD_ROWS, SketchSpec, sketch_params_from_memory

G = Callable[[Column], Column]
ROUTES = {"E": "elastic", "H": "guardian", "S": "spacesaving", "L": "frequent"}
BASELINE = "baseline"
UNIVERSAL = "universal"
# Published default settings.
DEFAULT_MEMORY = range(100_000, 1_000_000, 200_000)
DEFAULT_HEAVY_RATIO = 0.6
DEFAULT_COUNTER_RATIO = 0.9
DEFAULT_LAMBDA = 0.00005
# Counter rows of a whole sweep that may be broadcast.
BROADCAST_ROWS = 2_000_000


def relative_error(estimate: DataFrame, real: DataFrame) -> DataFrame:
    """``|estimate - real| / real`` of two one-row, one-column tables."""
    a = estimate.toDF("est").withColumn("_one", F.lit(1))
    b = real.toDF("real").withColumn("_one", F.lit(1))
    return a.join(F.broadcast(b), "_one").select(
        (F.abs(F.col("est") - F.col("real")) / F.col("real")).alias("error"))


def frequency_error(estimates: DataFrame, g: G) -> DataFrame:
    """Mean ``|g(est) - g(f)|`` over the keys of ``(key, f, est)``."""
    return estimates.agg(F.avg(F.abs(g(F.col("est")) - g(F.col("f")))).alias("error"))


def average_absolute_error(estimates: DataFrame) -> DataFrame:
    return estimates.agg(F.avg(F.abs(F.col("est") - F.col("f"))).alias("aae"))


def heavy_hitter_scores(reported: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of reported keys; all 0 when nothing is right."""
    pair = reported.select("key").distinct().withColumn("r", F.lit(1)).join(
        truth.select("key").distinct().withColumn("t", F.lit(1)), "key", "full_outer")
    n = pair.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("reported"), F.coalesce(F.sum("t"), F.lit(0)).alias("real"),
        F.coalesce(F.sum(F.when(F.col("r").isNotNull() & F.col("t").isNotNull(), 1)), F.lit(0)).alias("hit"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return n.select(
        "reported", "real", "hit", share(F.col("hit"), F.col("reported")).alias("precision"),
        share(F.col("hit"), F.col("real")).alias("recall"),
        share(F.lit(2.0) * F.col("hit"), F.col("reported") + F.col("real")).alias("f1"))


def are_cr_pr(estimates: DataFrame, cut: int, by: Sequence[str] = ()) -> DataFrame:
    """Errors of the keys really above ``cut`` and found so, with recall and precision."""
    real, found = F.col("f") > cut, F.abs(F.col("est")) > cut
    hit = real & found
    gap = F.abs(F.col("f") - F.abs(F.col("est")))
    n = lambda c: F.sum(c.cast("int"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return estimates.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(hit, gap)), F.lit(0.0)).alias("aae"),
        F.coalesce(F.avg(F.when(hit, gap / F.col("f"))), F.lit(0.0)).alias("are"),
        share(n(hit), n(real)).alias("recall"), share(n(hit), n(found)).alias("precision"))


def subset_batches(estimates: DataFrame, cut: int, epochs: int, batch: int, seed: int = 1) -> DataFrame:
    """Errors of sums and averages over random groups of heavy keys, averaged over epochs.

    A group is the ``batch`` first keys in the order of a hash that changes with the epoch.
    """
    heavy = estimates.filter(F.col("f") > cut)
    text = is_text(estimates)
    order = F.lit(None).cast("bigint")
    for epoch in range(epochs):
        order = F.when(F.col("epoch") == epoch, hash_value(F.col("key"), seed, "epoch", epoch, text=text)).otherwise(order)
    drawn = heavy.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)]))).withColumn("_order", order)
    group = top_per_group(drawn, ["epoch"], [F.col("_order"), F.col("key")], batch, ["key"])
    found = F.col("est") > cut
    sums = group.groupBy("epoch").agg(
        F.sum("f").alias("real"), F.sum("est").alias("pred"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(found, F.col("est")).otherwise(0)).alias("found"), F.sum(found.cast("int")).alias("hit"))
    mean_real, mean_pred = F.col("real") / F.col("n"), F.col("found") / F.greatest(F.lit(1), F.col("hit"))
    return sums.agg(
        F.avg(F.abs(F.col("real") - F.col("pred")) / F.col("real")).alias("sum_are"),
        F.avg(F.abs(F.col("real") - F.col("pred"))).alias("sum_aae"),
        F.avg(F.abs(mean_real - mean_pred) / mean_real).alias("avg_are"),
        F.avg(F.abs(mean_real - mean_pred)).alias("avg_aae"))


# --- sweeps of one linear sketch, all settings in one scan --------------------------------

def _sweep_hash(df: DataFrame, specs: Sequence[SketchSpec]) -> DataFrame:
    """One row per setting ``cfg`` and sketch row: adds ``row``, ``idx`` and the hash ``h``."""
    rows = specs[0].rows
    fns = [hash_fn(spec.seed, "count", 0, r) for spec in specs for r in range(rows)]
    spread = with_lanes(df, is_text(df)).selectExpr("*", f"explode(sequence(0, {len(specs) - 1})) AS cfg").selectExpr(
        "*", f"explode(sequence(0, {rows - 1})) AS row")
    hashed = with_hashes(spread, {"h": coefficients_at(fns, f"cfg * {rows} + row")})
    width = f"get(array({','.join(f'{s.width}L' for s in specs)}), cfg)"
    return hashed.selectExpr("*", f"{cell_text('h', width)} AS idx")


def sweep_build(stream: DataFrame, specs: Sequence[SketchSpec]) -> DataFrame:
    """Count-Sketch counters ``(cfg, row, idx, v)`` of every setting (sizes and seeds may differ)."""
    cells = _sweep_hash(stream.select("key", "weight"), specs)
    return cells.groupBy("cfg", "row", "idx").agg(F.sum(sign_of(F.col("h")) * F.col("weight")).alias("v"))


def sweep_errors(counts: DataFrame, counters: DataFrame, specs: Sequence[SketchSpec]) -> DataFrame:
    """Mean absolute error of each setting over the keys of ``(key, f)``: ``(cfg, aae)``."""
    small = sum(s.rows * s.width for s in specs) <= BROADCAST_ROWS
    seen = _sweep_hash(counts.select("key", "f"), specs).join(
        F.broadcast(counters) if small else counters, ["cfg", "row", "idx"], "left").select(
        "cfg", "key", "f", (sign_of(F.col("h")) * F.coalesce("v", F.lit(0))).alias("x"))
    estimates = seen.groupBy("cfg", "key", "f").agg(median_of_group(F.col("x")).alias("est"))
    return estimates.groupBy("cfg").agg(F.avg(F.abs(F.col("est") - F.col("f"))).alias("aae"))


# --- jobs -------------------------------------------------------------------------------

def sweep_specs(memory: Iterable[int], trials: int, rows: int = 5, seed: int = 1) -> list[tuple[int, SketchSpec]]:
    """One spec per memory size and trial; trials differ in their seeds only. Arrivals are replayed as one shard."""
    return [
        (mem, sketch_params_from_memory(mem, DEFAULT_HEAVY_RATIO, rows, DEFAULT_COUNTER_RATIO, seed=seed).with_trial(t).with_sizes(shard_rows=None))
        for mem in memory for t in range(trials)]


def universal_spec(mem: int, like: SketchSpec) -> SketchSpec:
    """All memory to the universal sketch, seeds as given."""
    return sketch_params_from_memory(mem, 0.0, seed=like.seed)


Specs = list[tuple[int, SketchSpec]]
#: From (stream, specs) or the like to the value of each setting, ``(cfg, value)``.
Measure = Callable[[Specs, Sequence[str]], DataFrame]


def run_sweep(spark: SparkSession, specs: Specs, algos: Sequence[str], measure: Measure) -> DataFrame:
    """``measure`` gives one value for each setting, ``(cfg, algo, value)``; the result averages the trials.

    ``cfg`` is the place in ``specs``. Only that number of each setting comes to the driver.
    """
    found = {(r["algo"], r["cfg"]): r["value"] for r in measure(specs, algos).collect()}
    values = [(mem, algo, found.get((algo, cfg))) for cfg, (mem, _) in enumerate(specs) for algo in algos]
    rows = [(mem // 1000, algo, None if v is None else float(v)) for mem, algo, v in values]
    parts = spark.createDataFrame(rows, "mem bigint, algo string, value double")
    return parts.groupBy("mem", "algo").agg(F.avg("value").alias("value"))


ALGORITHMS = (*ROUTES, UNIVERSAL, BASELINE)


def _heavy_by_size(stream: DataFrame, sizes: Iterable[int]) -> dict[int, DataFrame]:
    """Keys of the mergeable summary of each size, as in ``bounded_split``."""
    if "seq" not in stream.columns:
        return {size: materialize(partition_candidates(stream, size)) for size in sizes}
    # The shards' counts are the same whatever the size.
    shard = F.floor(F.col("seq") / F.lit(SHARD_ROWS)).cast("bigint")
    counted = materialize(stream.groupBy(shard.alias("shard"), "key").agg(F.sum("weight").alias("weight")).select(
        "key", (F.col("shard") * F.lit(SHARD_ROWS)).alias("seq"), "weight"))
    return {size: spacesaving_tree(counted, size).select("key") for size in sizes}


def _summaries(stream: DataFrame, counts: DataFrame, specs: Specs, algos: Sequence[str]) -> M.GridSummary:
    """``extract_build`` in ``estimated`` mode for every algorithm and spec; ``cfg`` is algorithm by algorithm."""
    n, first = len(specs), {algo: i * len(specs) for i, algo in enumerate(algos)}
    heavy, residual = [], []
    ordered = [a for a in algos if a in ROUTES and ROUTES[a] != "spacesaving"]
    if ordered:
        folded = materialize(guard_replays(stream, [s for _, s in specs], [ROUTES[a] for a in ordered]))
        cfg = (F.get(F.array(*[F.lit(first[a]) for a in ordered]), F.col("lane")) + F.col("cfg")).alias("cfg")
        heavy.append(folded.filter("kind = 'heavy'").select(cfg, "key", F.col("f").alias("v"), "flag"))
        residual.append(folded.filter("kind = 'pass'").select(cfg, "key", F.col("f").alias("weight")))
    if "S" in algos:
        places: dict[int, list[int]] = {}
        for i, (_, s) in enumerate(specs):
            places.setdefault(max(1, s.heavy_rows), []).append(first["S"] + i)
        for size, found in _heavy_by_size(stream, places).items():
            inside = M.each_setting(counts.join(found, "key", "left_semi"), places[size])
            heavy.append(inside.select("cfg", "key", F.col("f").alias("v"), F.lit(False).alias("flag")))
            outside = M.each_setting(counts.join(found, "key", "left_anti"), places[size])
            residual.append(outside.select("cfg", "key", F.col("f").alias("weight")))
    if UNIVERSAL in algos:
        whole = M.each_setting(counts, range(first[UNIVERSAL], first[UNIVERSAL] + n))
        residual.append(whole.select("cfg", "key", F.col("f").alias("weight")))
        heavy.append(whole.select("cfg", "key", F.col("f").alias("v"), F.lit(False).alias("flag")).limit(0))
    together = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(together(tables[1:]))
    rest = materialize(together(residual).groupBy("cfg", "key").agg(F.sum("weight").alias("weight")))
    grid = M.Grid(tuple(universal_spec(mem, s) if a == UNIVERSAL else s for a in algos for mem, s in specs))
    return M.grid_summary(materialize(together(heavy)), rest, grid)


def _by_algorithm(values: DataFrame, algos: Sequence[str], n: int) -> DataFrame:
    """``(cfg, value)`` of several algorithms' settings as ``(cfg, algo, value)``, each algorithm counting from 0."""
    names = F.array(*[F.lit(a) for a in algos])
    return values.select((F.col("cfg") % n).alias("cfg"), F.get(names, (F.col("cfg") / n).cast("int")).alias("algo"), F.col("value").cast("double"))


def _measured(specs: Specs, algos: Sequence[str], sketched: Callable[[Sequence[str]], DataFrame],
              baseline: Callable[[], DataFrame]) -> DataFrame:
    """The values of the algorithms with a summary, all at once, and those of the baseline."""
    own = [a for a in algos if a != BASELINE]
    parts = [_by_algorithm(sketched(own), own, len(specs))] if own else []
    if BASELINE in algos:
        parts.append(_by_algorithm(baseline(), [BASELINE], len(specs)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _relative_errors(estimates: DataFrame, real: DataFrame) -> DataFrame:
    """``relative_error`` of each setting of ``(cfg, estimate)``."""
    one = real.toDF("real")
    return estimates.toDF("cfg", "est").crossJoin(F.broadcast(one)).select(
        "cfg", (F.abs(F.col("est") - F.col("real")) / F.col("real")).alias("value"))


def _elastic(stream: DataFrame, grid: M.Grid) -> tuple[DataFrame, DataFrame]:
    """The heavy and light tables of the baseline."""
    folded = materialize(elastic_replays(stream, grid.specs, LIGHT_MAX))
    return (folded.filter("kind = 'heavy'").select("cfg", "key", F.col("f").alias("v"), "flag"),
            folded.filter("kind = 'light'").select("cfg", F.col("pos").alias("idx"), F.col("f").alias("v")))


def _tiers(stream: DataFrame, grid: M.Grid) -> M.GridTiers:
    return M.grid_tiers(materialize(tier_replays(stream, grid.specs, HEAVY_THRESHOLD)), grid, HEAVY_THRESHOLD)


def _grid(specs: Specs) -> M.Grid:
    return M.Grid(tuple(s for _, s in specs))


def eval_gsum_job(stream: DataFrame, weight: str, memory: Iterable[int] = DEFAULT_MEMORY, trials: int = 5,
                  algos: Sequence[str] = ALGORITHMS) -> DataFrame:
    """Relative error of ``sum g(f)``. The baseline answers the square sum by its self join."""
    g = WEIGHTS[weight]

    def measure(specs, algos):
        counts = materialize(key_counts(stream))
        real = materialize(gsum_exact(counts, g))

        def baseline():
            grid = _grid(specs)
            if weight == "sqr":
                tiers = _tiers(stream, grid)
                return _relative_errors(M.grid_tier_join(tiers, tiers), real)
            return _relative_errors(M.grid_elastic_gsum(*_elastic(stream, grid), grid, g), real)

        sketched = lambda own: _relative_errors(M.grid_extract_gsum(_summaries(stream, counts, specs, own), g), real)
        return _measured(specs, algos, sketched, baseline)

    return run_sweep(stream.sparkSession, sweep_specs(memory, trials), algos, measure)


def eval_frequency_job(stream: DataFrame, weight: str, memory: Iterable[int] = DEFAULT_MEMORY, trials: int = 5,
                       algos: Sequence[str] = ALGORITHMS) -> DataFrame:
    """Mean error of ``g`` of the point estimates over all keys."""
    g = WEIGHTS[weight]
    errors = lambda estimates: estimates.groupBy("cfg").agg(F.avg(F.abs(g(F.col("est")) - g(F.col("f")))).alias("value"))

    def measure(specs, algos):
        counts = materialize(key_counts(stream))

        def baseline():
            grid = _grid(specs)
            return errors(M.grid_elastic_query(M.all_settings(counts, grid), *_elastic(stream, grid), grid))

        def sketched(own):
            s = _summaries(stream, counts, specs, own)
            return errors(M.grid_query(M.all_settings(counts, s.grid), s))

        return _measured(specs, algos, sketched, baseline)

    return run_sweep(stream.sparkSession, sweep_specs(memory, trials), algos, measure)


def eval_heavy_hitter_job(stream: DataFrame, weight: str, lam: float = DEFAULT_LAMBDA,
                          memory: Iterable[int] = DEFAULT_MEMORY, trials: int = 5,
                          algos: Sequence[str] = ALGORITHMS) -> DataFrame:
    """F1 of the keys reported to hold at least the share ``lam`` of the total weight."""
    g = WEIGHTS[weight]

    def measure(specs, algos):
        counts = materialize(key_counts(stream))
        truth = materialize(heavy_hitters_exact(counts, g, lam))
        # One number for the whole job: the weight threshold the reported keys must reach.
        threshold = float(int(gsum_exact(counts, g).first()["gsum"] * lam))

        def scores(reported, settings):
            """The F1 of ``heavy_hitter_scores`` for each setting."""
            real = truth.select("key").distinct().withColumn("t", F.lit(1))
            found = reported.select("cfg", "key").distinct().join(real, "key", "left").groupBy("cfg").agg(
                F.count(F.lit(1)).alias("reported"), F.count("t").alias("hit"))
            all_of_them = stream.sparkSession.range(settings).select(F.col("id").cast("int").alias("cfg"))
            n = all_of_them.join(found, "cfg", "left").crossJoin(F.broadcast(real.agg(F.count(F.lit(1)).alias("real"))))
            both = F.coalesce("reported", F.lit(0)) + F.col("real")
            return n.select("cfg", F.when(both > 0, F.lit(2.0) * F.coalesce("hit", F.lit(0)) / both).otherwise(F.lit(0.0)).alias("value"))

        def baseline():
            grid = _grid(specs)
            materialize(M.grid_salsa_build(counts, grid))
            folded = materialize(waving_replays(stream, grid.specs))
            slots = folded.filter("kind = 'slot' AND f >= 1").select("cfg", "key", F.col("f").alias("v"))
            return scores(slots.filter(g(F.col("v")) >= threshold), len(specs))

        sketched = lambda own: scores(M.grid_heavy_hitters(_summaries(stream, counts, specs, own), g, threshold), len(own) * len(specs))
        return _measured(specs, algos, sketched, baseline)

    return run_sweep(stream.sparkSession, sweep_specs(memory, trials), algos, measure)


def _three(ab: DataFrame, a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """``value``, SQL text, of the columns ``ab``, ``a`` and ``b``, from three tables ``(cfg, gsum)``."""
    joined = ab.toDF("cfg", "ab").join(a.toDF("cfg", "a"), "cfg", "left").join(b.toDF("cfg", "b"), "cfg", "left")
    return joined.fillna(0.0, ["ab", "a", "b"]).selectExpr("cfg", f"{value} AS value")


#: Exact form, the sum of both streams and its weight, the value from that sum and the sums of each stream, the baseline's part.
SIMILARITIES = {
    "cosine": (cosine_exact, M.grid_gsum_add, g1_sqr, "(ab - a - b) / 2 / sqrt(a) / sqrt(b)", "join"),
    "jaccard": (jaccard_exact, M.grid_gsum_mul, g1_one, "ab / (a + b - ab)", "registers"),
    "inner_product": (inner_product_exact, M.grid_gsum_add, g1_sqr, "(ab - a - b) / 2", "join"),
}


def eval_similarity_job(streams: DataFrame, task: str, memory: Iterable[int] = DEFAULT_MEMORY, trials: int = 5,
                        algos: Sequence[str] = ALGORITHMS) -> DataFrame:
    """Relative error of a similarity of the streams A and B; each gets half the memory."""
    exact, together, g, value, part = SIMILARITIES[task]
    sides = [streams.filter(F.col("stream") == s) for s in ("A", "B")]

    def measure(specs, algos):
        real = materialize(exact(pair_counts(streams)))
        counts = [materialize(key_counts(side)) for side in sides]
        halves = [(mem // 2, spec) for mem, spec in specs]

        def baseline():
            grid = _grid(specs)
            if part == "registers":
                a, b = (materialize(M.grid_registers(c, grid)) for c in counts)
                return _relative_errors(M.grid_maxlog_jaccard(a, b, grid), real)
            a, b = (_tiers(side, grid) for side in sides)
            joined = M.grid_tier_join(a, b)
            if task == "inner_product":
                return _relative_errors(joined, real)
            found = _three(joined, M.grid_tier_squares(a), M.grid_tier_squares(b), "ab / sqrt(a) / sqrt(b)")
            return _relative_errors(found, real)

        def sketched(own):
            a, b = (_summaries(side, c, halves, own) for side, c in zip(sides, counts))
            found = _three(together(a, b, g), M.grid_extract_gsum(a, g), M.grid_extract_gsum(b, g), value)
            return _relative_errors(found, real)

        return _measured(specs, algos, sketched, baseline)

    halves = [(mem, spec) for mem, (_, spec) in zip(
        [m for m in memory for _ in range(trials)], sweep_specs([m // 2 for m in memory], trials))]
    return run_sweep(streams.sparkSession, halves, algos, measure)
