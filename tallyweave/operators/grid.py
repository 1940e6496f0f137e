"""The operators of summaries for many settings at once: the setting is a column, ``cfg``, of every table.

A ``Grid`` lists one spec for each value of ``cfg``. Seeds and sizes may differ, rows and levels may not. What an operator
does for one spec (its name stands in each text below) is done here for all in one plan, so that the number of jobs does not grow with the settings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.hashing import (
    LANES, PRIME, cell_text, coefficients_at, depth_text, hash_fn, sign_text, with_hashes, with_lanes,
)
from tallyweave.functions.medians import median_of_columns, median_of_group
from tallyweave.operators import joinsketch, salsa
from tallyweave.operators.exact import cut_before_shuffle, top_per_group
from tallyweave.operators.linear import BROADCAST_CELLS, is_text, row_list
from tallyweave.operators.twostream import UNIQUE_SHARE, maxlog_level
from tallyweave.sources.scratch import materialize
from tallyweave.spec import SketchSpec

G = Callable[[Column], Column]
CELL = ("cfg", "level", "row", "idx")


@dataclass(frozen=True)
class Grid:
    specs: tuple[SketchSpec, ...]

    def __post_init__(self):
        if len({(s.rows, s.levels) for s in self.specs}) > 1:
            raise ValueError("the specs of a grid have the same rows and levels")

    @property
    def rows(self) -> int:
        return self.specs[0].rows

    @property
    def levels(self) -> int:
        return self.specs[0].levels

    def size(self, name: str) -> str:
        """SQL text: a size of the spec of each row."""
        return choice([getattr(s, name) for s in self.specs])

    def hashes(self, role: str, levels: int = 0, rows: int = 0, position: str = "0") -> list[str]:
        """Coefficients by seed, level and row; ``position`` is the place of the level and row in a seed's list."""
        seeds = list(dict.fromkeys(s.seed for s in self.specs))
        fns = [hash_fn(seed, role, level, row) for seed in seeds for level in range(levels or 1) for row in range(rows or 1)]
        each = (levels or 1) * (rows or 1)
        return coefficients_at(fns, f"{choice([seeds.index(s.seed) * each for s in self.specs])} + {position}")


def choice(values: Sequence[int]) -> str:
    return f"get(array({','.join(f'{v}L' for v in values)}), cfg)" if len(set(values)) > 1 else f"{values[0]}L"


def each_setting(df: DataFrame, cfgs: Sequence[int]) -> DataFrame:
    """A copy of every row for each of ``cfgs``."""
    return df.selectExpr(f"explode(array({','.join(map(str, cfgs))})) AS cfg", "*")


def all_settings(df: DataFrame, grid: Grid) -> DataFrame:
    return each_setting(df, range(len(grid.specs)))


def _depths(df: DataFrame, grid: Grid) -> DataFrame:
    hashed = with_hashes(with_lanes(df, is_text(df)), {"_d": grid.hashes("depth")})
    return hashed.selectExpr(*[f"`{c}`" for c in df.columns], *LANES, f"{depth_text('_d', grid.levels)} AS _depth")


def _sampled(df: DataFrame, grid: Grid) -> DataFrame:
    return _depths(df, grid).selectExpr("*", "explode(sequence(0, _depth)) AS level").drop("_depth")


def _spread(df: DataFrame, grid: Grid, role: str, levels: int = 0) -> DataFrame:
    """Lanes to ``row``, hash ``h`` and cell ``idx``, one output row for each sketch row."""
    position = f"level * {grid.rows} + row" if levels else "row"
    rows = with_hashes(df.selectExpr("*", row_list(grid)), {"h": grid.hashes(role, levels, grid.rows, position)})
    return rows.selectExpr("*", f"{cell_text('h', grid.size('width'))} AS idx")


# --- universal sketch -------------------------------------------------------------------

def grid_build(residual: DataFrame, grid: Grid) -> DataFrame:
    """``universal_build`` of ``(cfg, key, weight)``: ``(cfg, level, row, idx, v)``."""
    spread = _spread(_sampled(residual.select("cfg", "key", "weight"), grid), grid, "univ", grid.levels)
    return spread.selectExpr(*CELL, f"{sign_text('h')} * weight AS v").groupBy(*CELL).agg(F.sum("v").alias("v")).filter("v != 0")


def _dense(counters: DataFrame, grid: Grid, levels: int) -> DataFrame:
    """All cells of a setting and level as one array, where any is not zero."""
    sizes = [grid.rows * s.width for s in grid.specs]

    def fill(table: pa.Table) -> pa.Table:
        cfg, level = table["cfg"][0].as_py(), table["level"][0].as_py()
        cells = np.zeros(sizes[cfg], np.int64)
        cells[table["_cell"].to_numpy()] = table["v"].to_numpy()
        return pa.table({"cfg": pa.array([cfg], pa.int32()), "level": pa.array([level], pa.int32()),
                         "cells": pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), pa.array(cells))})

    cells = counters.filter(F.col("level") < levels).selectExpr("cfg", "level", f"row * {grid.size('width')} + idx AS _cell", "v")
    return cells.groupBy("cfg", "level").applyInArrow(fill, "cfg int, level int, cells array<bigint>")


def grid_estimates(pairs: DataFrame, counters: DataFrame, grid: Grid, levels: int | None = None) -> DataFrame:
    """``universal_estimates``: adds ``est`` to ``(cfg, level, key, ...)``.

    All cells are broadcast as one array up to ``BROADCAST_CELLS``; beyond, each setting and level is an array of its own to join.
    """
    levels = levels or grid.levels
    keyed = with_lanes(pairs, is_text(pairs))
    if levels * grid.rows * sum(s.width for s in grid.specs) > BROADCAST_CELLS:
        return _estimates_by_join(keyed, counters, grid, levels).select(*pairs.columns, "est")
    types = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return keyed.mapInArrow(_asker(counters, grid, levels, pairs.columns), f"{types}, est double")


def _asker(counters: DataFrame, grid: Grid, levels: int, columns: Sequence[str]):
    """Batches of ``columns`` and lanes to the same columns and ``est``."""
    rows, seeds = grid.rows, list(dict.fromkeys(s.seed for s in grid.specs))
    widths = np.array([s.width for s in grid.specs])
    starts = np.r_[0, np.cumsum(levels * rows * widths)]
    seed_of = np.array([seeds.index(s.seed) for s in grid.specs])
    coef = np.array([[[hash_fn(seed, "univ", level, row).coefficients() for level in range(levels)] for seed in seeds] for row in range(rows)])
    coef = coef.reshape(rows, len(seeds) * levels, -1).transpose(0, 2, 1).copy()
    cells = np.zeros(starts[-1], np.int64)
    found = counters.filter(F.col("level") < levels).select(*CELL, "v").toArrow()
    cfg, level, row, idx, v = (c.to_numpy() for c in found.columns)
    cells[starts[cfg] + (level * rows + row) * widths[cfg] + idx] = v
    shared = counters.sparkSession.sparkContext.broadcast(cells)

    def ask(batches):
        cells = shared.value
        for batch in batches:
            cfg, level, *lanes = (batch.column(c).to_numpy() for c in ("cfg", "level", *LANES))
            place, width = seed_of[cfg] * levels + level, widths[cfg]
            first, values = starts[cfg] + level * rows * width, np.empty((len(cfg), rows), np.int64)
            for row in range(rows):
                c = coef[row][:, place]
                x = (lanes[0] * c[0] + lanes[1] * c[1] + lanes[2] * c[2] + c[3]) % PRIME
                h = (((x * c[7] + c[6]) % PRIME * x + c[5]) % PRIME * x + c[4]) % PRIME
                values[:, row] = (1 - 2 * (h & 1)) * cells[first + row * width + (h >> 1) % width]
            values.sort(axis=1)
            est = (values[:, (rows - 1) // 2] + values[:, rows // 2]) / 2.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(est)], names=[*columns, "est"])

    return ask


def _estimates_by_join(keyed: DataFrame, counters: DataFrame, grid: Grid, levels: int) -> DataFrame:
    rows, width = grid.rows, grid.size("width")
    hashed = with_hashes(keyed, {
        f"_h{row}": grid.hashes("univ", levels, rows, f"level * {rows} + {row}") for row in range(rows)})
    values = [F.expr(f"{sign_text(f'_h{row}')} * coalesce(get(cells, int({cell_text(f'_h{row}', width)} + {row} * {width})), 0L)") for row in range(rows)]
    joined = hashed.join(_dense(counters, grid, levels), ["cfg", "level"], "left")
    return joined.withColumn("est", median_of_columns(values))


def grid_candidates(residual: DataFrame, counters: DataFrame, grid: Grid) -> DataFrame:
    """``universal_candidates`` in ``estimated`` mode of the keys ``(cfg, key)``: ``(cfg, level, key, v)``."""
    pairs = _sampled(residual.select("cfg", "key"), grid).select("cfg", "level", "key")
    sampled = materialize(grid_estimates(pairs, counters, grid).select(
        "cfg", "level", "key", F.greatest(F.lit(1), F.floor("est")).cast("bigint").alias("v")))
    # Values below the last one that can be listed are dropped before anything is sorted.
    capacity = grid.size("capacity")
    larger = Window.partitionBy("cfg", "level").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sampled.groupBy("cfg", "level", "v").agg(F.count(F.lit(1)).alias("_n"))
    reached = sizes.withColumn("_larger", F.coalesce(F.sum("_n").over(larger), F.lit(0))).filter(f"_larger < {capacity}")
    cutoffs = reached.groupBy("cfg", "level").agg(F.min("v").alias("_cut"))
    most = max(s.capacity for s in grid.specs)
    cut_before_shuffle(sampled.sparkSession, most)
    place = F.row_number().over(Window.partitionBy("cfg", "level").orderBy(F.desc("v"), "key"))
    ranked = sampled.join(F.broadcast(cutoffs), ["cfg", "level"]).filter("v >= _cut").withColumn("rank", place)
    return ranked.filter(F.col("rank") <= most).filter(f"rank <= {capacity}").select("cfg", "level", "key", "v")


def grid_gsum(candidates: DataFrame, grid: Grid, g: G) -> DataFrame:
    """``universal_gsum``: ``(cfg, gsum)``."""
    weight = f"pow(2.0D, level) * CASE WHEN level < {grid.levels - 1} AND _depth > level THEN -1 ELSE 1 END"
    sizes = _depths(candidates, grid).groupBy("cfg", "v").agg(F.sum(F.expr(weight)).alias("_w"))
    return sizes.groupBy("cfg").agg(F.sum(g(F.col("v")) * F.col("_w")).alias("gsum"))


# --- combined estimator -----------------------------------------------------------------

@dataclass(frozen=True)
class GridSummary:
    """``Summary`` of every setting: ``heavy(cfg, key, v, flag)``, ``counters`` and ``candidates``."""

    heavy: DataFrame
    counters: DataFrame
    candidates: DataFrame
    grid: Grid


def grid_summary(heavy: DataFrame, residual: DataFrame, grid: Grid) -> GridSummary:
    """Each table is written once; ``residual`` is one row ``(cfg, key, weight)`` for each key."""
    counters = materialize(grid_build(residual, grid))
    return GridSummary(heavy, counters, materialize(grid_candidates(residual, counters, grid)), grid)


def grid_query(keys: DataFrame, s: GridSummary) -> DataFrame:
    """``extract_query``: adds ``est`` to ``(cfg, key, ...)``."""
    light = grid_estimates(keys.withColumn("level", F.lit(0)), s.counters, s.grid, levels=1).withColumn("est", F.greatest(F.lit(0.0), "est"))
    known = s.heavy.select("cfg", "key", F.col("v").alias("_heavy"), F.col("flag").alias("_flag"))
    rest = F.when(F.col("_heavy").isNull() | F.col("_flag"), F.col("est")).otherwise(F.lit(0.0))
    return light.join(known, ["cfg", "key"], "left").select(*keys.columns, (F.coalesce("_heavy", F.lit(0)) + rest).alias("est"))


def _without(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    return candidates.join(keys.select("cfg", "key"), ["cfg", "key"], "left_anti")


def _sums(*parts: DataFrame) -> DataFrame:
    """One sum a setting of several tables ``(cfg, gsum)``."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("cfg").agg(F.sum("gsum").alias("gsum"))


def _sum_g(values: DataFrame, g: G) -> DataFrame:
    return values.groupBy("cfg").agg(F.sum(g(F.col("est"))).alias("gsum"))


def grid_extract_gsum(s: GridSummary, g: G) -> DataFrame:
    """``extract_gsum``: ``(cfg, gsum)``."""
    known = s.heavy.select("cfg", "key", "v", "flag", F.lit(0).alias("level"))
    flagged = grid_estimates(known.filter("flag"), s.counters, s.grid, levels=1).select(
        "cfg", (F.col("v") + F.greatest(F.lit(0.0), F.col("est"))).alias("est"))
    upper = _sum_g(flagged.unionByName(known.filter("NOT flag").select("cfg", F.col("v").cast("double").alias("est"))), g)
    return _sums(upper, grid_gsum(_without(s.candidates, s.heavy), s.grid, g))


def grid_heavy_hitters(s: GridSummary, g: G, threshold: float) -> DataFrame:
    """``extract_g_heavy_hitters``: ``(cfg, key, v)``."""
    sketched = s.candidates.groupBy("cfg", "key").agg(F.max("v").alias("v")).filter("v >= 1")
    both = s.heavy.select("cfg", "key", "v").unionByName(sketched).groupBy("cfg", "key").agg(F.sum("v").alias("v"))
    return both.filter("v >= 1").filter(g(F.col("v")) >= threshold)


def _either_heavy(a: GridSummary, b: GridSummary) -> DataFrame:
    keys = a.heavy.select("cfg", "key").union(b.heavy.select("cfg", "key")).distinct()
    return grid_query(grid_query(keys, a).withColumnRenamed("est", "est_a"), b).withColumnRenamed("est", "est_b")


def grid_gsum_add(a: GridSummary, b: GridSummary, g: G) -> DataFrame:
    """``extract_gsum_add``."""
    both = materialize(_either_heavy(a, b))
    upper = _sum_g(both.withColumn("est", F.col("est_a") + F.col("est_b")), g)
    pairs = a.candidates.select("cfg", "level", "key").union(b.candidates.select("cfg", "level", "key")).distinct()
    merged = a.counters.unionByName(b.counters).groupBy(*CELL).agg(F.sum("v").alias("v"))
    values = grid_estimates(_without(pairs, both), merged, a.grid).withColumnRenamed("est", "v")
    return _sums(upper, grid_gsum(values, a.grid, g))


def grid_gsum_mul(a: GridSummary, b: GridSummary, g: G) -> DataFrame:
    """``extract_gsum_mul``."""
    both = materialize(_either_heavy(a, b))
    upper = _sum_g(both.withColumn("est", F.col("est_a") * F.col("est_b")), g)
    other = b.candidates.select("cfg", "level", "key", F.col("v").alias("v2"))
    products = a.candidates.join(other, ["cfg", "level", "key"]).select(
        "cfg", "level", "key", (F.col("v").cast("double") * F.col("v2")).alias("v")).filter("v > 0")
    return _sums(upper, grid_gsum(_without(products, both), a.grid, g))


# --- comparison sketches ----------------------------------------------------------------

def _with_light(keys: DataFrame, light: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``_light``, the value of a key's light cell."""
    hashed = with_hashes(with_lanes(keys, is_text(keys)), {"_h": grid.hashes("light")})
    cells = light.select("cfg", F.col("idx").alias("_idx"), F.col("v").alias("_light"))
    small = F.broadcast(cells) if sum(s.width for s in grid.specs) <= 4_000_000 else cells
    found = hashed.selectExpr(*keys.columns, f"{cell_text('_h', grid.size('width'))} AS _idx").join(small, ["cfg", "_idx"], "left")
    return found.select(*keys.columns, F.coalesce("_light", F.lit(0)).alias("_light"))


def grid_elastic_query(keys: DataFrame, heavy: DataFrame, light: DataFrame, grid: Grid) -> DataFrame:
    """``elastic_query``: adds ``est`` to ``(cfg, key, ...)``."""
    known = heavy.select("cfg", "key", F.col("v").alias("_heavy"), F.col("flag").alias("_flag"))
    joined = _with_light(keys, light, grid).join(known, ["cfg", "key"], "left")
    rest = F.when(F.col("_heavy").isNull() | F.col("_flag"), F.col("_light")).otherwise(F.lit(0))
    return joined.select(*keys.columns, (F.coalesce("_heavy", F.lit(0)) + rest).alias("est"))


def grid_elastic_gsum(heavy: DataFrame, light: DataFrame, grid: Grid, g: G) -> DataFrame:
    """``elastic_gsum``: ``(cfg, gsum)``."""
    extra = F.when(F.col("flag"), F.col("_light")).otherwise(F.lit(0))
    upper = _with_light(heavy.select("cfg", "key", "v", "flag"), light, grid).select(
        "cfg", (g(F.col("v") + extra) - F.when(extra > 0, g(extra)).otherwise(F.lit(0.0))).alias("gsum"))
    lower = light.groupBy("cfg", "v").agg(F.count(F.lit(1)).alias("n")).select("cfg", (F.col("n") * g(F.col("v"))).alias("gsum"))
    return _sums(upper, lower)


def grid_salsa_build(counts: DataFrame, grid: Grid) -> DataFrame:
    """``salsa_build`` of the key counts ``(key, f)`` for every setting."""
    spread = _spread(with_lanes(all_settings(counts.selectExpr("key", "f AS weight"), grid), is_text(counts)), grid, salsa.ROLE)
    cells = spread.groupBy("cfg", "row", "idx").agg(F.sum("weight").alias("v")).filter("v != 0")
    return salsa.salsa_blocks(cells, F.expr(grid.size("width")), by=["cfg"])


@dataclass(frozen=True)
class GridTiers:
    """``Tiers`` of every setting: ``heavy`` and ``middle`` ``(cfg, key, v)``, ``light(cfg, row, idx, v)``."""

    heavy: DataFrame
    middle: DataFrame
    light: DataFrame
    grid: Grid


def grid_tiers(folded: DataFrame, grid: Grid, threshold: int) -> GridTiers:
    """``tiers_of_fold`` of ``tier_replays``."""
    held = materialize(folded.filter("kind <> 'pass'").groupBy("cfg", "key").agg(
        F.max("bucket").alias("bucket"), F.sum("f").alias("v"), F.max(F.col("kind") == "heavy").alias("up")))
    up = F.col("up") | (F.col("v") >= threshold)
    below = held.filter(~up)
    middle = materialize(top_per_group(
        below, ["cfg", "bucket"], [F.desc("v"), F.col("key")], joinsketch.MIDDLE_SLOTS, ["key"]).select("cfg", "key", "v"))
    rest = below.join(middle.select("cfg", "key"), ["cfg", "key"], "left_anti").select("cfg", "key", F.col("v").alias("weight"))
    gone = folded.filter("kind = 'pass'").select("cfg", "key", F.col("f").alias("weight")).unionByName(rest)
    spread = _spread(with_lanes(gone, is_text(gone)), grid, joinsketch.ROLE)
    light = spread.selectExpr("cfg", "row", "idx", f"{sign_text('h')} * weight AS v").groupBy("cfg", "row", "idx").agg(
        F.sum("v").alias("v")).filter("v != 0")
    return GridTiers(materialize(held.filter(up).select("cfg", "key", "v")), middle, materialize(light), grid)


def _light_values(keys: DataFrame, t: GridTiers) -> DataFrame:
    """``count_sketch_query`` at the light tier: adds ``est`` to ``(cfg, key, v)``, one row a key."""
    probe = _spread(with_lanes(keys, is_text(keys)), t.grid, joinsketch.ROLE)
    seen = probe.join(t.light.select("cfg", "row", "idx", F.col("v").alias("_v")), ["cfg", "row", "idx"], "left")
    value = F.expr(f"{sign_text('h')} * coalesce(_v, 0)")
    return seen.groupBy("cfg", "key", "v").agg(median_of_group(value).alias("est"))


def _tier_product(keys: DataFrame, t: GridTiers, *tiers: str) -> DataFrame:
    """``sum v * estimate`` of ``(cfg, key, v)``, the estimate from the light tier and the named ones."""
    found, est = _light_values(keys, t), F.col("est")
    for name in tiers:
        found = found.join(getattr(t, name).select("cfg", "key", F.col("v").alias(f"_{name}")), ["cfg", "key"], "left")
        est = est + F.coalesce(f"_{name}", F.lit(0))
    return found.groupBy("cfg").agg(F.sum(F.col("v").cast("double") * est).alias("gsum"))


def _row_median(products: DataFrame, grid: Grid) -> DataFrame:
    """Sums of ``(cfg, row, p)`` and their median over all rows of a setting."""
    zeros = products.sparkSession.range(len(grid.specs) * grid.rows).selectExpr(
        f"int(id div {grid.rows}) AS cfg", f"int(id % {grid.rows}) AS row", "0.0D AS p")
    sums = products.unionByName(zeros).groupBy("cfg", "row").agg(F.sum("p").alias("p"))
    return sums.groupBy("cfg").agg(median_of_group(F.col("p")).alias("gsum"))


def grid_tier_join(a: GridTiers, b: GridTiers) -> DataFrame:
    """``three_tier_join``: ``(cfg, gsum)``."""
    common = a.light.join(b.light.select("cfg", "row", "idx", F.col("v").alias("v2")), ["cfg", "row", "idx"])
    light = _row_median(common.select("cfg", "row", (F.col("v").cast("double") * F.col("v2")).alias("p")), a.grid)
    return _sums(
        light, _tier_product(a.heavy, b, "heavy", "middle"), _tier_product(b.heavy, a, "middle"),
        _tier_product(a.middle, b, "middle"), _tier_product(b.middle, a))


def grid_tier_squares(t: GridTiers) -> DataFrame:
    """``three_tier_gsum`` of the squares."""
    square = F.col("v").cast("double") * F.col("v")
    held = t.heavy.select("cfg", "v").unionByName(t.middle.select("cfg", "v")).groupBy("cfg").agg(F.sum(square).alias("gsum"))
    return _sums(held, _row_median(t.light.select("cfg", "row", square.alias("p")), t.grid))


def grid_registers(counts: DataFrame, grid: Grid) -> DataFrame:
    """``maxlog_build`` of the keys of ``counts`` for every setting: ``(cfg, bucket, lvl, unique)``."""
    keys = all_settings(counts.select("key"), grid)
    hashed = with_hashes(with_lanes(keys, is_text(keys)), {"_m": grid.hashes("maxlog"), "_r": grid.hashes("register")})
    levels = hashed.select("cfg", F.expr(cell_text("_r", grid.size("width"))).alias("bucket"), maxlog_level(F.col("_m")).alias("lvl"), "key")
    top = levels.groupBy("cfg", "bucket").agg(
        F.max(F.struct("lvl", "key")).alias("hi"), F.min(F.struct((-F.col("lvl")).alias("neg"), "key")).alias("lo"))
    return top.select("cfg", "bucket", F.col("hi.lvl").alias("lvl"), (F.col("hi.key") == F.col("lo.key")).alias("unique"))


def grid_maxlog_jaccard(a: DataFrame, b: DataFrame, grid: Grid) -> DataFrame:
    """``maxlog_jaccard``: ``(cfg, jaccard)``."""
    other = b.select("cfg", "bucket", F.col("lvl").alias("lvl2"), F.col("unique").alias("unique2"))
    zero, no = (lambda c: F.coalesce(c, F.lit(0))), (lambda c: F.coalesce(c, F.lit(False)))
    larger = (zero("lvl") > zero("lvl2")) & no("unique") | (zero("lvl") < zero("lvl2")) & no("unique2")
    found = a.join(other, ["cfg", "bucket"], "full_outer").groupBy("cfg").agg(F.sum(larger.cast("int")).alias("n"))
    return found.select("cfg", (F.lit(1.0) - F.col("n") / (F.expr(grid.size("width")) * F.lit(UNIQUE_SHARE))).alias("jaccard"))
