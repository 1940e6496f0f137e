"""Comparison bundle: each question goes to the sketch made for it.

With an elastic share of memory, elastic answers sums, point queries and heavy hitters.
Without, salsa answers cardinality and point queries, waving other sums and heavy hitters.
Similarity always goes to the three-tier join sketch and the one-permutation registers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyweave.functions.weights import WEIGHTS
from tallyweave.operators import elastic, joinsketch, salsa, waving
from tallyweave.operators.twostream import maxlog_build, maxlog_jaccard
from tallyweave.sources.scratch import materialize
from tallyweave.spec import SketchSpec


@dataclass(frozen=True)
class Bundle:
    spec: SketchSpec
    tables: dict[str, DataFrame]
    uses_elastic: bool


def bundle_build(stream: DataFrame, spec: SketchSpec, use_elastic: bool = True,
                 parts: tuple[str, ...] = ("point", "join", "registers"), light_limit: int | None = elastic.LIGHT_MAX,
                 heavy_threshold: int = joinsketch.HEAVY_THRESHOLD) -> Bundle:
    """Build the parts a caller is going to ask: ``point`` answers, ``join`` and ``registers``.

    ``light_limit`` is the largest value of a light cell of the elastic part, one byte as in the
    comparisons this bundle is for; None keeps whole sums. From ``heavy_threshold`` on the join part counts a key as heavy.
    """
    t: dict[str, DataFrame] = {}
    if "point" in parts and use_elastic:
        folded = materialize(elastic.elastic_fold(stream, spec))
        heavy, light = elastic.elastic_tables(folded, spec, limit=light_limit)
        t["elastic_heavy"], t["elastic_light"] = materialize(heavy), materialize(light)
    elif "point" in parts:
        t["salsa"] = materialize(salsa.salsa_build(stream, spec))
        folded = materialize(waving.waving_build(stream, spec))
        t["slots"], t["casts"] = (materialize(part) for part in waving.waving_tables(folded, spec))
    if "join" in parts:
        tiers = joinsketch.tiers_of_fold(materialize(joinsketch.three_tier_fold(stream, spec, heavy_threshold)), spec, heavy_threshold)
        t["heavy"], t["middle"], t["light"] = tiers.heavy, tiers.middle, tiers.light
    if "registers" in parts:
        t["registers"] = materialize(maxlog_build(stream, spec))
    return Bundle(spec, t, use_elastic)


def _tiers(b: Bundle) -> joinsketch.Tiers:
    return joinsketch.Tiers(b.tables["heavy"], b.tables["middle"], b.tables["light"], b.spec)


def bundle_query(keys: DataFrame, b: Bundle) -> DataFrame:
    if b.uses_elastic:
        return elastic.elastic_query(keys, b.tables["elastic_heavy"], b.tables["elastic_light"], b.spec)
    return salsa.salsa_query(keys, b.tables["salsa"], b.spec)


def bundle_gsum(b: Bundle, weight: str) -> DataFrame:
    """``weight`` is one of the named weight functions."""
    g = WEIGHTS[weight]
    if b.uses_elastic:
        return elastic.elastic_gsum(b.tables["elastic_heavy"], b.tables["elastic_light"], b.spec, g)
    if weight == "cardinality":
        return salsa.salsa_cardinality(b.tables["salsa"], b.spec).withColumnRenamed("cardinality", "gsum")
    return waving.waving_gsum(b.tables["slots"], g)


def bundle_heavy_hitters(b: Bundle, threshold: int) -> DataFrame:
    if b.uses_elastic:
        return elastic.elastic_heavy_hitters(
            b.tables["elastic_heavy"], b.tables["elastic_light"], b.spec, threshold).withColumnRenamed("est", "v")
    return waving.waving_heavy_hitters(b.tables["slots"], threshold)


def bundle_cosine(a: Bundle, b: Bundle) -> DataFrame:
    return joinsketch.baseline_cosine(_tiers(a), _tiers(b))


def bundle_inner_product(a: Bundle, b: Bundle) -> DataFrame:
    return joinsketch.baseline_inner_product(_tiers(a), _tiers(b))


def bundle_jaccard(a: Bundle, b: Bundle) -> DataFrame:
    return maxlog_jaccard(a.tables["registers"], b.tables["registers"], a.spec)
