"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) that has an edge to another: the smallest node in reach.

    Every node points to the first of its neighbours and itself, edges are redrawn between what their ends point
    to, and so on until none is left; then the pointers are followed back. Rounds take turns in what
    is first: the smallest node, which folds stars at once, or the smallest hash, which halves chains whatever
    their numbering, so few rounds are needed and edges shrink from one to the next. Firsts are minima,
    combined before each shuffle, and every round is written, so a node with very many neighbours is neither
    gathered nor recomputed.
    """
    rest = materialize(edges.where("a != b").select("a", "b").distinct())
    rounds = []
    while not rounds or rest.limit(1).count():
        turn = len(rounds)

        def rank(node: str):
            return F.struct((F.xxhash64(node, F.lit(turn)) if turn % 2 else F.lit(0).cast("long")).alias("rank"), F.col(node).alias("up"))

        both = rest.union(rest.select("b", "a"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
        up = materialize(first.select("node", F.least(rank("node"), F.col("near"))["up"].alias("up")))
        rounds.append(up)
        a, b = (up.select(F.col("node").alias(k), F.col("up").alias(f"{k}_up")) for k in "ab")
        moved = rest.join(a, "a").join(b, "b").where("a_up != b_up")
        rest = materialize(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
    roots = rounds.pop().select("node", F.col("up").alias("root"))
    while rounds:
        later = roots.select(F.col("node").alias("up"), "root")
        roots = materialize(rounds.pop().join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    least = materialize(roots.groupBy("root").agg(F.min("node").alias("label")))
    return roots.join(least, "root").select("node", "label")
