"""Mixing of sources to target weights by hierarchical budgeting.

Weights are given for the nodes of a tree of domain, language and source. A budget of tokens is passed
down from the root: each node's budget is parted among its children in proportion to their weights. A
child gets no more than its capacity, the tokens below it times the epochs allowed; what it leaves is parted
again among its siblings, and only what all of them cannot take is missing one level up, where the
capacity of a node is what its whole subtree can give. All shares are exact whole numbers.

Each leaf then takes its budget as a prefix of seeded epochs: whole passes over its documents, and of one more
epoch, in an order set by a hash of seed, epoch and doc_id, the documents that fit until the budget is met.

Only DataFrame functions are used. A leaf may hold any share of all rows: its documents are summed by bins of
the hash order first, whole bins are taken or left by their sums, and only inside the one bin that the
budget ends in are documents put in order. The number of bins follows the number of rows.

A node of weight 0 (or less) is left out with all below it: it has no capacity and gets no budget.
Null texts have no tokens; documents without tokens are never selected. Null domain, language or source
values are a child of their own, written '~', with the default weight. Repeated rows count and are
taken each, in adjacent places. Other columns are kept; those named like a result are replaced. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize

#: Documents of a leaf that one bin of the hash order holds on average.
BIN_ROWS = 4_000
#: Bins are found by this many leading hex digits of the hash.
BIN_DIGITS = 6
#: Taken documents, with five small values each, that are sent to all executors at most.
BROADCAST_ROWS = 2_000_000
#: Copies of one row that a task writes at once, where repeated rows do not part evenly.
COPIES_AT_ONCE = 1_000


#: The mixture: domains are the sources in blocks of five, the budget is three fifths of all tokens.
MIX_WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 2, "domain2": 2, "domain3": 1}, "language": {"en": 5, "de": 2, "fr": 2, "es": 3},
    "source_name": {},
}
MIX_SHARE = (3, 5)


def mix_levels() -> dict[str, Column]:
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) div 5")
    return {"domain": F.concat(F.lit("domain"), number.cast("string")), "language": F.col("lang"), "source_name": F.col("source")}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def weight_of(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, weight in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def part_budget(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``children`` (parent columns, child, weight, capacity, budget of the parent) with their own share.

    Children are put in order of capacity by weight. The first ones are full as long as their
    capacity is no more than their share of what is left; from the first one that is not, all get shares of
    what is left in proportion to weight, rounded down, the units lost to rounding going one each to the
    first of them.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(child)]
    full = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ahead = full.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(whole(F.col("budget")) - F.coalesce(whole(F.sum("capacity").over(ahead)), whole(F.lit(0))), whole(F.lit(0)))
    weights = whole(F.sum("weight").over(full)) - F.coalesce(whole(F.sum("weight").over(ahead)), whole(F.lit(0)))
    rows = children.withColumn("_left", left).withColumn("_weights", weights)
    rows = rows.withColumn("_full", whole(F.col("capacity") * F.col("_weights")) <= whole(F.col("weight") * F.col("_left")))
    open_ = F.when(~F.col("_full"), 1).otherwise(0)
    rows = rows.withColumn("_open", F.max(open_).over(full.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rows = rows.withColumn("_pool", F.max(F.when(F.col("_open"), F.col("_left"))).over(full))
    rows = rows.withColumn("_total", F.max(F.when(F.col("_open"), F.col("_weights"))).over(full))
    base = F.expr("cast(weight * _pool div _total as decimal(38,0))")
    rows = rows.withColumn("_base", F.when(F.col("_open"), base).otherwise(whole(F.col("capacity"))))
    lost = F.col("_pool") - F.sum(F.when(F.col("_open"), F.col("_base"))).over(full)
    place = F.sum(F.when(F.col("_open"), 1).otherwise(0)).over(full.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_lost", lost).withColumn("_place", place)
    own = F.col("_base") + F.when(F.col("_open") & (F.col("_place") <= F.col("_lost")), 1).otherwise(0)
    return rows.withColumn("own", F.least(own.cast("long"), F.col("capacity"))).select(*children.columns, "own")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: dict[str, dict[str, int]], budget: int | Column, epochs: int, default: int = 1,
) -> DataFrame:
    """``leaves`` (level columns, tokens) with ``budget``. ``weights`` maps a level to its values' weights."""
    nodes, parents = {}, list(levels)
    current = leaves.select(*levels, (F.col("tokens") * epochs).alias("capacity"))
    for depth in range(len(levels), 0, -1):
        weight = weight_of(parents[depth - 1], weights.get(parents[depth - 1], {}), default)
        current = current.withColumn("capacity", F.when(weight > 0, F.col("capacity")).otherwise(F.lit(0).cast("long")))
        nodes[depth] = current
        current = current.groupBy(*parents[: depth - 1]).agg(F.sum("capacity").alias("capacity")) if depth > 1 else current
    down = None
    for depth, level in enumerate(levels, 1):
        parent = parents[: depth - 1]
        own = nodes[depth].withColumn("weight", F.greatest(weight_of(level, weights.get(level, {}), default), F.lit(1).cast("long")))
        own = own.withColumn("budget", budget if isinstance(budget, Column) else F.lit(budget).cast("long")) if not parent else own.join(down, parent)
        down = materialize(part_budget(own, parent, level).select(*parents[:depth], F.col("own").alias("budget")))
    return leaves.join(down, list(levels))


def take_prefixes(docs: DataFrame, budgets: DataFrame, levels: Sequence[str], seed: int, bins: int) -> DataFrame:
    """``docs`` (level columns, doc_id, tokens) with ``copies``: how many epochs take each document.

    ``budgets`` has the level columns, tokens and budget of each leaf.
    """
    keys = list(levels)
    epoch = F.expr("budget div tokens")
    plan = budgets.select(*keys, epoch.alias("passes"), (F.col("budget") - epoch * F.col("tokens")).alias("rest"))
    plan = materialize(plan)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("passes"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.col("check")))))
    placed = docs.join(plan, keys).withColumn("_order", order)
    value = F.conv(F.substring("_order", 1, BIN_DIGITS), 16, 10).cast("long")
    placed = materialize(placed.withColumn("_bin", F.floor(value * bins / 16**BIN_DIGITS).cast("int")))
    sums = placed.groupBy(*keys, "_bin").agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))))
    rows = placed.join(sums, [*keys, "_bin"])
    # a document is taken if the documents ahead of it leave the budget unmet
    inside = rows.where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_sum") > F.col("rest")))
    ahead = Window.partitionBy(*keys, "_bin").orderBy("_order", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_at", F.col("_before") + F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    inside = inside.withColumn("_more", (F.col("_at") < F.col("rest")).cast("long")).drop("_at")
    outside = rows.where(~((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_sum") > F.col("rest"))))
    outside = outside.withColumn("_more", (F.col("_before") < F.col("rest")).cast("long"))
    return outside.union(inside).select(*docs.columns, (F.col("passes") + F.col("_more")).alias("copies"))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: tuple[int, int], *,
    epochs: int = 4, seed: int = 42,
) -> DataFrame:
    """doc_id, the levels, tokens, copies and leaf_budget for every document with tokens.

    ``levels`` names the tree's levels and how a document gets them; the budget is ``share`` (a fraction) of
    all tokens. Copies may be 0; their tokens meet each leaf's budget, passing it by less than a document.
    """
    named = [F.coalesce(c.cast("string"), F.lit("~")).alias(k) for k, c in levels.items()]
    check = F.xxhash64("text").alias("check")
    rows = materialize(docs.select("doc_id", check, word_count(F.col("text")).alias("tokens"), *named).where("tokens > 0").withColumn(
        "_row", F.monotonically_increasing_id()))
    keys = list(levels)
    leaves = materialize(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("_n")))
    totals = leaves.agg(F.sum("tokens").alias("t"), F.max("_n").alias("n")).first()
    bins = max(1, -(-(totals.n or 0) // BIN_ROWS))
    budgets = leaf_budgets(leaves.drop("_n"), keys, weights, (totals.t or 0) * share[0] // share[1], epochs)
    budgets = materialize(budgets)
    taken = take_prefixes(rows, budgets, keys, seed, min(bins, 16**BIN_DIGITS))
    return taken.join(budgets.select(*keys, F.col("budget").alias("leaf_budget")), keys).select(
        "doc_id", "check", *keys, "tokens", "copies", "leaf_budget")


def mixed_documents(docs: DataFrame, levels: dict[str, Column], *args, **options) -> DataFrame:
    """``docs`` as the mixture takes them: each row as many times as it has copies.

    Repeated rows, equal in doc_id, text and levels, have the same copies each; what does not part evenly among
    them comes from one of them. What each text gets is settled on hashes; texts stay where they
    are while the (doc_id, hash, levels) that are taken can be broadcast.
    """
    keys = list(levels)
    taken = materialize(mix(docs, levels, *args, **options).groupBy("doc_id", "check", *keys).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0"))
    few = taken.count() <= BROADCAST_ROWS
    named = docs.select(
        F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("_check"),
        *[F.coalesce(c.cast("string"), F.lit("~")).alias(f"_{k}") for k, c in levels.items()])

    def met(part: DataFrame) -> DataFrame:
        match = F.col("doc.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("_check") == F.col("t.check"))
        for k in keys:
            match = match & (F.col(f"_{k}") == F.col(f"t.{k}"))
        return named.join((F.broadcast(part) if few else part).alias("t"), match)

    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    whole_share = met(taken.where("copies >= rows")).select("doc", times(F.expr("t.copies div t.rows"))).select("doc.*")
    uneven = taken.where("copies % rows != 0")
    if not uneven.limit(1).count():
        return whole_share
    one = met(uneven).groupBy("t.doc_id", "t.check", *[f"t.{k}" for k in keys], "t.copies", "t.rows").agg(F.first("doc").alias("doc"))
    blocks = one.select("doc", F.expr("copies % rows").alias("rest")).select(
        "doc", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(rest - 1) div %d" % COPIES_AT_ONCE))).alias("block"))
    dealt = blocks.repartition(F.xxhash64("block", "doc.doc_id"))  # the copies of one text over several tasks
    ahead = F.col("block") * COPIES_AT_ONCE
    rest = dealt.select("doc", times(F.least(F.lit(COPIES_AT_ONCE).cast("long"), F.col("rest") - ahead))).select("doc.*")
    return whole_share.union(rest)
