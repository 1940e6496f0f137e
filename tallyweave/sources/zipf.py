"""Skewed synthetic keys: an inverse-CDF draw over ranks 1..n, then a hash of the rank.

Ranks up to ``HEAD`` are found in a table of cumulative weights. Beyond, the cumulative weight has a closed form,
by the Euler-Maclaurin formula exact to double precision, which is inverted by bisection. So what is
shared with the tasks does not grow with the number of keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_value, uniform_from_seed

#: Ranks whose cumulative weights are shared with every task for each skew (8 bytes a rank).
HEAD = 100_000


def cumulative(n_keys: int, alpha: float) -> np.ndarray:
    """Cumulative probabilities of the ranks 1..n, rank r having weight r^-alpha."""
    total = head_weights(n_keys, alpha)
    return total / total[-1]


def head_weights(n: int, alpha: float) -> np.ndarray:
    return np.cumsum(np.arange(1, n + 1, dtype="float64") ** -alpha)


def tail_weight(rank, head: int, alpha: float):
    """Summed weight of the ranks head + 1 .. rank."""
    rank, low = np.asarray(rank, "float64"), float(head)
    area = np.log(rank / low) if alpha == 1 else (rank ** (1 - alpha) - low ** (1 - alpha)) / (1 - alpha)
    ends = (rank ** -alpha - low ** -alpha) / 2
    return area + ends - alpha * (rank ** (-alpha - 1) - low ** (-alpha - 1)) / 12


def ranks(u: np.ndarray, head: np.ndarray, n_keys: int, alpha: float) -> np.ndarray:
    """The first rank whose cumulative share reaches each ``u``."""
    if n_keys <= len(head):
        return np.searchsorted(head / head[-1], u, side="left") + 1
    last = len(head)
    target = u * (head[-1] + tail_weight(n_keys, last, alpha))
    out = np.searchsorted(head, target, side="left") + 1
    beyond = out > last
    missing = target[beyond] - head[-1]
    low, high = np.full(len(missing), last + 1), np.full(len(missing), n_keys)
    while (low < high).any():
        middle = (low + high) // 2
        reached = tail_weight(middle, last, alpha) >= missing
        low, high = np.where(reached, low, np.minimum(middle + 1, high)), np.where(reached, middle, high)
    out[beyond] = low
    return out


def zipf_keys(positions: DataFrame, n_keys: int, alpha: float, seed: int = 42,
              hashed: bool = True) -> DataFrame:
    """One skewed key per row of ``positions(seq)``: ``(seq, rank, key, weight)``.

    The draw depends on ``seq`` alone, so any partitioning gives the same stream.
    """
    return zipf_sweep(positions, n_keys, [alpha], seed, hashed).drop("alpha")


def zipf_stream(spark: SparkSession, n_items: int, n_keys: int, alpha: float, seed: int = 42) -> DataFrame:
    return zipf_keys(spark.range(n_items).select(F.col("id").alias("seq")), n_keys, alpha, seed)


def zipf_sweep(positions: DataFrame, n_keys: int, alphas: Sequence[float], seed: int = 42,
               hashed: bool = True) -> DataFrame:
    """The same positions under several skews, in one scan: ``(alpha, seq, rank, key, weight)``."""
    heads = {float(a): head_weights(min(n_keys, HEAD), a) for a in alphas}
    table = positions.sparkSession.sparkContext.broadcast(heads)
    drawn = positions.select("seq", uniform_from_seed(F.col("seq"), seed).alias("u")).withColumn(
        "alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas))))

    @F.pandas_udf("bigint")
    def rank_of(u, alpha):
        import pandas as pd

        u, alpha = u.to_numpy(), alpha.to_numpy()
        out = np.zeros(len(u), "int64")
        for a, head in table.value.items():
            here = alpha == a
            out[here] = ranks(u[here], head, n_keys, a)
        return pd.Series(out)

    ranked = drawn.select("alpha", "seq", rank_of("u", "alpha").alias("rank"))
    key = hash_value(F.col("rank"), seed, "zipf") if hashed else F.col("rank")
    return ranked.select("alpha", "seq", "rank", key.alias("key"), F.lit(1).cast("bigint").alias("weight"))
