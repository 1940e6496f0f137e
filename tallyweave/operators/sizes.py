"""Distribution of key frequencies from counter values, by expectation maximization.

A counter of value ``v`` may be one key of size v or several adding up to it. Each round
weighs all splits of every distinct counter value under the current distribution and shares the
counters among the sizes. Only distinct values matter: their histogram has at most one row per
counter of the sketch, whatever the stream.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize


def max_parts(value: int) -> int:
    """Most keys tried for one counter. 2 above 600, 3 above 300, 4 above 50, else 6."""
    return 2 if value > 600 else 3 if value > 300 else 4 if value > 50 else 6


def splits(value: int, sizes: list[int], known: set[int], parts: int, least: int = 1):
    """Non-decreasing ways to write ``value`` with at most ``parts`` of the known sizes."""
    if value in known and value >= least:
        yield (value,)
    if parts > 1:
        for first in sizes:
            if first < least:
                continue
            if 2 * first > value:
                break
            for rest in splits(value - first, sizes, known, parts - 1, first):
                yield (first, *rest)


def log_weight(split: tuple[int, ...], log_rate: dict[int, float]) -> float:
    """Log-probability of a split, up to a constant, when keys of size s fall in a counter at a Poisson rate."""
    return sum(times * log_rate[size] - math.lgamma(times + 1) for size, times in Counter(split).items())


def counter_histogram(counters: DataFrame) -> DataFrame:
    """How many counters have each value: ``(v, n)``."""
    return counters.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def flow_size_distribution_em(histogram: DataFrame, width: int, rounds: int = 3, parts: int | None = None) -> DataFrame:
    """Estimated number of keys of each size: ``(size, n)``.

    A size without weight never gains any, so the support stays within the distinct counter
    values and the table shared with the tasks is bounded by ``width``. ``parts`` is the most keys tried for
    one counter; by default it falls with the counter's value, as ``max_parts`` says. Weights are logarithms
    relative to the likeliest split, so that no load of the counters makes them vanish.
    """
    spark = histogram.sparkSession
    # Every round reads the histogram, so it is written once; its rows are spread by value
    # because large values have many more splits.
    histogram = materialize(histogram)
    current = histogram.select(F.col("v").alias("size"), F.col("n").cast("double").alias("n"))
    values = histogram.repartition(spark.sparkContext.defaultParallelism, "v")
    for _ in range(rounds):
        estimate = {row["size"]: row["n"] for row in current.collect() if row["n"] > 0}
        shared = spark.sparkContext.broadcast({s: n / width for s, n in estimate.items()})

        def share(batches, shared=shared):
            import pandas as pd

            log_rate = {size: math.log(rate) for size, rate in shared.value.items()}
            known, sizes = set(log_rate), sorted(log_rate)
            for batch in batches:
                gained: dict[int, float] = {}
                for v, n in zip(batch["v"].tolist(), batch["n"].tolist()):
                    ways = [(s, log_weight(s, log_rate)) for s in splits(v, sizes, known, parts or max_parts(v))]
                    top = max((w for _, w in ways), default=0.0)
                    ways = [(s, math.exp(w - top)) for s, w in ways]
                    total = sum(p for _, p in ways)
                    for split, p in ways:
                        for size in split:
                            gained[size] = gained.get(size, 0.0) + n * p / total
                yield pd.DataFrame({"size": list(gained), "n": list(gained.values())}, columns=["size", "n"])

        current = values.mapInPandas(share, "size bigint, n double").groupBy("size").agg(F.sum("n").alias("n"))
    return current
