"""Bounded lists of frequent keys, one per input partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def frequent_per_partition(df: DataFrame, group: Sequence[str], size: int) -> DataFrame:
    """At most ``size`` keys per group and input partition: ``(group..., key, weight)``.

    The mergeable frequent-items summary: counted batches are gathered until they outweigh
    the list, merged into it, and each group is cut back to ``size`` keys by subtracting its
    first dropped count from all. Any key above 1/(size+1) of a group survives, whenever it
    arrives; counts are lower bounds.
    """
    by = [*group, "key"]
    df = df.select(*by, "weight")
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", weight bigint"

    def count(frames):
        import pandas as pd

        return pd.concat(frames).groupby(by, as_index=False, sort=False)["weight"].sum()

    def cut(held):
        held = held.sort_values([*group, "weight", "key"], ascending=[True] * len(group) + [False, True])
        if not group:
            if len(held) <= size:
                return held
            rest = held.iloc[:size].copy()
            rest["weight"] -= held["weight"].iloc[size]
            return rest[rest["weight"] > 0]
        place = held.groupby(list(group)).cumcount()
        dropped = held[place == size].set_index(list(group))["weight"]
        if dropped.empty:
            return held
        kept = held[place < size]
        cutoff = kept.set_index(list(group)).index.map(dropped).fillna(0)
        kept = kept.assign(weight=kept["weight"] - cutoff.to_numpy().astype("int64"))
        return kept[kept["weight"] > 0]

    def fold(batches):
        held, waiting, rows = None, [], 0
        for batch in batches:
            part = batch.groupby(by, as_index=False, sort=False)["weight"].sum()
            waiting.append(part)
            rows += len(part)
            if rows > 200_000 + (0 if held is None else len(held)):
                held = cut(count(waiting if held is None else [held, *waiting]))
                waiting, rows = [], 0
        if waiting:
            held = cut(count(waiting if held is None else [held, *waiting]))
        if held is not None and len(held):
            yield held[[*by, "weight"]]

    return df.mapInPandas(fold, schema)
