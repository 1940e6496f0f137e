"""Runner of ordered per-bucket state machines.

A machine sees the arrivals of one bucket in ``seq`` order. The unit of work is (shard,
bucket), a shard being a fixed-length block of arrivals, so a hot bucket is spread over as many
tasks as it has shards. Rows stream through sorted batches; only one bucket's state is held.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.spec import SHARD_ROWS

OUT = ("kind", "seq", "pos", "key", "f", "flag")
INT_COLUMNS = {"seq": "Int64", "pos": "Int64", "f": "int64"}


class Machine(Protocol):
    def step(self, seq: int, key, f: int):
        """One arrival; returns None or one output row in the order of ``OUT``."""

    def close(self):
        """Rows left at the end of the bucket."""


def out_schema(key_type: str) -> str:
    return (f"shard bigint, bucket bigint, kind string, seq bigint, pos bigint, key {key_type}, "
            "f bigint, flag boolean")


def ordered_fold(bucketed: DataFrame, machine: Callable[[], Machine],
                 shard_rows: int | None = SHARD_ROWS) -> DataFrame:
    """Fold ``(bucket, seq, key, weight)`` rows; the result is independent of partitioning.

    Without ``shard_rows`` each bucket is replayed from its first arrival to its last, as one shard.
    Rows without a key or an arrival number are no arrivals.
    """
    bucketed = bucketed.filter("key IS NOT NULL AND seq IS NOT NULL")
    key_type = dict(bucketed.dtypes)["key"]
    types = dict(INT_COLUMNS, **({} if key_type == "string" else {"key": "Int64"}))
    shard = (F.lit(0) if shard_rows is None else F.floor(F.col("seq") / F.lit(shard_rows))).cast("bigint")
    ordered = (
        bucketed.select(shard.alias("shard"), "bucket", "seq", "key", "weight")
        .repartition("shard", "bucket")
        .sortWithinPartitions("shard", "bucket", "seq")
    )

    def frame(rows):
        import pandas as pd

        return pd.DataFrame(rows, columns=("shard", "bucket", *OUT)).astype(types)

    def run(batches):
        unit, state = None, None
        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in ("shard", "bucket", "seq", "key", "weight"))
            for shard_no, bucket, seq, key, f in zip(*columns):
                if unit != (shard_no, bucket):
                    if unit is not None:
                        out.extend(unit + row for row in state.close())
                    unit, state = (shard_no, bucket), machine()
                row = state.step(seq, key, f)
                if row is not None:
                    out.append(unit + row)
            if out:
                yield frame(out)
        if unit is not None:
            yield frame([unit + row for row in state.close()])

    return ordered.mapInPandas(run, out_schema(key_type))
