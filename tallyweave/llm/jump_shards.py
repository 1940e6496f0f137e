"""Sharding by jump consistent hashing: stable keys to shards, without a table of the ring.

A key's shard depends on the key and the number of shards alone; appending a shard moves only the
share of keys that the new shard takes, and moves them into it. Slots number a shard's rows without
gaps: rows are dealt to hash bins, numbered inside each bin, and shifted by the rows of the bins
before, so no task holds a whole shard.

A null key counts as the key 0. Null texts count as empty. Rows of equal keys fall into one shard and
get slots of their own, in an order that their text settles; rows equal in every column get adjacent
slots. Columns named like a result are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize

#: Rows that one bin holds on average.
BIN_ROWS = 100_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of Lamping and Veach for 64-bit keys."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        out[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        reach = 2147483648.0 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((out[live] + 1) * reach).astype(np.int64)
        live = live[ahead[live] < shards]
    return out


def jump_shard(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.fillna(0).to_numpy(np.int64), shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def with_slots(rows: DataFrame, shard: str, order: list[str], slot: str = "slot", bin_rows: int = BIN_ROWS) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps. ``rows`` should be cheap to read twice."""
    bins = max(1, -(-rows.count() // bin_rows))
    binned = rows.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)).cast("int"))
    counts = binned.groupBy(shard, "_bin").agg(F.count("*").alias("_n"))  # shards x bins rows
    before = Window.partitionBy(shard).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(shard, "_bin").orderBy(*order)
    return (
        binned.withColumn("_at", F.row_number().over(own) - 1).join(offsets, [shard, "_bin"])
        .withColumn(slot, (F.col("_before") + F.col("_at")).cast("long")).drop("_bin", "_before", "_at"))


def shard_documents(docs: DataFrame, shards: int = 8, grown: int | None = None, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (and the text).

    ``grown_shard`` is the shard with ``grown`` shards, one more than ``shards`` unless said otherwise.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        "doc_id", *(["text"] if keep_text else []),
        (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"), jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), grown or shards + 1).alias("grown_shard"))
    if not keep_text:
        placed = materialize(placed)  # small; texts are rather read again than written
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
