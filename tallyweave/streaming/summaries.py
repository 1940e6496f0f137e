"""Summaries of unbounded streams with Structured Streaming.

Linear sketches are streaming grouped sums whose state is the counter table. The ordered heavy
part keeps one small state per (shard, bucket); what it hands on lands in a table per batch id,
so a repeated batch overwrites itself and the sketch of the hand-ons stays exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyweave.operators.exact import key_counts
from tallyweave.operators.folds import INT_COLUMNS, OUT, out_schema
from tallyweave.operators.heavy import BucketState, heavy_make, merge_residents, with_bucket
from tallyweave.operators.linear import count_sketch_build
from tallyweave.operators.universal import CELL, universal_build
from tallyweave.sources.scratch import scratch_path
from tallyweave.spec import SketchSpec

#: Independent states that the arrivals of each bucket are dealt to.
STREAM_SHARDS = 4
#: Arrivals of one landed file, about, and so of one micro-batch; what a task can hold if all are of one bucket.
LANDED_ROWS = 1_000_000
#: Arrivals of a state that are replayed between two pieces of output.
REPLAYED_ROWS = 50_000
# Fixed value: the state store that has map state.
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_key_counts(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running exact counts; write in ``complete`` or ``update`` mode."""
    return key_counts(stream, by)


def stream_linear_sketch(stream: DataFrame, spec: SketchSpec, kind: str = "count") -> DataFrame:
    """Running counters of a Count-Sketch or universal sketch; state is at most all cells."""
    builds: dict[str, Callable] = {"count": count_sketch_build, "universal": universal_build}
    return builds[kind](stream, spec)


class HeavyProcessor(StatefulProcessor):
    """Heavy part of one (shard, bucket): its slots as map state, and the guard."""

    def __init__(self, strategy: str, seed: int, slots: int, key_type: str):
        self.strategy, self.seed, self.slots, self.key_type = strategy, seed, slots, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "slot bigint", f"key {self.key_type}, count bigint, admitted boolean")
        self.guard = handle.getValueState("guard", "guard bigint, version bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        bucket = BucketState(heavy_make(self.strategy, self.seed), self.slots)
        guard, version = self.guard.get() if self.guard.exists() else (0, 0)
        bucket.guard = int(guard)
        before = {int(slot[0]): (place[0], int(place[1]), bool(place[2])) for slot, place in self.places.iterator()}
        bucket.held = {k: [count, admitted, slot] for slot, (k, count, admitted) in before.items()}
        types = dict(INT_COLUMNS, **({} if self.key_type == "string" else {"key": "Int64"}))
        frame = lambda out: pd.DataFrame(out, columns=("shard", "bucket", *OUT)).astype(types)
        arrivals = pd.concat(list(rows)).sort_values("seq")
        unit = tuple(int(x) for x in key)
        for start in range(0, len(arrivals), REPLAYED_ROWS):
            part, out = arrivals.iloc[start:start + REPLAYED_ROWS], []
            for seq, k, f in zip(*(part[c].tolist() for c in ("seq", "key", "weight"))):
                row = bucket.step(seq, k, f)
                if row is not None:
                    out.append(unit + row)
            if out:
                yield frame(out)
        version, out = int(version) + 1, []
        for k, (count, admitted, slot) in bucket.held.items():
            place = (k, count, admitted)
            if before.get(slot) != place:
                self.places.updateValue((slot,), place)
                out.append(unit + ("heavy", version, slot, k, count, admitted))
        self.guard.update((bucket.guard, version))
        if out:
            yield frame(out)

    def close(self) -> None:
        pass


def stream_heavy_fold(stream: DataFrame, spec: SketchSpec, strategy: str, shards: int = STREAM_SHARDS) -> DataFrame:
    """Ordered heavy part with state: emits hand-ons, and after every trigger the slots that changed in it.

    Arrivals are dealt to ``shards`` independent states of each bucket by their number, so a hot bucket is as many
    groups; a micro-batch is sorted by ``seq`` inside its group. State is one small row for each slot, of which only
    changed ones are written and emitted. Rows of kind ``heavy`` carry a growing ``version`` in ``seq`` and the
    slot in ``pos``: the newest of each slot holds. Map state lives in the RocksDB state store, which this selects.
    """
    key_type = dict(stream.dtypes)["key"]
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    shard = F.pmod(F.col("seq"), F.lit(shards)).cast("bigint")
    rows = with_bucket(stream.select("key", "seq", "weight"), spec).select(
        shard.alias("shard"), "bucket", "seq", "key", "weight")
    heavy_make(strategy, spec.seed)  # an unknown strategy is told here and not by a task
    return rows.groupBy("shard", "bucket").transformWithStateInPandas(
        HeavyProcessor(strategy, spec.seed, spec.slots, key_type), out_schema(key_type), "Append", "None")


def latest_residents(rows: DataFrame) -> DataFrame:
    """Residents ``(shard, bucket, key, v, flag)``: the newest row of every slot."""
    heavy = rows.filter(F.col("kind") == "heavy")
    newest = F.max_by(F.struct("key", F.col("f").alias("v"), "flag"), "seq")
    return heavy.groupBy("shard", "bucket", "pos").agg(newest.alias("_new")).select("shard", "bucket", "_new.*")


def land_in_order(arrivals: DataFrame, rows: int = LANDED_ROWS) -> DataFrame:
    """A table with ``seq`` as an unbounded stream whose micro-batches hold about ``rows`` arrivals each, in order.

    Blocks of arrival numbers are counted, small neighbours are put together, and each lands as a file after the one
    before it; a trigger takes one file, as the file source goes by their times. Only one block is ever in a state's hands.
    """
    spark = arrivals.sparkSession
    path = scratch_path(spark, "landed")
    block = F.expr(f"(seq - pmod(seq, {rows}L)) div {rows}L").alias("block")
    counts = sorted(map(tuple, arrivals.groupBy(block).agg(F.count(F.lit(1)).alias("n")).collect()))
    spans: list[list[int]] = []
    for number, n in counts:
        if spans and spans[-1][2] + n <= rows:
            spans[-1][1:] = [number, spans[-1][2] + n]
        else:
            spans.append([number, number, n])
    for first, last, _ in spans:
        inside = arrivals.filter((F.col("seq") >= first * rows) & (F.col("seq") < (last + 1) * rows))
        inside.repartition(1).write.mode("append").parquet(path)
    if not spans:
        arrivals.limit(0).write.parquet(path)
    return spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_available(stream: DataFrame, mode: str, path: str) -> None:
    """Process what is there now; each batch overwrites its own ``batch=N`` folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start())
    query.awaitTermination()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming result to the end of its input and read all batches (column ``batch``)."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    run_available(stream, mode, path)
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def last_batch(rows: DataFrame) -> DataFrame:
    """The newest whole table of a ``complete`` mode result."""
    newest = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), "batch").drop("batch")


def last_update(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The newest row per key of an ``update`` mode result."""
    value = F.max_by(F.struct(*[c for c in rows.columns if c not in (*key, "batch")]), "batch")
    return rows.groupBy(*key).agg(value.alias("_new")).select(*key, "_new.*")


def stream_extract(stream: DataFrame, spec: SketchSpec, strategy: str, path: str, shards: int = STREAM_SHARDS) -> None:
    """Heavy part and sketch chained: per batch, residents and the counters of its hand-ons.

    ``residents/batch=N`` and ``counters/batch=N`` are rewritten whole if batch N is repeated.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.filter(F.col("kind") == "heavy").write.mode("overwrite").parquet(f"{path}/residents/batch={batch_id}")
        handed = batch.filter(F.col("kind") != "heavy").select("key", F.col("f").alias("weight"))
        universal_build(handed, spec).write.mode("overwrite").parquet(f"{path}/counters/batch={batch_id}")
        batch.unpersist()

    query = (
        stream_heavy_fold(stream, spec, strategy, shards).writeStream.outputMode("append")
        .foreachBatch(save).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    query.awaitTermination()


def load_stream_extract(spark: SparkSession, path: str, spec: SketchSpec) -> tuple[DataFrame, DataFrame]:
    """``(heavy, counters)`` of everything processed so far, with one resident row per key.

    Where the fold ran in several shards their residents are merged into the slots of one, and the counters
    take what these can't hold.
    """
    heavy, losers = merge_residents(latest_residents(spark.read.parquet(f"{path}/residents/batch=*")), spec)
    handed = spark.read.parquet(f"{path}/counters/batch=*").select(*CELL, "v")
    counters = handed.unionByName(universal_build(losers, spec)).groupBy(*CELL).agg(F.sum("v").alias("v"))
    return heavy, counters.filter(F.col("v") != 0)


def reset_epoch(stream: DataFrame, epoch_rows: int) -> DataFrame:
    """Start over every ``epoch_rows`` arrivals: an ``epoch`` column to group builds by."""
    return stream.withColumn("epoch", F.floor(F.col("seq") / F.lit(epoch_rows)).cast("bigint"))
