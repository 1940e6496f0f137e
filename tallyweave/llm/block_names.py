"""Exact dedup by deterministic block naming.

Normalised texts are cut into blocks of fixed size. Equal blocks get equal integers and different
blocks different ones, by sorting the blocks themselves, never by trusting a hash; then adjacent
pairs of names are named the same way, again and again, until each document has one name. Two
documents have one name and one number of levels exactly if their texts are equal.

Each task first names its own blocks, so that a block that fills a third of all documents reaches the
sort once per task only; the texts are shuffled once, everything after that is integers.

Null texts count as empty, and all empty texts are equal. Of a group's rows the one with the smallest
doc_id stays; null ids come last, and of repeated rows with one doc_id exactly one stays. Other columns are
dropped. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize

BLOCK_CHARS = 8192
#: Bytes of distinct blocks that a task remembers before it begins a new round of local names.
REMEMBERED = 32 << 20


def normalised(text: Column) -> Column:
    """Runs of blank and x09-x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def cut(docs: DataFrame, block_chars: int) -> DataFrame:
    """Blocks of each row, with local names (round, local) whose first holder brings the content.

    ``docs`` has doc_id, sha and text; each of its rows gets a number, ``row``.
    """
    schema = "row long, doc_id long, sha string, pos int, blocks int, round long, local int, block string"
    arrow = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("pos", pa.int32()), ("blocks", pa.int32()),
        ("round", pa.int64()), ("local", pa.int32()), ("block", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row, turn = part << 40, part << 24
        known, held = {}, 0
        for batch in batches:
            out = []
            for doc_id, sha, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pieces = [text[k: k + block_chars] for k in range(0, len(text), block_chars)] or [""]
                for pos, piece in enumerate(pieces):
                    name = known.get(piece)
                    content = None
                    if name is None:
                        if held > REMEMBERED:
                            known, held, turn = {}, 0, turn + 1
                        name = known[piece] = len(known)
                        held += len(piece)
                        content = piece
                    out.append((row, doc_id, sha, pos, len(pieces), turn, name, content))
                row += 1
            columns = zip(*out) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "sha", "text").mapInArrow(split, schema)


def name_blocks(blocks: DataFrame) -> DataFrame:
    """(round, local, name): one integer for each different content, by sorting the contents."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = (TaskContext.get().partitionId() << 40) - 1, None
        for batch in batches:
            names = []
            for block in batch.column(2).to_pylist():
                name, last = (name, last) if block == last else (name + 1, block)
                names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64())], ["round", "local", "name"])

    return (
        blocks.where("block IS NOT NULL").select("round", "local", "block")
        .repartition("block").sortWithinPartitions("block").mapInArrow(number, "round long, local int, name long"))


def name_pairs(rows: DataFrame) -> DataFrame:
    """Half as many names for each row: one for each different pair of neighbours."""
    side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
    pairs = materialize(
        rows.groupBy("row", F.expr("pos div 2").cast("int").alias("pos"))
        .agg(side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"), F.expr("(max(blocks) + 1) div 2").cast("int").alias("blocks")))
    names = materialize(
        pairs.select("left", "right").distinct().sortWithinPartitions("left", "right")
        .withColumn("name", F.monotonically_increasing_id()))
    return pairs.join(names, ["left", "right"]).select("row", "pos", "blocks", "name")


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, sha, row, level, name of each row of ``docs`` (doc_id, sha, text); (level, name) is its identity."""
    blocks = materialize(cut(docs, block_chars))
    names = materialize(name_blocks(blocks))
    current = blocks.select("row", "pos", "blocks", "round", "local").join(names, ["round", "local"]).select("row", "pos", "blocks", "name")
    longest = blocks.agg(F.max("blocks")).first()[0] or 1
    done, level = [], 0
    while True:
        current = materialize(current)
        done.append(current.where("blocks = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        current, longest, level = name_pairs(current.where("blocks > 1")), (longest + 1) // 2, level + 1
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    return blocks.where("pos = 0").select("row", "doc_id", "sha").join(named, "row")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    text = normalised(F.col("text"))
    named = materialize(identities(docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("sha"), text.alias("text")), block_chars))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row"))
    groups = materialize(
        named.groupBy("level", "name").agg(first.alias("first"), F.count("*").alias("group_size"))
        .select("level", "name", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
