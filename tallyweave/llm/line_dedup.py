"""Line dedup: lines that many documents share are dropped, the others stay in their order.

A line's key is the line with blank and x09-x0D stripped at both ends and A-Z lower-cased. The distinct keys of
each document are exploded and hashed, and documents are counted per hash, summed up inside each task before
anything moves. Lines whose key reaches the threshold are then looked for by position, and each document is put
together again from the stretches between its dropped positions.

Keys are told apart by two 64-bit hashes. Only hashes and positions are joined and grouped; a text is moved once,
to meet the positions that it loses. Copies of a text share those positions, so they are worked out once for each
text, and a hot line costs one row for each task that holds it.

Every row is a document of its own, whatever its doc_id. Null and empty texts are one empty line. Keys shorter
than ``least`` code points are never dropped. Other columns stay as they are; columns named as one of the results
are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shared lines up to which their hashes (16 bytes each) are sent to all executors.
BROADCAST_ROWS = 1_000_000


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; the general case is taken only where a text has other characters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(text: Column) -> Column:
    return F.transform(lines_of(lower_ascii(text)), lambda line: F.btrim(line, F.lit(BLANKS)))


def two_hashes(value: Column, first: str, second: str) -> list[Column]:
    return [F.xxhash64(value).alias(first), F.xxhash64(F.lit(1), value).alias(second)]


def shared_lines(docs: DataFrame, text: str = "text", documents: int = 10, least: int = 1) -> DataFrame:
    """(h1, h2, documents) of each line key of at least ``least`` code points in so many documents or more."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(F.col(text)))).alias("key")).where(F.length("key") >= least)
    counted = keys.select(*two_hashes(F.col("key"), "h1", "h2")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("documents"))
    return counted.where(F.col("documents") >= documents)


def dropped_positions(docs: DataFrame, shared: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """(t1, t2, dropped): for each text by its hashes, the sorted positions of its shared lines, if it has any."""
    few = shared.count() <= BROADCAST_ROWS
    lines = (
        docs.select(*two_hashes(F.col(text), "t1", "t2"), F.posexplode(line_keys(F.col(text))).alias("pos", "key"))
        .where(F.length("key") >= least)
        .select("t1", "t2", "pos", *two_hashes(F.col("key"), "h1", "h2")))
    shared = shared.select("h1", "h2")
    hits = lines.join(F.broadcast(shared) if few else shared, ["h1", "h2"])
    return hits.groupBy("t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def without_positions(lines: Column, dropped: Column) -> Column:
    """The stretches of ``lines`` between the ``dropped`` positions, in time linear in both."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(F.size(lines)))
    stretch = lambda i: F.slice(lines, F.get(before, i) + 2, F.get(after, i) - F.get(before, i) - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), stretch))


def drop_shared_lines(docs: DataFrame, text: str = "text", documents: int = 10, least: int = 1) -> DataFrame:
    """``docs`` with shared lines taken out of ``text``, and n_lines and n_dropped of each document."""
    shared = materialize(shared_lines(docs, text, documents, least))
    lost = dropped_positions(docs, shared, text, least)
    held = docs.select(F.struct(*docs.columns).alias("doc"), *two_hashes(F.col(text), "d1", "d2"))
    met = held.join(lost, (F.col("d1") == F.col("t1")) & (F.col("d2") == F.col("t2")), "left")
    cut = met.select("doc", "dropped", lines_of(F.col("doc")[text]).alias("lines"))
    kept = F.when(F.col("dropped").isNull(), F.coalesce(F.col("doc")[text], F.lit(""))).otherwise(
        F.array_join(without_positions(F.col("lines"), F.col("dropped")), "\n"))
    return cut.select(
        *[kept.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of ``docs``."""
    return drop_shared_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
