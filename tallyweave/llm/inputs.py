"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that numpy handles at once inside a task.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_column_type(df: DataFrame, name: str, kind: T.DataType | None = None) -> T.StructType:
    """The schema of ``df`` with one more column, DOUBLE unless said otherwise."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind or T.DoubleType())])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from all learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, longest: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_label`` labelled rows for each of the labels 0 and 1.

    Rows that :func:`held_out` marks, and rows with a null id, text or label, are never taken. Which rows
    are taken depends on a hash of their ids only. Texts over ``longest`` characters are left out of
    the sample, so its size is bounded whatever the corpus holds.
    """
    named = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    picked = [
        named.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        for value in (0, 1)
    ]
    picked = picked[0].union(picked[1]).dropDuplicates()
    rows = (
        docs.select("doc_id", "text").where(F.length("text") <= longest)
        .join(F.broadcast(picked), "doc_id")  # at most 2 * per_label rows of two integers
        .select("doc_id", "text", "label").collect())
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.label, r.text))]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last
