"""Fixed-length binary traces as a Spark data source, ``trace``.

Reading lists files and their lengths, cuts them on record edges into byte ranges and numbers records by the
lengths ahead, so planning reads no record. A task reads its range in blocks, decodes each with one
numpy record type and hands it on as an Arrow batch. Writing is in two steps: tasks write drafts
and tell their names, and only when all have ended are these given their final names; a failed or
repeated task leaves nothing behind.

A path without a scheme is on the session's default file system, for reading and writing alike. File systems are
those that pyarrow knows (local, HDFS, S3, GCS and Azure).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

# Record layouts. Addresses are u32, ports u16, protocol u8, time a double.
LAYOUTS = {
    "flow": [("src_ip", "u4"), ("dst_ip", "u4"), ("src_port", "u2"), ("dst_port", "u2"),
             ("proto", "u1"), ("ts", "f8")],
    "item": [("key", "u4"), ("pad", "u4"), ("ts", "f8")],
    "id": [("key", "u4")],
}
SCHEMAS = {
    "flow": "seq bigint, src_ip bigint, dst_ip bigint, src_port bigint, dst_port bigint, proto bigint, ts double",
    "item": "seq bigint, key bigint, ts double",
    "id": "seq bigint, key bigint",
}
BLOCK_RECORDS = 1 << 16


def record_type(layout: str, byte_order: str = "little") -> np.dtype:
    """Record type of a layout. ``byte_order`` concerns the integers; the time is always
    little-endian."""
    order = {"little": "<", "big": ">"}[byte_order]
    return np.dtype([(n, ("<" if t == "f8" else order) + t) for n, t in LAYOUTS[layout]])


def file_system(uri: str):
    """pyarrow's file system of a full path, and the path inside it."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


@dataclass
class Records(InputPartition):
    """Records ``first`` to ``first + count`` of a file; ``seq`` is the number of the first one in the whole trace."""

    file: str
    first: int
    count: int
    seq: int

    def __post_init__(self):
        super().__init__(None)


class TraceReader(DataSourceReader):
    def __init__(self, options):
        self.dtype = record_type(options["layout"], options["byte_order"])
        self.files: list[tuple[str, int]] = [tuple(f) for f in json.loads(options["files"])]
        self.records = max(1, int(options["partition_bytes"]) // self.dtype.itemsize)

    def partitions(self) -> Sequence[Records]:
        out, seq = [], 0
        for file, size in self.files:
            records = size // self.dtype.itemsize
            for first in range(0, records, self.records):
                n = min(self.records, records - first)
                out.append(Records(file, first, n, seq + first))
            seq += records
        return out or [Records("", 0, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, path = file_system(partition.file)
        width = self.dtype.itemsize
        names = [n for n in self.dtype.names if n != "pad"]
        with fs.open_input_file(path) as source:
            for at in range(0, partition.count, BLOCK_RECORDS):
                n = min(BLOCK_RECORDS, partition.count - at)
                rows = np.frombuffer(source.read_at(n * width, (partition.first + at) * width), self.dtype)
                columns = [np.arange(partition.seq + at, partition.seq + at + n)]
                columns += [rows[name].astype("f8" if name == "ts" else "i8") for name in names]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["seq", *names])


@dataclass
class Draft(WriterCommitMessage):
    part: int
    draft: str
    records: int


class TraceWriter(DataSourceArrowWriter):
    """Drafts of one task each, named for good when all tasks have ended."""

    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.dtype = record_type(options["layout"], options["byte_order"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Draft:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = file_system(self.folder)
        draft, out, count = f"{base}/.part-{task.partitionId():05d}-{task.taskAttemptId()}", None, 0
        for batch in iterator:
            if batch.num_rows == 0:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(draft)
            rows = np.zeros(batch.num_rows, dtype=self.dtype)
            for name in self.dtype.names:
                if name != "pad":
                    rows[name] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            out.write(rows.tobytes())
            count += batch.num_rows
        if out is not None:
            out.close()
        return Draft(task.partitionId(), draft if out is not None else "", count)

    def commit(self, messages: Sequence[Draft | None]) -> None:
        fs, base = file_system(self.folder)
        for m in messages:
            if m is not None and m.draft:
                fs.move(m.draft, f"{base}/part-{m.part:05d}.dat")

    def abort(self, messages: Sequence[Draft | None]) -> None:
        fs, _ = file_system(self.folder)
        for m in messages:
            if m is not None and m.draft:
                fs.delete_file(m.draft)


class TraceSource(DataSource):
    """``spark.read.format("trace")`` with the options ``layout``, ``byte_order``, ``files`` and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return SCHEMAS[self.options["layout"]]

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options)

    def writer(self, schema, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options)


def _paths(spark: SparkSession, path: str):
    """Hadoop's view of a path: its file system, and the path with scheme and host."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, fs.makeQualified(hadoop)


def full_path(spark: SparkSession, path: str) -> str:
    """A path with the scheme and host that Spark reads and writes it at."""
    uri = _paths(spark, path)[1].toUri().toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def list_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Files that a path or pattern names, or that lie in such folders, by path, with their lengths."""
    fs, glob = _paths(spark, pattern)
    found = []
    for status in fs.globStatus(glob) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(full_path(spark, s.getPath().toString()), s.getLen()) for s in inside
                  if s.isFile() and not s.getPath().getName().startswith((".", "_"))]
    return sorted(found)


def _read(spark: SparkSession, path: str, layout: str, byte_order: str) -> DataFrame:
    files = list_files(spark, path)
    if not files:
        raise FileNotFoundError(f"no trace at {path}")
    width = record_type(layout, byte_order).itemsize
    torn = [f for f, size in files if size % width]
    if torn:
        raise ValueError(f"{torn[0]} is no whole number of records of {width} bytes")
    spark.dataSource.register(TraceSource)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return spark.read.format("trace").options(
        layout=layout, byte_order=byte_order, files=json.dumps(files), partition_bytes=split).load()


def read_flow_trace(spark: SparkSession, path: str, byte_order: str = "little") -> DataFrame:
    """21-byte packets: the five tuple fields, a time, and ``seq`` in file order."""
    return _read(spark, path, "flow", byte_order)


def read_doc_items(spark: SparkSession, path: str) -> DataFrame:
    """16-byte items: a key in the first four bytes and a time in the last eight."""
    return _read(spark, path, "item", "little")


def read_id_stream(spark: SparkSession, path: str) -> DataFrame:
    """4-byte keys, one arrival each."""
    return _read(spark, path, "id", "little")


def read_trace_dir(spark: SparkSession, folder: str, layout: str = "flow",
                   pattern: str = "*.dat", byte_order: str = "little") -> DataFrame:
    """All traces of a shared folder as one stream, in path order."""
    return _read(spark, f"{folder.rstrip('/')}/{pattern}", layout, byte_order)


def write_trace(df: DataFrame, folder: str, layout: str, byte_order: str = "little",
                order: str = "seq") -> DataFrame:
    """Write a stream as raw records, one ``part-NNNNN.dat`` per range of ``order``.

    The ranges follow ``spark.sql.shuffle.partitions`` and are put together by size, as those of any shuffle. Returns
    ``(file, records)`` of the files of the folder.
    """
    spark = df.sparkSession
    names = [name for name, _ in LAYOUTS[layout] if name != "pad"]
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).select(*names)
    target = full_path(spark, folder)
    spark.dataSource.register(TraceSource)
    ranged.write.format("trace").mode("append").options(layout=layout, byte_order=byte_order).save(target)
    width = record_type(layout, byte_order).itemsize
    parts = [(file, size // width) for file, size in list_files(spark, f"{target}/part-*.dat")]
    return spark.createDataFrame(parts, "file string, records bigint")
