"""Secret scan with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a folder of
Parquet files that is only ever appended to, holds one row for each pair of blob and rule version
that was scanned. A scan looks only at pairs that the ledger lacks, each blob once however many paths
hold it, appends what it found, and joins the findings back to all paths. A batch that a lost driver
left half done leaves no committed rows and is simply scanned again; should two batches scan one pair,
both rows say the same and readers keep one.

Null content counts as empty. Contents are scanned whole. Equal contents are one blob; repeated rows
each get the findings. Columns beyond the key columns and the content are dropped; they may have any
names. An empty table gives no rows and adds nothing to the ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.sources.scratch import materialize

LEDGER = T.StructType([
    T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("version", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))])


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern, of which those with a long enough group count."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: Fixed patterns of the three base kinds, in their listed order.
BASE_RULES = (
    Rule("assign", 1, r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs scanned so far; empty where the folder does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(folder) if exists else spark.createDataFrame([], LEDGER)


def address(versions: DataFrame, keys: list[str], content: str) -> DataFrame:
    """The key columns and the blob of every version, written once and read many times."""
    raw = F.coalesce(F.col(content), F.lit(""))
    return materialize(versions.select(*keys, F.sha2(raw.cast("binary"), 256).alias("blob")))


def scan_new(
    versions: DataFrame, addressed: DataFrame, keys: list[str], content: str, rules: tuple[Rule, ...], ledger: str,
) -> None:
    """Scans the pairs of blob and rule version that the ledger lacks, and appends them to it."""
    spark = versions.sparkSession
    done = read_ledger(spark, ledger)
    wanted = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    holders = addressed.groupBy("blob").agg(F.min(F.struct(*keys)).alias("at"))  # one path to read each blob from
    missing = (
        holders.select("blob", "at", F.explode(wanted).alias("w")).select("blob", "at", "w.rule", "w.version")
        .join(done.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
        .groupBy("blob").agg(F.first("at").alias("at"), F.collect_set("rule").alias("rules"))
        .select("blob", "rules", *(F.col(f"at.{k}").alias(k) for k in keys)))
    missing = materialize(missing)
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    todo = (
        versions.select(*keys, F.coalesce(F.col(content), F.lit("")).alias("content")).alias("v")
        .join(missing.alias("m"), same).where(F.sha2(F.col("content").cast("binary"), 256) == F.col("blob"))
        .select("blob", "rules", "content"))
    compiled = {r.name: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, wanted_rules, text in zip(*(batch.column(i) for i in range(3))):
                text = text.as_py()
                for name in sorted(wanted_rules.as_py()):
                    spans = [{"start": a, "stop": b} for a, b in compiled[name].spans(text)]
                    out.append({"blob": blob.as_py(), "rule": name, "version": compiled[name].version, "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("blob", pa.string()), ("rule", pa.string()), ("version", pa.int32()),
                ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))

    todo.mapInArrow(scan, LEDGER).write.mode("append").parquet(ledger)


def blob_findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per blob: for each rule, at its present version, the array of its spans."""
    now = read_ledger(spark, ledger)
    of = lambda r: F.max(F.when((F.col("rule") == r.name) & (F.col("version") == r.version), F.col("spans")))
    return now.groupBy("blob").agg(*(of(r).alias(r.name) for r in rules))


def scan_versions(
    versions: DataFrame, keys: list[str], content: str, rules: tuple[Rule, ...], ledger: str,
) -> DataFrame:
    """The keys and blob of every version, and for each rule the spans found in its content."""
    addressed = address(versions, keys, content)
    scan_new(versions, addressed, keys, content, rules, ledger)
    found = materialize(blob_findings(versions.sparkSession, ledger, rules))
    return addressed.join(found, "blob").select(*keys, "blob", *(r.name for r in rules))


def secret_digest(scanned: DataFrame, keys: list[str], rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts by kind, all spans as ``kind:start:end`` by start and then kind, and their SHA-256."""
    def labelled(kind: int, name: str):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(name), s["start"], s["stop"]).alias("text"))

    lists = [F.transform(F.col(r.name), labelled(i, r.name)) for i, r in enumerate(rules)]
    spans = F.array_join(F.transform(F.array_sort(F.concat(*lists)), lambda s: s["text"]), ",")
    return scanned.select(
        *keys, *(F.size(r.name).cast("long").alias(f"n_{r.name}") for r in rules),
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), "blob")
