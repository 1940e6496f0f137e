"""Results and summaries on disk."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.exact import freq_histogram, stream_totals
from tallyweave.operators.extract import Summary
from tallyweave.spec import SketchSpec


def result_table(results: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """``(mem, algo, value)`` rows turned into one row per memory size, one column per algorithm."""
    return results.groupBy("mem").pivot("algo", list(algorithms)).agg(F.avg("value")).orderBy("mem")


def write_result_csv(results: DataFrame, path: str, algorithms: Sequence[str]) -> None:
    result_table(results, algorithms).write.mode("overwrite").csv(path, header=True)


def write_text_report(lines: DataFrame, path: str) -> None:
    """All columns of each row as one comma-separated line."""
    lines.select(F.concat_ws(",", *lines.columns).alias("value")).write.mode("overwrite").text(path)


def frequency_stats(counts: DataFrame) -> DataFrame:
    """A header row (flows, packets), then the number of keys of each frequency."""
    header = stream_totals(counts).select(
        F.lit("total").alias("part"), F.col("flows").alias("a"), F.col("packets").alias("b"))
    return header.unionByName(freq_histogram(counts).select(
        F.lit("size").alias("part"), F.col("f").alias("a"), F.col("n").alias("b")))


def write_frequency_stats(counts: DataFrame, path: str) -> None:
    frequency_stats(counts).write.mode("overwrite").csv(path, header=True)


TABLES = ("heavy", "counters", "candidates")


def save_sketch(summary: Summary, path: str) -> None:
    """The tables of a summary as parquet, and its spec as one metadata row."""
    for name in TABLES:
        getattr(summary, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = summary.heavy.sparkSession
    spark.range(1).select(F.lit(json.dumps(summary.spec.metadata())).alias("spec")).write.mode(
        "overwrite").parquet(f"{path}/spec")


def load_sketch(spark: SparkSession, path: str) -> Summary:
    spec = SketchSpec(**json.loads(spark.read.parquet(f"{path}/spec").first()["spec"]))
    return Summary(*(spark.read.parquet(f"{path}/{name}") for name in TABLES), spec)
