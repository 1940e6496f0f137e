"""A training corpus from the documents table, in stages that each read what the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import compression_quality, jaccard_regions, jump_shards, simhash_windows, source_mixing
from tallyweave.llm.inputs import table
from tallyweave.sources.scratch import scratch_path

QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = compression_quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return compression_quality.score_quality(docs, model, "_score").where(F.col("_score") >= QUALITY).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard_regions.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return simhash_windows.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return source_mixing.mixed_documents(docs, source_mixing.mix_levels(), source_mixing.MIX_WEIGHTS, source_mixing.MIX_SHARE)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, shard, slot and text of the corpus, with the size and checksum of each text."""
    return jump_shards.shard_documents(docs, keep_text=True)


STAGES = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
    ("mixing sources", mixing), ("sharding", sharding),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
