"""The queries of this package over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import (
    blob_ledger, block_names, compression_quality, jaccard_regions, jump_shards, licence_digests, line_dedup, ngram_toxicity,
    phrase_automata, simhash_windows, source_mixing, threshold_clusters, url_reputation,
)
from tallyweave.llm.inputs import table
from tallyweave.llm.sqltext import (
    BLOCK_NAMES_SQL, CLUSTERS_SQL, JACCARD_SQL, LICENCE_SQL, LINES_SQL, MIXING_SQL, PHRASES_SQL, WINDOWS_SQL, urls_sql,
)
from tallyweave.sources.scratch import scratch_path

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_windows.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(licence_digests.KNOWN, "licence_id string, text string")
    return licence_digests.licence_hits(table(spark, sf_dir, "documents"), known)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(table(spark, sf_dir, "documents"), source_mixing.mix_levels(), source_mixing.MIX_WEIGHTS, source_mixing.MIX_SHARE)
    return mixed.drop("check")


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(table(spark, sf_dir, "documents"))


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.shard_documents(table(spark, sf_dir, "documents"))


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as versions, scanned into a fresh ledger."""
    found = blob_ledger.scan_versions(
        table(spark, sf_dir, "documents"), ["doc_id"], "text", blob_ledger.BASE_RULES, scratch_path(spark, "ledger"))
    return blob_ledger.secret_digest(found, ["doc_id"])


def op8_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is good where the document that its path names is of quality and not toxic."""
    pages = table(spark, sf_dir, "pages")
    _, path = url_reputation.url_parts(F.col("url"))
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    named = pages.select("page_id", F.regexp_extract(path, r"^/[a-z]+/(\d{1,18})", 1).try_cast("long").alias("doc_id"))
    return url_reputation.judge_urls(pages, named.join(labels, "doc_id").select("page_id", "good"), URL_RULES)


def op10_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_regions.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_clusters.cluster_report(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_windows": op1_simhash_windows, "op2_licence_digests": op2_licence_digests,
    "op3_compression_quality": op3_compression_quality, "op4_block_names": op4_block_names,
    "op5_source_mixing": op5_source_mixing, "op6_jump_shards": op6_jump_shards, "op7_blob_ledger": op7_blob_ledger, "op8_ngram_toxicity": op8_ngram_toxicity,
    "op9_url_reputation": op9_url_reputation, "op10_jaccard_regions": op10_jaccard_regions,
    "op11_threshold_clusters": op11_threshold_clusters, "op12_line_dedup": op12_line_dedup,
    "op13_phrase_automata": op13_phrase_automata,
}

SQL = {
    "op1_simhash_windows": WINDOWS_SQL, "op2_licence_digests": LICENCE_SQL, "op4_block_names": BLOCK_NAMES_SQL,
    "op5_source_mixing": MIXING_SQL, "op9_url_reputation": urls_sql(URL_RULES), "op10_jaccard_regions": JACCARD_SQL, "op11_threshold_clusters": CLUSTERS_SQL, "op12_line_dedup": LINES_SQL,
    "op13_phrase_automata": PHRASES_SQL,
}
