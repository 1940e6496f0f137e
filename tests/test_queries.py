"""Registered queries equal their SQL. ``ALL_QUERIES=1`` runs the whole catalog."""

import os

import pytest

import __spark_entry__
from tallyweave.plans import load_queries
from tests.compare import difference

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
USUAL = (
    "keyed_stream", "read_limit_large", "project_flow_key_src_dst", "filter_prefix", "split_streams_halves",
    "gsum_all", "heavy_hitters_exact", "topk_builtin", "cosine_exact", "hash_bucket", "hash_bucket_text",
    "count_sketch_query", "kary_query", "agms_join", "fagms_delete", "salsa_build_wide_counts", "linear_counting",
    "universal_gsum", "universal_gsum_text", "universal_candidates_bounded", "l2_heavy_hitters", "lossless_residual",
    "heavy_fold_elastic", "heavy_fold_guardian", "heavy_fold_frequent", "heavy_merge_shards", "heavy_bounded_split",
    "extract_elastic_gsum", "extract_bounded_gsum", "extract_gsum_mul", "maxlog_jaccard", "elastic_gsum",
    "elastic_light_blocks", "waving_merge_casts", "waving_expand_casts", "skim_join", "three_tier_join",
    "flow_size_distribution_em", "read_flow_trace", "zipf_keys", "save_sketch", "stream_extract", "eval_trials",
)
CATALOG = load_queries()
NAMES = [n for n, q in CATALOG.items() if q.sql] if os.environ.get("ALL_QUERIES") else USUAL


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    q = CATALOG[name]
    assert difference(q.build(spark, SF_DIR), q.sql, SF_DIR) is None


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) < set(__spark_entry__.queries())
