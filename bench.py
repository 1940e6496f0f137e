"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local threads. Every query is run once to
warm up and once timed, into the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time

from tallyweave.plans import load_queries

HEADLINE = (
    "key_counts", "gsum_exact_entropy", "heavy_hitters_exact", "topk_exact", "count_sketch_build",
    "count_sketch_query", "count_min_query", "agms_join", "fagms_join", "salsa_query", "universal_build",
    "universal_gsum", "universal_candidates_estimated", "heavy_fold_elastic", "heavy_fold_guardian",
    "heavy_fold_frequent", "heavy_spacesaving", "lossless_split", "extract_query", "extract_gsum",
    "extract_bounded_gsum", "inner_product_exact", "cosine_exact", "jaccard_exact", "cosine_est",
    "maxlog_jaccard", "skim_join", "three_tier_join", "elastic_query", "waving_query",
    "stream_linear_sketch", "stream_heavy_fold", "zipf_keys",
)


def main() -> None:
    from tests.session import make_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = make_session(os.environ.get("BENCH_CPUS", "8"))
    catalog = load_queries()
    run = lambda name: catalog[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        run(name)
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    build = seconds.get("universal_build")
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
        "universal_build_items_per_sec": round(items / build) if build else None}))
    spark.stop()


if __name__ == "__main__":
    main()
