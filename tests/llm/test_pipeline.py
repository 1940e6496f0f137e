"""The pipeline beside its stages done by hand."""

import pytest

import corpus_pipeline
from tallyweave.llm import compression_quality, jump_shards, simhash_windows, source_mixing
from tallyweave.llm.inputs import table
from tests.llm.test_operators import brute_components

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    docs = table(spark, SF_DIR, "documents")
    scores = {r.doc_id: r.predicted for r in compression_quality.quality_scores(docs, table(spark, SF_DIR, "labels")).collect()}
    good = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id]]
    ids = sorted(int(d) for d, _, c in brute_components(good) if d == c)
    left = docs.where(docs.doc_id.isin(ids))
    found = {r.doc_id for r in simhash_windows.contaminations(left, table(spark, SF_DIR, "benchmark")).collect()}
    clean = left.where(~left.doc_id.isin([-1, *found]))
    copies = source_mixing.mix(clean, source_mixing.mix_levels(), source_mixing.MIX_WEIGHTS, source_mixing.MIX_SHARE).collect()
    wanted = sorted(r.doc_id for r in copies for _ in range(r.copies))
    assert sorted(r.doc_id for r in rows) == wanted and 0 < len(wanted)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in rows)
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, stage):
    schema = table(spark, SF_DIR, "documents").schema
    rows = [(1, None, None, None, None), (None, "a b c", "en", "src1", 5), (3, "", "en", "src1", 0), (3, "", "en", "src1", 0), (4, "x " * 50_000, "de", "q", 9)]
    some = stage(spark, spark.createDataFrame(rows, schema), SF_DIR)
    assert some.count() <= 20
    empty = stage(spark, spark.createDataFrame([], schema), SF_DIR)
    assert empty.count() == 0
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert some.columns == schema.names and empty.columns == schema.names
