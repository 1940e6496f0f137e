"""Results beside plain programs written from the contracts alone, without the operators' own parts."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import queries, url_reputation
from tallyweave.llm.inputs import table
from tests.compare import difference
from tests.llm.test_operators import SF_DIR


@pytest.mark.parametrize("name", ["op9_url_reputation", "op10_jaccard_regions"])
def test_queries_equal_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), queries.SQL[name], SF_DIR) is None


def jump_one(key, shards):
    """The published loop, a key at a time, in unbounded integers."""
    state, held, ahead = key % (1 << 64), -1, 0
    while ahead < shards:
        held = ahead
        state = (state * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((held + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return held


def test_shards_equal_the_scalar_loop(spark):
    rows = queries.op6_jump_shards(spark, SF_DIR).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, SF_DIR, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump_one(r.doc_id, 8), jump_one(r.doc_id, 9))
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))


def secrets(text):
    kinds = [
        ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]
    spans = [
        (m.start(), k, f"{name}:{m.start()}:{m.end()}")
        for k, (name, rule, group, least) in enumerate(kinds) for m in rule.finditer(text) if len(m.group(group)) >= least]
    return [s for _, _, s in sorted(spans)]


def test_secrets_equal_the_contract(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}
    rows = queries.op7_blob_ledger(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = secrets(texts[r.doc_id])
        counts = [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) or not spans


def test_domains_and_suffixes(spark):
    hosts = ["a.bbc.co.uk", "b.other.co.uk", "co.uk", "10.0.0.7", "10.0.0.7:80", "x.org:8080", "www.example.com", "com", "", "m.a.example.net", "[::1]:80"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    levels = url_reputation.host_levels(F.col("host"))
    found = [(r.s, r.d) for r in df.select(levels["suffix"].alias("s"), levels["domain"].alias("d")).collect()]
    assert found == [
        ("co.uk", "bbc.co.uk"), ("co.uk", "other.co.uk"), ("co.uk", "co.uk"), ("10.0.0.7", "10.0.0.7"), ("10.0.0.7", "10.0.0.7"), ("org", "x.org"),
        ("com", "example.com"), ("com", "com"), ("", ""), ("net", "example.net"), ("[::1]", "[::1]")]


def test_urls_on_awkward_rows(spark):
    rows = [(1, None), (1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://EXAMPLE.com?x#y"), (None, "a://b/" + "c" * 200_000), (4, "HTTP://EXAMPLE.com?x#y")]
    pages = spark.createDataFrame([(*r, "h", "v", 1) for r in rows], "page_id long, url string, host string, verdict string, n int")
    outcomes = spark.createDataFrame([(4, 1), (4, 0), (None, 1)], "page_id long, good int")
    found = url_reputation.judge_urls(pages, outcomes, queries.URL_RULES).collect()
    assert sorted((str(r.page_id), r.host, len(r.path)) for r in found) == sorted(
        [("1", "", 0), ("1", "", 0), ("2", "", 0), ("3", "", 0), ("4", "example.com", 0), ("4", "example.com", 0), ("None", "b", 200_001)])
    assert url_reputation.judge_urls(pages.limit(0), outcomes, []).count() == 0
