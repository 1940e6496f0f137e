"""Line dedup, centroid clusters and phrase automata beside brute force, and on awkward rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import jaccard_regions, line_dedup, phrase_automata, queries, source_mixing, threshold_clusters
from tallyweave.llm.inputs import table
from tests.compare import difference
from tests.llm.test_operators import BASE, LONG, NEAR, SCHEMA, SF_DIR

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_threshold_clusters", "op12_line_dedup", "op13_phrase_automata"])
def test_queries_equal_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), queries.SQL[name], SF_DIR) is None


# ---- lines


def brute_lines(texts, documents, least):
    lines = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in own] for own in lines]
    held = collections.Counter(k for own in keys for k in set(own) if len(k) >= least)
    kept = [[x for x, k in zip(own, key) if not (len(k) >= least and held[k] >= documents)] for own, key in zip(lines, keys)]
    return [("\n".join(k), len(own), len(own) - len(k)) for own, k in zip(lines, kept)]


@pytest.mark.parametrize("room", [0, 1_000_000])
@pytest.mark.parametrize("documents, least", [(2, 1), (3, 4), (1, 1)])
def test_lines_equal_brute_force(spark, monkeypatch, room, documents, least):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", room)
    rng = random.Random(3)
    lines = ["", " ", "Same line", "same LINE\t", "\x0bsame line", "ÄRGER", "ärger", "x", "abcd", " abcd", "other"] + [f"own {i}" for i in range(40)]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(9))) for _ in range(120)]
    texts += [None, "", "\n", "\n\n", "Same line", "Same line\n", "\n".join(f"long {i % 700}" for i in range(20_000))] + [texts[0]] * 30
    rows = [(None if i % 9 == 0 else i % 50, t, i, "d", "l") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, i long, dropped string, n_lines string").repartition(5)
    found = line_dedup.drop_shared_lines(docs, documents=documents, least=least).collect()
    wanted = brute_lines(texts, documents, least)
    assert {r.i: (r.text, r.n_lines, r.n_dropped) for r in found} == dict(enumerate(wanted)) and len(found) == len(texts)
    assert {(r.i, r.doc_id, r.dropped) for r in found} == {(r[2], r[0], "d") for r in rows}


def test_lines_of_an_empty_table(spark):
    assert line_dedup.drop_shared_lines(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- clusters


def brute_clusters(rows, k, rounds, dims, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v in kept:
            held[place(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*held[j])] if held[j] else c for j, c in enumerate(centroids)]
    return sorted(((str(i), place(v)[1], min(place(v)[0], (1 << 63) - 1)) for i, v in kept)), centroids


@pytest.mark.parametrize("kind", ["usual", "ties", "huge", "few"])
def test_clusters_equal_brute_force(spark, kind):
    rng, dims = random.Random(4), 5
    draw = {"usual": lambda: rng.gauss(0, 1), "ties": lambda: rng.randrange(-1, 2) / 1024, "few": lambda: rng.gauss(0, 1),
            "huge": lambda: rng.choice([1.0, -3e30, 2e38, 1e-300])}[kind]
    rows = [(i, [draw() for _ in range(dims)]) for i in range(3 if kind == "few" else 300)]
    rows += [(None, [draw() for _ in range(dims)]), (7, rows[0][1]), (7, rows[0][1]), (8, None), (9, []), (10, [1.0] * 4), (11, [1.0] * 6),
             (12, [float("nan")] * 5), (13, [1.0, None, 1.0, 1.0, 1.0]), (14, [float("inf")] * 5)]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    placed, centroids = threshold_clusters.cluster_vectors(vectors, dims=dims, k=6, rounds=4)
    wanted, middle = brute_clusters(rows, 6, 4, dims)
    assert centroids == middle
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in placed.collect()) == wanted
    report = threshold_clusters.cluster_report(vectors, dims=dims, k=6, rounds=4).collect()
    inertia = collections.Counter()
    for _, cluster, distance in wanted:
        inertia[cluster] += distance
    for r in report:
        assert (r.cluster_inertia, r.inertia) == tuple(min(x, (1 << 63) - 1) for x in (inertia[r.cluster], sum(inertia.values())))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_clusters_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert threshold_clusters.cluster_report(none).count() == 0
    assert threshold_clusters.cluster_report(spark.createDataFrame([(1, [1.0])], none.schema)).count() == 0


def test_the_search_stops_before_it_has_seen_all_centroids():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (200, 3))
    v = rng.integers(-1000, 1000, (500, 3))
    label, best, taken = threshold_clusters.nearest(v, centroids)
    distance = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (label == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()
    assert taken < 0.5 * distance.size


# ---- phrases


def brute_phrases(rows, least, covered=80, top=2000):
    f, n, longer, out = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, tuple(words[i: i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, g), a in candidates.items():
        for size in range(2, len(g)):
            for i in range(len(g) - size + 1):
                longer[lang, g[i: i + size]] = max(longer[lang, g[i: i + size]], a)
    for (lang, g), a in candidates.items():
        if 100 * longer[lang, g] < covered * a:
            score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
            out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, own in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1))


SMALL = dict(range_bytes=2_000, shard_words=500, asked=50)


@pytest.mark.parametrize("limits, room", [({}, 4_000_000), (SMALL, 4_000_000), (SMALL | {"hop": 3}, 0)])
def test_phrases_equal_brute_force(spark, monkeypatch, limits, room):
    monkeypatch.setattr(phrase_automata, "BROADCAST_WORDS", room)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["Hot"] * 20 + ["é", "É", "日本", "a" * 200, "b" * 64 + "x", "b" * 64 + "y", "a-b", "x\x00y"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", " \x0b", " ?!", ";"]
    rows = []
    for i in range(150):
        said = "".join(rng.choice(words) + rng.choice(marks[:3] * 5 + marks) for _ in range(rng.randrange(120)))
        rows.append((i % 40 or None, said + " new york city hall" * (i % 4), rng.choice(["en", "en", "en", "d e,\n", "", None, "und"])))
    rows += [(1, None, "en"), (2, "", "en"), (3, " .,; ", "fr"), (4, "one", "fr"), (5, "hot " * 3000, "en")] + [rows[5]] * 40
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    found = phrase_automata.collocations(docs, least=8, top=60, **limits).collect()
    wanted = brute_phrases([(r[2], r[1]) for r in rows], 8, top=60)
    assert sorted(map(tuple, found)) == wanted and len(wanted) > 100


def test_long_texts_are_read_in_chunks(spark, monkeypatch):
    text = LONG[:2_300_000] + " " + "z" * 1_200_000 + " " + LONG[:50_000]
    whole = brute_phrases([("en", text)], 200)
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    assert sorted(map(tuple, phrase_automata.collocations(docs, least=200).collect())) == whole


def test_phrases_of_an_empty_table(spark):
    assert phrase_automata.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrase_automata.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_automata_round_trip_and_unite():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 40, 4000).astype(np.uint64) * np.uint64(1 << 58)
    pieces, langs = np.sort(rng.integers(0, 300, 4000)), np.sort(rng.integers(1, 4, 4000).astype(np.uint64))

    def counts(windows):
        names = [windows.langs, *[windows.vocabulary] * 4]
        columns = [n[c.astype(np.int64)].tolist() for n, c in zip(names, windows.columns())]
        return dict(zip(zip(*columns), windows.counts.tolist()))

    all_ = phrase_automata.Windows.of_words(words, pieces, langs, 4000)
    assert sum(counts(all_).values()) == (pieces[1:] == pieces[:-1]).sum()
    limits = np.array(sorted(counts(all_))[100::333], np.uint64)
    blobs = [b for _, b in all_.stretches(limits)]
    assert len(blobs) == len(limits) + 1
    assert counts(phrase_automata.united(blobs)) == counts(all_)
    assert counts(phrase_automata.united(blobs + blobs)) == {k: 2 * v for k, v in counts(all_).items()}
    r, last = list(all_.stretches(limits))[-1]
    assert r == len(limits) and min(counts(phrase_automata.united([last]))) == tuple(limits[-1].tolist())


def test_words_of_one_symbol_are_noticed():
    reader = phrase_automata.Reader(1)
    reader.table[:] = 0
    list(reader.read(pa.array(["same same"]), {}))
    assert not reader.clash
    list(reader.read(pa.array(["this that"]), {}))
    assert reader.clash
    told = [phrase_automata.pack_words(b"en", [w], np.array([5]), w == b"b") for w in (b"a", b"b")]
    assert set(phrase_automata.told_words(told[:1], 1, 1)["clash"].to_pylist()) == {False}
    assert set(phrase_automata.told_words(told, 1, 1)["clash"].to_pylist()) == {True}
    assert set(phrase_automata.told_words(told, 99, 1)["clash"].to_pylist()) == {True}


# ---- the pipeline's stages


def test_one_of_each_with_null_and_repeated_ids(spark):
    rows = [(None, BASE), (None, NEAR), (7, BASE + " a"), (7, BASE + " b"), (7, BASE + " b"), (9, "x y"), (9, "x y"), (None, "lone text"), (5, ""), (6, None)]
    docs = spark.createDataFrame([(*r, 3, "c", 1, 2) for r in rows], "doc_id long, text string, times int, check string, component int, stays int")
    kept = jaccard_regions.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert [d for d, _ in found] == ["5", "6", "7", "9", "None"] and found[-1][1] == "lone text"
    only_null = jaccard_regions.one_of_each(docs.where("doc_id IS NULL")).collect()
    assert len(only_null) == 2


@pytest.mark.parametrize("room", [0, 2_000_000])
def test_mixing_with_weight_zero_and_null_ids(spark, monkeypatch, room):
    monkeypatch.setattr(source_mixing, "BROADCAST_ROWS", room)
    monkeypatch.setattr(source_mixing, "COPIES_AT_ONCE", 4)
    rows = [(None, BASE, "en", "src1")] * 30 + [(None, NEAR, "en", "src1")] * 30 + [(3, BASE, "de", "src7")] * 10
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, copies int, rows int").repartition(4)
    levels = source_mixing.mix_levels()
    mixed = source_mixing.mixed_documents(docs, levels, {"language": {"de": 0}}, (3, 5))
    assert mixed.columns == docs.columns
    taken = collections.Counter(r.lang for r in mixed.collect())
    assert taken == {"en": 42}
    assert source_mixing.mixed_documents(docs, levels, {"domain": {"domain0": 0, "domain1": 0}}, (3, 5)).count() == 0
