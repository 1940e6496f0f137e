"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its hashed byte n-grams (A-Z lower-cased). An n-gram's value is its
log-count ratio r between toxic and other labelled texts; a ridge logistic regression on those
values gives the weights, so a text's score needs one number, r * w, for each n-gram it holds.

Null texts count as empty; a text without n-grams scores the intercept. Rows are scored one by one:
repeats, ties and other columns play no part, and an empty table gives no rows. With labels of one
kind only (or none) every score is that share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.inputs import held_out, row_chunks, text_bytes, training_sample, with_column_type

BITS = 18
SIZES = (3, 4, 5)


@dataclass(frozen=True)
class NgramModel:
    """One weight for each of 2^BITS hashed n-grams, and the intercept; 1 MB."""

    weights: np.ndarray
    intercept: float


def ngram_cells(data: np.ndarray) -> list[np.ndarray]:
    """For each n-gram size, the cell of the n-gram that begins at each byte."""
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    wide = lower.astype(np.uint64)
    out = []
    for size in SIZES:
        n = max(len(data) - size + 1, 0)
        packed = np.full(n, size, np.uint64)
        for k in range(size):
            packed = (packed << np.uint64(8)) | wide[k: k + n]
        out.append(((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def row_cells(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct cells of each row, in no particular order."""
    data, offsets = text_bytes(texts)
    last = np.zeros(1 << BITS, np.int64)
    for i, j in row_chunks(offsets):
        start = int(offsets[i])
        cells = ngram_cells(data[start: int(offsets[j])])
        for a, b in zip((offsets[i:j] - start).tolist(), (offsets[i + 1: j + 1] - start).tolist()):
            own = np.concatenate([c[a: max(b - size + 1, a)] for size, c in zip(SIZES, cells)])
            order = np.arange(len(own))
            last[own] = order  # the last of equal cells stays, so it alone reads itself back
            yield own[last[own] == order]


def fit_ngrams(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", *, per_label: int = 2000, longest: int = 20_000,
    smoothing: float = 1.0, ridge: float = 2e-4, rounds: int = 40,
) -> NgramModel:
    """Learn from at most ``per_label`` texts of each label (see :func:`training_sample`)."""
    sample = training_sample(docs, labels, label, per_label, longest)
    y = np.array([v for _, v in sample], float)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 1e-9), 1 - 1e-9) if len(y) else 0.5
        return NgramModel(np.zeros(1 << BITS, np.float32), math.log(share / (1 - share)))
    cells = list(row_cells(pa.array([t for t, _ in sample], pa.large_string())))
    sizes = np.array([len(c) for c in cells])
    cells = np.concatenate(cells)
    rows = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    toxic = np.repeat(y, sizes)
    p = smoothing + np.bincount(cells, weights=toxic, minlength=1 << BITS)
    q = smoothing + np.bincount(cells, weights=1 - toxic, minlength=1 << BITS)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = ratio[cells]
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    # Nesterov's method; the step is bounded by the largest curvature, estimated by power iteration
    v = np.ones(1 << BITS) / (1 << (BITS // 2))
    for _ in range(5):
        u = np.bincount(rows, weights=values * v[cells], minlength=len(y)) * weight
        v = np.bincount(cells, weights=values * u[rows], minlength=1 << BITS)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1.0 / (0.3 * top + ridge + 1e-9)
    w = ahead = np.zeros(1 << BITS)
    b = ahead_b = 0.0
    for k in range(rounds):
        z = np.bincount(rows, weights=values * ahead[cells], minlength=len(y)) + ahead_b
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        new = ahead - step * (np.bincount(cells, weights=values * slope[rows], minlength=1 << BITS) + ridge * ahead)
        new_b = ahead_b - 4 * float(slope.sum())
        pull = k / (k + 3)
        ahead, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return NgramModel((ratio * w).astype(np.float32), b)


def score_ngrams(docs: DataFrame, model: NgramModel, column: str = "toxic_score") -> DataFrame:
    """``docs`` with a score in 0..1 for every whole text. A column of that name is replaced."""
    docs = docs.drop(column)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([float(model.weights[c].sum(dtype=np.float64)) for c in row_cells(batch.column(at))]) + model.intercept
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(score, with_column_type(docs, column))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit_ngrams(docs, labels, **fit)
    return score_ngrams(docs.select("doc_id", "text"), model, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
