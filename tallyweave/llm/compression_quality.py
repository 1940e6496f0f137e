"""Quality classifier: how much better does a text compress beside good text than beside bad text?

Two zstandard dictionaries are built from good and from bad labelled text. Every whole text is
compressed with each; the normalised difference of the two sizes, with the sizes per byte beside it,
goes through a logistic calibration fitted on labelled texts that built neither dictionary.

Null texts count as empty; an empty text has features 0 and so the score of the calibration's
intercept at that point. Repeated rows, ties and other columns play no part: rows are scored one by
one. An empty table gives no rows. With labels of one kind only (or none) there is nothing to
separate, and every score is that share of good labels (0.5 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.inputs import held_out, training_sample, with_column_type


@dataclass(frozen=True)
class CompressionQuality:
    """Both dictionaries and the calibration; small, so it travels with the tasks."""

    good: bytes
    bad: bytes
    level: int
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()  # the last one is the intercept


def build_dictionary(texts: list[str], size: int, level: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    pieces = [raw[i: i + 4096] for raw in (t.encode() for t in texts) for i in range(0, len(raw), 4096)]
    try:
        return zstandard.train_dictionary(size, pieces, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def compressors(model: CompressionQuality) -> list[zstandard.ZstdCompressor]:
    made = []
    for raw in (model.good, model.bad):
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        words = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        words.precompute_compress(level=model.level)
        made.append(zstandard.ZstdCompressor(level=model.level, dict_data=words, write_dict_id=False, write_content_size=False))
    return made


def features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, ...]:
    """The size difference by size and by length, both sizes by length, and their products."""
    n = len(text)
    if not n:
        return (0.0,) * 7
    a, b = len(good.compress(text)), len(bad.compress(text))
    by_size, by_length, per_a = (b - a) / max(a, b), (b - a) / n, min(a / n, 1.5)
    return by_size, by_length, per_a, per_a * per_a, math.log(per_a + 0.01), by_size * per_a, math.log(n)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = logistic(x @ w)
        slope = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", *, per_label: int = 4000,
    longest: int = 50_000, dictionary_bytes: int = 1 << 17, level: int = 3,
) -> CompressionQuality:
    """Learn from at most ``per_label`` texts of each label (see :func:`training_sample`).

    Two thirds of each label's texts build its dictionary, the rest fit the calibration.
    """
    sample = training_sample(docs, labels, label, per_label, longest)
    by = {v: [t for t, w in sample if w == v] for v in (0, 1)}
    part = {v: [t for i, t in enumerate(by[v]) if i % 3] for v in by}
    rest = [(t, v) for v in by for i, t in enumerate(by[v]) if i % 3 == 0]
    if not by[0] or not by[1] or len({v for _, v in rest}) < 2:
        share = len(by[1]) / len(sample) if sample else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        return CompressionQuality(b"", b"", level, (0.0,) * 7, (1.0,) * 7, (0.0,) * 7 + (math.log(share / (1 - share)),))
    raw = CompressionQuality(*(build_dictionary(part[v] or by[v], dictionary_bytes, level) for v in (1, 0)), level)
    pair = compressors(raw)
    x = np.array([features(t.encode(), *pair) for t, _ in rest])
    y = np.array([v for _, v in rest], float)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    w = fit_logistic((x - centre) / scale, y)
    return CompressionQuality(raw.good, raw.bad, level, tuple(centre), tuple(scale), tuple(w))


def score_quality(docs: DataFrame, model: CompressionQuality, column: str = "quality_score") -> DataFrame:
    """``docs`` with a score in 0..1 for every whole text, higher where label 1 is likelier.

    A column of that name is replaced.
    """
    docs = docs.drop(column)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model)
        centre, scale, w = map(np.array, (model.centre, model.scale, model.weights))
        for batch in batches:
            x = np.array([features((t.as_py() or "").encode(), *pair) for t in batch.column(at)]).reshape(-1, len(centre))
            p = logistic((x - centre) / scale @ w[:-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, column])

    return docs.mapInArrow(score, with_column_type(docs, column))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit_quality(docs, labels, **fit)
    return score_quality(docs.select("doc_id", "text"), model, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
