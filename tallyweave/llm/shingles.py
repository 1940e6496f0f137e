"""Word shingles of whole Arrow text columns as 64-bit hashes, vectorised with numpy.

A word is a run of characters other than blank and ``\\x09``-``\\x0D``; A-Z are lower-cased. A
document's shingles are its distinct runs of ``width`` words; a shorter document with at least one
word has its whole word sequence as its one shingle. Null and empty texts have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyweave.llm.inputs import CHUNK_BYTES, row_chunks, text_bytes

BASE = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = _powers(BASE, CHUNK_BYTES + 1), _powers(INVERSE, CHUNK_BYTES + 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of some rows, and the number of words before each row and after the last."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = (UP, DOWN) if n <= CHUNK_BYTES else (_powers(BASE, n), _powers(INVERSE, n))
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start, stop = ~gap, ~gap
    start[1:] &= gap[:-1] | first[1:]
    stop[:-1] &= gap[1:] | first[1:]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def long_row_words(data: np.ndarray) -> np.ndarray:
    """The word hashes of one row longer than a chunk, cut at word ends."""
    out, first = [], 0
    while first < len(data):
        last = first + CHUNK_BYTES
        if last < len(data):
            near = data[first: last]
            gaps = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
            while not len(gaps) and last < len(data):  # one word longer than the chunk
                near = data[last: last + CHUNK_BYTES]
                gaps = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13))) + (last - first)
                last += CHUNK_BYTES
            last = first + int(gaps[-1]) + 1 if len(gaps) else len(data)
        piece = data[first: last]
        out.append(word_hashes(piece, np.array([0, len(piece)]))[0])
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, by the run's first word."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = mix(out * np.uint64(BASE) + words[k: k + n])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = text_bytes(texts)
    out = []
    for i, j in row_chunks(offsets):
        own = offsets[i: j + 1] - offsets[i]
        if own[-1] > CHUNK_BYTES:
            words = long_row_words(data[offsets[i]: offsets[j]])
            before = np.array([0, len(words)])
        else:
            words, before = word_hashes(data[offsets[i]: offsets[j]], own)
        runs = run_hashes(words, width)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= width:
                out.append(distinct(runs[a: b - width + 1]))
            else:
                out.append(run_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
