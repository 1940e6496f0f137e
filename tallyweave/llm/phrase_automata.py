"""Phrase collocations from weighted acyclic automata over word windows.

Every word of a text begins one window: its language, itself and up to three words after it inside its piece. The
count of a phrase is the number of windows that it begins, so one weighted automaton over windows holds the counts of
all phrases.

* Single words are counted first, then pairs, then longer phrases. No phrase that counts holds a word or a pair below
  the threshold, so while those that reach it can be broadcast, windows end where another comes. Beyond that they
  are not cut; the result is the same.
* A task reads texts into *shards* of a bounded number of words. A shard's windows are sorted and summed, cut at the
  limits of prefix ranges, and each stretch becomes an acyclic automaton: states are shared from the end
  inwards where a single arc with one label and one weight (or target) leads on, final arcs carry the counts.
* A *prefix range* is an interval of whole windows, not of first words: however common a word or a phrase is, it
  is spread over as many ranges as it needs, and equal windows of a shard are one path. A range's task unites the
  automata of all shards and sums weights of equal paths. What lies wholly inside the range is then complete and is
  cut at the threshold; the prefixes at both ends, at most five each, are summed over the ranges after that.
* *Part lookups* compose candidates with count transducers: the requests for parts go to the range that holds
  the part, where they walk the transducer of its counted phrases symbol by symbol, all at once. Ranges that are
  asked much are copied to several tasks and their requests dealt out among those.

Symbols are 64-bit hashes by random tables. Two words with one symbol would be one word, so the words behind each
symbol are compared, byte by byte in each chunk of text and over all shards; on any clash everything is done again
with other tables. Range limits come from a sample of windows, bounded by the number of ranges: they settle the
balance of the work and never the result.

Null texts are empty. A null language is ``und``. Every row counts, repeated ones too. Words may be of any length; long
texts are read in chunks. Other columns are ignored. A table without words gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.inputs import row_chunks, text_bytes
from tallyweave.llm.shingles import mix
from tallyweave.operators.exact import top_per_group
from tallyweave.sources.scratch import materialize

#: Words of a window, the longest phrase.
WORDS = 4
#: Bytes of text that are cut into words at once.
CHUNK_BYTES = 1 << 18
#: Words, and pairs of words, of eight bytes each that are sent to all executors at most, to end windows at rarer ones.
BROADCAST_WORDS = 4_000_000
#: Words that a shard holds before it is sorted and sent.
SHARD_WORDS = 1_000_000
#: Bytes of text behind one prefix range.
RANGE_BYTES = 16 << 20
#: Ranges that a shard is cut into at most; beyond, shards go to that many wide ranges, where groups of them are cut again.
HOP = 4_096
#: Sampled documents for each range, 2000 in all at least, and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2, 16
#: Part lookups that one task answers.
ASKED = 1_000_000

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEVELS = [f"w{i}" for i in range(1, WORDS + 1)]
PATH = ["lang", *LEVELS]


# ---- texts to words


class Reader:
    """Words of texts as symbols, with the piece that each is in."""

    def __init__(self, seed: int):
        self.table = np.random.default_rng(seed).integers(1, 1 << 64, (64, 256), np.uint64)
        self.pieces = 0
        self.clash = False

    def words(self, data: np.ndarray, offsets: np.ndarray, texts: dict[int, bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, piece and row of each word. ``texts``, if given, learns the word of each symbol, and words of one symbol are compared."""
        kind, lower = KIND[data], LOWER[data]
        letter = kind == 0
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        starts = np.flatnonzero(letter & np.concatenate(([True], first[1:-1] | ~letter[:-1])))
        stops = np.flatnonzero(letter & np.concatenate((first[1:-1] | ~letter[1:], [True]))) + 1
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = stops - starts
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.flatnonzero(letter)
        inside = np.arange(len(at)) - np.repeat(begins, sizes)
        own = lower[at]
        value = self.table[inside & 63, own]
        late = inside >> 6
        if late.any():
            value = np.where(late > 0, mix(value + late.astype(np.uint64)), value)
        symbols = mix(np.add.reduceat(value, begins) ^ sizes.astype(np.uint64)) | np.uint64(1)
        if texts is not None:
            unique, sample, place = np.unique(symbols, return_index=True, return_inverse=True)
            if (sizes != sizes[sample][place]).any():
                self.clash = True
            elif (own != lower[np.repeat(starts[sample][place], sizes) + inside]).any():
                self.clash = True
            for symbol, a, z in zip(unique.tolist(), starts[sample].tolist(), stops[sample].tolist()):
                word = lower[a:z].tobytes()
                self.clash |= texts.setdefault(symbol, word) != word
        rows = np.searchsorted(offsets, starts, "right") - 1
        pieces = self.pieces + np.cumsum(kind == 2)[starts] + rows
        return symbols, pieces, rows

    def read(self, column: pa.Array, texts: dict[int, bytes] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Symbols, pieces and rows, chunk by chunk; a long text is cut between words."""
        data, offsets = text_bytes(column)
        for i, j in row_chunks(offsets, CHUNK_BYTES):
            end = int(offsets[j])
            at = int(offsets[i])
            while at < end:
                stop = end
                if end - at > CHUNK_BYTES:  # one long text
                    stop = at + CHUNK_BYTES
                    near = np.flatnonzero(KIND[data[at:stop]])
                    while not len(near) and stop < end:  # a word longer than a chunk
                        near = np.flatnonzero(KIND[data[stop: stop + CHUNK_BYTES]]) + (stop - at)
                        stop = min(stop + CHUNK_BYTES, end)
                    stop = at + int(near[-1]) + 1 if len(near) and stop < end else stop
                part = data[at:stop]
                limits = np.clip(offsets[i: j + 1], at, stop) - at
                symbols, pieces, rows = self.words(part, limits, texts)
                yield symbols, pieces, rows + i
                self.pieces += int((KIND[part] == 2).sum()) + (j - i if stop == end else 0)
                at = stop


def language_symbol(lang: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little") | 1


def languages(column: pa.Array, seed: int) -> tuple[dict[int, bytes], np.ndarray]:
    """The languages of a batch by symbol, and the symbol of each row's."""
    spoken = column.dictionary_encode()
    names = [x.encode() for x in spoken.dictionary.to_pylist()]
    codes = [language_symbol(x, seed) for x in names]
    return dict(zip(codes, names)), np.array(codes, np.uint64)[spoken.indices.to_numpy()] if names else np.zeros(0, np.uint64)


def word_key(langs: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """One number for a word of a language. Where two agree, windows are only cut less."""
    return mix(symbols ^ mix(langs))


def pair_key(langs: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(word_key(langs, first) + second)


def listed(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys if len(wanted) else np.zeros(len(keys), bool)


@dataclass(frozen=True)
class Usual:
    """Sorted keys of the words and of the pairs that can be in a phrase that counts; None where they are too many."""

    words: np.ndarray | None = None
    pairs: np.ndarray | None = None

    def cut(self, symbols: np.ndarray, pieces: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The usual words, with pieces that end at any other word or pair, and how many pieces were ended so."""
        ended = 0
        if self.words is not None:
            keep = listed(word_key(langs, symbols), self.words)
            pieces = (pieces + np.cumsum(~keep))[keep]
            symbols, langs, ended = symbols[keep], langs[keep], int((~keep).sum())
        if self.pairs is not None and len(symbols) > 1:
            strange = np.zeros(len(symbols), bool)
            strange[1:] = ~listed(pair_key(langs[:-1], symbols[:-1], symbols[1:]), self.pairs)
            pieces = pieces + np.cumsum(strange)
            ended += int(strange.sum())
        return symbols, pieces, langs, ended


# ---- windows and automata


class Windows:
    """Sorted different windows with counts; each is two numbers made of the ranks of its symbols."""

    def __init__(self, langs: np.ndarray, vocabulary: np.ndarray, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        self.langs, self.vocabulary, self.high, self.low, self.counts = langs, vocabulary, high, low, counts

    @staticmethod
    def bits(vocabulary: np.ndarray) -> np.uint64:
        return np.uint64(max(1, len(vocabulary).bit_length()))

    @classmethod
    def summed(cls, langs, vocabulary, high, low, counts=None) -> Windows:
        """Equal windows put together; without ``counts`` each counts once."""
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(new)
        if counts is None:
            counts = np.diff(np.append(at, len(high)))
        elif len(at):
            counts = np.add.reduceat(counts[order], at)
        return cls(langs, vocabulary, high[at], low[at], counts)

    @classmethod
    def of_words(cls, symbols: np.ndarray, pieces: np.ndarray, langs: np.ndarray, starts: int, least: int = 2, most: int = WORDS) -> Windows:
        """Of the windows of ``least`` words or more, cut at ``most``, that the first ``starts`` words begin."""
        vocabulary, ids = np.unique(np.append(symbols, np.uint64(0)), return_inverse=True)
        named, lang = np.unique(langs, return_inverse=True)
        b = cls.bits(vocabulary)
        ids, high = ids[:-1].astype(np.uint32), lang[:starts].astype(np.uint64)
        low = np.zeros(starts, np.uint64)
        for k in range(WORDS):
            n = max(0, min(starts, len(ids) - k))
            number = high if k < 2 else low
            number <<= b
            if k >= most:
                continue
            number[:n] |= np.where(pieces[k: k + n] == pieces[:n], ids[k: k + n], 0).astype(np.uint64)
        last = [high >> b, high, low >> b, low][least - 1]
        several = (last & ((np.uint64(1) << b) - np.uint64(1))) > 0
        return cls.summed(named, vocabulary, high[several], low[several])

    def columns(self, part: slice = slice(None)) -> list[np.ndarray]:
        b = self.bits(self.vocabulary)
        mask = (np.uint64(1) << b) - np.uint64(1)
        high, low = self.high[part], self.low[part]
        return [high >> (b + b), (high >> b) & mask, high & mask, low >> b, low & mask]

    def cuts(self, limits: np.ndarray) -> np.ndarray:
        """How many windows come before each limit, a window given by its symbols."""
        b = self.bits(self.vocabulary)
        ranks, exact = [], np.ones(len(limits), bool)
        for k in range(WORDS + 1):
            known = self.langs if k == 0 else self.vocabulary
            rank = np.searchsorted(known, limits[:, k])
            ranks.append(np.where(exact, rank, 0).astype(np.uint64))
            exact &= known[np.minimum(rank, len(known) - 1)] == limits[:, k]
        high = ((ranks[0] << b) | ranks[1]) << b | ranks[2]
        low = ranks[3] << b | ranks[4]
        left, right = np.searchsorted(self.high, high, "left"), np.searchsorted(self.high, high, "right")
        return np.array([p + np.searchsorted(self.low[p:q], x) for p, q, x in zip(left, right, low)], np.int64)

    def stretches(self, limits: np.ndarray, base: int = 0) -> Iterator[tuple[int, bytes]]:
        """The range number and the packed automaton of each stretch between limits that has windows."""
        cuts = [0, *self.cuts(limits).tolist(), len(self.high)]
        for r, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            if z > a:
                yield base + r, automaton(self.langs, self.vocabulary, self.columns(slice(a, z)), self.counts[a:z])


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def pack(arrays: list[np.ndarray]) -> bytes:
    head = ",".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(head + b"\n" + b"".join(a.tobytes() for a in arrays))


def unpack(payload: bytes) -> list[np.ndarray]:
    head, _, body = zstandard.ZstdDecompressor().decompress(payload).partition(b"\n")
    out, at = [], 0
    for told in head.decode().split(","):
        kind, n = np.dtype(told[:3]), int(told[3:])
        out.append(np.frombuffer(body, kind, n, at))
        at += n * kind.itemsize
    return out


def automaton(langs: np.ndarray, vocabulary: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """The packed automaton of sorted different paths: symbols, and from the last level inwards fans, labels and values.

    A value is the count on the last level, the target state on the others. States that have one arc are
    stored once for each (label, value), behind the others.
    """
    used = np.unique(np.concatenate([np.unique(c) for c in columns[1:]]))
    level, own_langs = [columns[0], *(np.searchsorted(used, c) for c in columns[1:])], np.unique(columns[0])
    level[0] = np.searchsorted(own_langs, columns[0])
    new, changed = [], np.zeros(len(counts), bool)
    changed[0] = True
    for column in level:
        changed = changed.copy()
        changed[1:] |= column[1:] != column[:-1]
        new.append(changed)
    out, value = [langs[own_langs.astype(np.int64)], vocabulary[used.astype(np.int64)]], counts
    for depth in range(WORDS, -1, -1):
        nodes = np.flatnonzero(new[depth])
        label = level[depth][nodes]
        first = np.flatnonzero(new[depth - 1][nodes]) if depth else np.zeros(1, np.int64)
        fan = np.diff(np.append(first, len(nodes)))
        lone = (fan == 1) & (value[first] < 1 << 32)
        arcs = np.repeat(~lone, fan)
        key, state = np.unique(label[first[lone]].astype(np.uint64) << np.uint64(32) | value[first[lone]].astype(np.uint64), return_inverse=True)
        out += [
            narrow(fan[~lone]), narrow(np.concatenate([label[arcs].astype(np.int64), (key >> np.uint64(32)).astype(np.int64)])),
            narrow(np.concatenate([value[arcs], (key & np.uint64(0xFFFFFFFF)).astype(np.int64)]))]
        value = np.empty(len(first), np.int64)
        value[~lone] = np.arange((~lone).sum())
        value[lone] = (~lone).sum() + state
    return pack(out)


def paths(arrays: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The paths of an unpacked automaton, as places of symbols level by level, and their counts."""
    levels = [arrays[k: k + 3] for k in range(2, len(arrays), 3)][::-1]
    columns, states = [], np.zeros(1, np.int64)  # the one state of the first level
    for fan, label, value in levels:
        fan = fan.astype(np.int64)
        n, arcs = np.append(fan, 1), np.append(np.concatenate(([0], np.cumsum(fan)))[:-1], 0)
        several = states < len(fan)
        many = n[np.where(several, states, len(fan))]
        start = np.where(several, arcs[np.where(several, states, len(fan))], fan.sum() + states - len(fan))
        above = np.repeat(np.arange(len(states)), many)
        arc = np.repeat(start - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(above))
        columns = [*(c[above] for c in columns), label[arc]]
        states = value[arc].astype(np.int64)
    return columns, states


def united(payloads: list[bytes]) -> Windows:
    """The union of automata, weights of equal paths summed."""
    unpacked = [unpack(p) for p in payloads]
    langs = np.unique(np.concatenate([u[0] for u in unpacked]))
    vocabulary = np.unique(np.concatenate([np.zeros(1, np.uint64), *(u[1] for u in unpacked)]))
    b = Windows.bits(vocabulary)
    high, low, counts = [], [], []
    for arrays in unpacked:
        columns, count = paths(arrays)
        lang, word = np.searchsorted(langs, arrays[0]).astype(np.uint64), np.searchsorted(vocabulary, arrays[1]).astype(np.uint64)
        c = [word[column] for column in columns[1:]]
        high.append(((lang[columns[0]] << b) | c[0]) << b | c[1])
        low.append(c[2] << b | c[3])
        counts.append(count)
    return Windows.summed(langs, vocabulary, np.concatenate(high), np.concatenate(low), np.concatenate(counts))


# ---- counting


GRAMS = "lang long, w1 long, w2 long, w3 long, w4 long, size int, f long, word string, clash boolean"
GRAM_TYPES = pa.schema([(c, pa.int64()) for c in PATH] + [
    ("size", pa.int32()), ("f", pa.int64()), ("word", pa.string()), ("clash", pa.bool_())])


def pack_words(lang: bytes, words: list[bytes], counts: np.ndarray, clash: bool) -> bytes:
    """Words hold no blank, so blanks part them."""
    return pack([np.frombuffer(lang, np.uint8), np.frombuffer(b" ".join(words), np.uint8), narrow(counts), np.array([clash])])


def told_words(payloads: list[bytes], threshold: int, seed: int) -> pa.Table:
    """Words that reach the threshold, the words of each language in all (size 0), and whether a symbol has several words."""
    counts: dict[tuple[bytes, bytes], int] = {}
    totals: dict[bytes, int] = {}
    clash = False
    for payload in payloads:
        lang, said, n, clashed = unpack(payload)
        clash |= bool(clashed[0])
        lang, n = lang.tobytes(), n.tolist()
        totals[lang] = totals.get(lang, 0) + sum(n)
        for word, count in zip(said.tobytes().split(b" "), n):
            counts[lang, word] = counts.get((lang, word), 0) + count
    words = list({word for _, word in counts})
    said = np.frombuffer(b" ".join(words), np.uint8)
    symbols, _, _ = Reader(seed).words(said, np.array([0, len(said)]))
    clash |= len(np.unique(symbols)) < len(words)
    names = dict(zip(words, symbols.view(np.int64).tolist()))
    code = {lang: int(np.uint64(language_symbol(lang, seed)).view(np.int64)) for lang in totals}
    rows = [(code[lang], names[word], 1, n, word) for (lang, word), n in counts.items() if n >= threshold]
    rows += [(code[lang], 0, 0, n, lang) for lang, n in totals.items()]
    lang, symbol, size, f, word = zip(*rows)
    nothing = pa.array(np.zeros(len(rows), np.int64))
    return pa.Table.from_arrays(
        [pa.array(lang, pa.int64()), pa.array(symbol, pa.int64()), nothing, nothing, nothing, pa.array(size, pa.int32()), pa.array(f, pa.int64()),
         pa.array([w.decode("utf-8", "replace") for w in word]), pa.array(np.full(len(rows), clash))], schema=GRAM_TYPES)


def word_counts(docs: DataFrame, buckets: int, threshold: int, seed: int, shard_words: int) -> DataFrame:
    """Rows of GRAMS: single words with their counts and names, and for each language its words in parts (size 0)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, texts, names, held, size = Reader(seed), {}, {}, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            symbols, langs = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.lexsort((symbols, langs))
            symbols, langs = symbols[order], langs[order]
            new = np.ones(len(symbols), bool)
            new[1:] = (symbols[1:] != symbols[:-1]) | (langs[1:] != langs[:-1])
            at = np.flatnonzero(new)
            counts, symbols, langs = np.diff(np.append(at, len(new))), symbols[at], langs[at]
            bucket = (symbols % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((langs, bucket))
            counts, symbols, langs, bucket = counts[order], symbols[order], langs[order], bucket[order]
            ends = np.flatnonzero(np.append((bucket[1:] != bucket[:-1]) | (langs[1:] != langs[:-1]), True)) + 1
            rows = []
            for a, z in zip([0, *ends[:-1].tolist()], ends.tolist()):
                words = [texts[x] for x in symbols[a:z].tolist()]
                rows.append((int(bucket[a]), pack_words(names[int(langs[a])], words, counts[a:z], reader.clash)))
            held, size = [], 0
            texts.clear()
            for i in range(0, len(rows), 64):
                r, payload = zip(*rows[i: i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(payload, pa.binary())], ["r", "payload"])

        for batch in batches:
            spoken, codes = languages(batch.column(0), seed)
            for symbols, _, rows in reader.read(batch.column(1), texts):
                held.append((symbols, codes[rows]))
                size += len(symbols)
                names |= spoken
                if size > shard_words:
                    yield from flush()
        if size:
            yield from flush()

    def count(group: pa.Table) -> pa.Table:
        return told_words(group["payload"].to_pylist(), threshold, seed)

    return docs.mapInArrow(build, "r int, payload binary").groupBy("r").applyInArrow(count, GRAMS)


def counted_phrases(windows: Windows, threshold: int, least: int) -> pa.Table:
    """Phrases of ``least`` words or more of one range that reach the threshold, and those at its ends, which other ranges may share."""
    columns = windows.columns()
    out = [[] for _ in range(WORDS + 3)]
    changed = np.zeros(len(windows.counts), bool)
    changed[0] = True
    for depth, column in enumerate(columns):
        changed[1:] |= column[1:] != column[:-1]
        if depth < least:  # shorter ones have been counted
            continue
        at = np.flatnonzero(changed)
        f = np.add.reduceat(windows.counts, at)
        keep = f >= threshold
        keep[[0, -1]] = True
        keep &= column[at] != 0  # rank 0 is the end of a piece
        at, f = at[keep], f[keep]
        for k in range(WORDS + 1):
            names = windows.langs if k == 0 else windows.vocabulary
            out[k].append(names[columns[k][at]] if k <= depth else np.zeros(len(at), np.uint64))
        out[-2].append(np.full(len(at), depth, np.int32))
        out[-1].append(f)
    arrays = [np.concatenate(o) for o in out]
    n = len(arrays[-1])
    return pa.Table.from_arrays(
        [*(pa.array(a.view(np.int64)) for a in arrays[: WORDS + 1]), pa.array(arrays[-2]), pa.array(arrays[-1]),
         pa.nulls(n, pa.string()), pa.array(np.zeros(n, bool))], schema=GRAM_TYPES)


def sampled_limits(docs: DataFrame, rows: int, ranges: int, seed: int, usual: Usual) -> np.ndarray:
    """Windows that part all windows in about equal ranges, from sampled documents; they settle balance only."""
    if ranges < 2:
        return np.zeros((0, WORDS + 1), np.uint64)
    sampled = max(2_000, SAMPLE_DOCS * ranges)
    columns = [*PATH, "weight"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seed)
        for batch in batches:
            _, codes = languages(batch.column(0), seed)
            for k in range(batch.num_rows):
                lang = int(codes[k])
                parts = list(reader.read(batch.column(1).slice(k, 1)))
                symbols, pieces = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in (0, 1))
                symbols, pieces, _, _ = usual.cut(symbols, pieces, np.full(len(symbols), lang, np.uint64))
                at = np.unique(np.linspace(0, len(symbols) - 1, min(SAMPLE_WINDOWS, len(symbols))).astype(np.int64)) if len(symbols) else []
                out = [
                    [lang, *(int(symbols[x + d]) if x + d < len(symbols) and pieces[x + d] == pieces[x] else 0 for d in range(WORDS)), -(-len(symbols) // len(at))]
                    for x in at]
                table = np.array(out, np.uint64).reshape(-1, len(columns)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], columns)

    picked = docs.sample(min(1.0, sampled / max(rows, 1)), 7).mapInArrow(pick, ", ".join(f"{c} long" for c in columns)).toArrow()
    sample = np.stack([c.to_numpy() for c in picked.columns], axis=1).view(np.uint64) if picked.num_rows else np.zeros((0, len(columns)), np.uint64)
    sample = sample[np.lexsort(sample[:, WORDS::-1].T)]
    reached = np.cumsum(sample[:, -1].astype(np.float64))
    at = np.searchsorted(reached, reached[-1] * np.arange(1, ranges) / ranges) if len(sample) else []
    return np.unique(sample[at, : WORDS + 1], axis=0) if len(sample) else sample[:, : WORDS + 1]


def phrase_counts(docs: DataFrame, limits: np.ndarray, threshold: int, seed: int, usual: Usual, least: int, most: int,
                  shard_words: int = SHARD_WORDS, hop: int = HOP) -> DataFrame:
    """(PATH, size, f) of the phrases of ``least`` to ``most`` words that reach the threshold. ``docs`` has lang and text."""
    finer = ceil((len(limits) + 1) / hop)
    coarse = limits[finer - 1:: finer]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = Reader(seed), [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            symbols, pieces, langs = (np.concatenate([h[k] for h in held]) for k in range(3))
            starts = len(symbols) if last else len(symbols) - (WORDS - 1)
            rows = list(Windows.of_words(symbols, pieces, langs, starts, least, most).stretches(coarse)) if starts > 0 else []
            held = [(symbols[starts:], pieces[starts:], langs[starts:])]
            size = len(symbols) - starts
            for i in range(0, len(rows), 64):
                r, payload = zip(*rows[i: i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(payload, pa.binary())], ["r", "payload"])

        for batch in batches:
            _, codes = languages(batch.column(0), seed)
            for symbols, pieces, rows in reader.read(batch.column(1)):
                symbols, pieces, langs, ended = usual.cut(symbols, pieces, codes[rows])
                reader.pieces += ended
                held.append((symbols, pieces.astype(np.uint32), langs))  # only neighbours' pieces are compared
                size += len(symbols)
                if size > shard_words:
                    yield from flush(False)
        if held and size:
            yield from flush(True)

    def refine(group: pa.Table) -> pa.Table:
        r = group["r"][0].as_py()
        cut = list(united(group["payload"].to_pylist()).stretches(limits[r * finer: (r + 1) * finer - 1], r * finer))
        return pa.table({"r": pa.array([c[0] for c in cut], pa.int32()), "payload": pa.array([c[1] for c in cut], pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        return counted_phrases(united(group["payload"].to_pylist()), threshold, least)

    blobs = docs.mapInArrow(build, "r int, payload binary")
    if finer > 1:
        group = F.pmod(F.xxhash64("payload"), F.lit(finer)).alias("shards")
        blobs = blobs.select("*", group).groupBy("r", "shards").applyInArrow(refine, "r int, payload binary")
    counted = blobs.groupBy("r").applyInArrow(count, GRAMS)  # those at the ends of ranges come in several rows
    return counted.groupBy(*PATH, "size").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)


def sorted_keys(grams: DataFrame, key, columns: list[str]) -> np.ndarray | None:
    """The keys of ``grams``, where they may be sent to all executors."""
    if grams.count() > BROADCAST_WORDS:
        return None
    return np.sort(key(*(c.to_numpy().view(np.uint64) for c in grams.select(*columns).toArrow().columns)))


# ---- part lookups


class Transducer:
    """Phrases, rows of symbols with 0 beyond their end, walked from the first symbol on to their places among the rows."""

    def __init__(self, rows: np.ndarray):
        self.symbols = np.unique(rows)
        state, self.arcs, self.found = np.zeros(len(rows), np.int64), [], []
        for depth in range(rows.shape[1]):
            live = rows[:, depth] != 0
            key = (state << 32) + np.searchsorted(self.symbols, rows[:, depth])
            arcs = np.unique(key[live])
            state = np.where(live, np.searchsorted(arcs, key), state)
            found = np.full(len(arcs), -1)
            ends = live & (rows[:, depth + 1:] == 0).all(axis=1)
            found[state[ends]] = np.flatnonzero(ends)
            self.arcs.append(arcs)
            self.found.append(found)

    def compose(self, requests: np.ndarray) -> np.ndarray:
        """The place of each requested phrase among the rows, -1 where it isn't one."""
        state, place = np.zeros(len(requests), np.int64), np.full(len(requests), -1)
        alive = np.full(len(requests), len(self.symbols) > 0)
        for depth, (arcs, found) in enumerate(zip(self.arcs, self.found)):
            alive &= requests[:, depth] != 0
            rank = np.searchsorted(self.symbols, requests[:, depth])
            place[alive] = -1
            if not len(arcs):
                break
            key = (state << 32) + rank
            at = np.searchsorted(arcs, key)
            alive &= self.symbols[np.minimum(rank, len(self.symbols) - 1)] == requests[:, depth]
            alive &= arcs[np.minimum(at, len(arcs) - 1)] == key
            state[alive] = at[alive]
            place[alive] = found[at[alive]]
        return place


def sortable(rows: np.ndarray) -> np.ndarray:
    """Rows of symbols as strings of bytes in the same order."""
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * rows.shape[1]}").ravel()


def symbols_in(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).view(np.uint64) \
        if table.num_rows else np.zeros((0, len(names)), np.uint64)


def with_ranges(grams: DataFrame, limits: np.ndarray) -> DataFrame:
    """``grams`` (PATH columns first) with the number ``r`` of the range that each phrase belongs to."""
    borders = sortable(limits)
    schema = T.StructType([*grams.schema.fields, T.StructField("r", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.searchsorted(borders, sortable(symbols_in(batch, PATH)), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], [*batch.schema.names, "r"])

    return grams.mapInArrow(place, schema)


def part_of(first: int, words: int) -> list[Column]:
    """The symbols of ``words`` words of a candidate from its ``first`` on, as PATH columns."""
    return [F.col("lang"), *(F.col(LEVELS[first + k]) if k < words else F.lit(0).cast("long").alias(LEVELS[k]) for k in range(WORDS))]


def parts(candidates: DataFrame, size: int, first: int, words: int, slot: str) -> DataFrame:
    named = [c.alias(n) for c, n in zip(part_of(first, words), PATH)]
    return candidates.where(F.col("size") == size).select(
        *named, F.struct(*PATH, "size", "f").alias("candidate"), F.lit(slot).alias("slot"))


def looked_up(candidates: DataFrame, grams: DataFrame, limits: np.ndarray, asked: int = ASKED) -> DataFrame:
    """(candidate, slot, f, word) for the parts of candidates: ``l1``.. and ``r1``.. by cut, and single words ``w1``.. by place."""
    requests = None
    for size in range(2, WORDS + 1):
        wanted = [(0, k, f"l{k}") for k in range(1, size)] + [(k, size - k, f"r{k}") for k in range(1, size)]
        wanted += [(k, 1, f"w{k + 1}") for k in range(size)]
        for first, words, slot in wanted:
            own = parts(candidates, size, first, words, slot)
            requests = own if requests is None else requests.union(own)
    requests = materialize(with_ranges(requests, limits))
    copies = materialize(requests.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("copies")))  # a row for each range
    dealt = requests.join(copies, "r").withColumn("copy", F.pmod(F.xxhash64("candidate", "slot"), F.col("copies")).cast("int"))
    held = with_ranges(grams, limits).join(copies, "r").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def compose(asking: pa.Table, counted: pa.Table) -> pa.Table:
        place = Transducer(symbols_in(counted, PATH)).compose(symbols_in(asking, PATH))
        at = pa.array(place, mask=place < 0)
        return pa.Table.from_arrays(
            [asking["candidate"], asking["slot"], counted["f"].take(at), counted["word"].take(at)], ["candidate", "slot", "f", "word"])

    path = ", ".join(f"{c}: bigint" for c in PATH)
    return dealt.drop("copies").groupBy("r", "copy").cogroup(held.drop("copies").groupBy("r", "copy")).applyInArrow(
        compose, f"candidate struct<{path}, size: int, f: bigint>, slot string, f long, word string")


# ---- collocations


def uncovered(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer one holds with ``percent`` of their count or more."""
    inner = None
    for size in range(3, WORDS + 1):
        for words in range(2, size):
            for first in range(size - words + 1):
                own = candidates.where(F.col("size") == size).select(
                    *[c.alias(n) for c, n in zip(part_of(first, words), PATH)], F.lit(words).alias("size"),
                    F.lit(None).cast("long").alias("f"), F.col("f").alias("longer"))
                inner = own if inner is None else inner.union(own)
    rows = candidates.select(*PATH, "size", "f", F.lit(None).cast("long").alias("longer")).union(inner)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return (
        rows.groupBy(*PATH, "size").agg(F.max("f").alias("f"), F.max("longer").alias("longer"))
        .where(F.col("f").isNotNull() & (F.col("longer").isNull() | (100 * wide("longer") < percent * wide("f"))))
        .drop("longer"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, covered: int = 80, top: int = 2000,
                 scale: int = 2_000_000, seed: int = 13, range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS, hop: int = HOP, asked: int = ASKED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` collocations of two to four words."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    ranges = ceil((size.bytes or 0) / range_bytes)
    while True:
        words = materialize(word_counts(docs, max(1, min(ranges, hop)), least, seed, shard_words))
        if not words.where("clash").limit(1).count():
            break
        seed += 1
    usual = Usual(sorted_keys(words.where("size = 1"), word_key, ["lang", "w1"]))
    limits = sampled_limits(docs, size.rows, ranges, seed, usual)
    pairs = materialize(phrase_counts(docs, limits, least, seed, usual, 2, 2, shard_words, hop))
    usual = Usual(usual.words, sorted_keys(pairs, pair_key, PATH[:3]))
    phrases = materialize(pairs.union(phrase_counts(docs, limits, least, seed, usual, 3, WORDS, shard_words, hop)))
    candidates = materialize(uncovered(phrases, covered))
    several = phrases.where(F.col("size") < WORDS).select(*PATH, "size", "f", F.lit(None).cast("string").alias("word"))
    single = words.where("size = 1").select(*PATH, "size", "f", "word")
    found = looked_up(candidates, single.union(several), limits, asked)
    at = lambda slot, value: F.max(F.when(F.col("slot") == slot, F.col(value)))
    rows = found.groupBy("candidate").agg(
        *[at(f"{side}{k}", "f").alias(f"{side}{k}") for k in range(1, WORDS) for side in "lr"],
        *[at(f"w{k}", "word").alias(f"word{k}") for k in range(1, WORDS + 1)])
    a = F.col("candidate.f")
    cuts = []
    for k in range(1, WORDS):
        whole = f"cast({int(scale)} as decimal(18,0)) * cast(candidate.f as decimal(20,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))"
        cuts.append(F.when(F.col(f"r{k}").isNotNull(), F.struct(
            F.expr(whole).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    scored = rows.withColumn("cut", F.least(*cuts)).select(
        F.col("candidate.lang").alias("symbol"), F.concat_ws(" ", *[f"word{k}" for k in range(1, WORDS + 1)]).alias("phrase"),
        a.alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_per_group(scored, ["symbol"], order, top, ["phrase"])
    totals = words.where("size = 0").groupBy(F.col("lang").alias("symbol")).agg(F.sum("f").alias("n"), F.min("word").alias("lang"))
    return best.join(totals, "symbol").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
