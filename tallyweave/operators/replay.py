"""Ordered replays of many settings in one pass over a stream.

A stream is put in order once and cut in blocks of arrivals. A block is handed on once for each setting, sorted by
bucket and packed in a few binary values, so that a shuffle moves arrays and not rows. One task replays a *part*: the
buckets of one setting, or every n-th of them. It holds the state of all its buckets as arrays and steps through
them side by side: in each round every bucket takes its next arrival, or a whole run of arrivals of one resident. Where few buckets
are left in a block (a hot one has most arrivals), the machines of the plain operators take over for the rest of it.

The results are those of ``heavy_fold``, ``waving_build`` and ``three_tier_fold`` with one shard, with hand-ons added up by key.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_fn, hash_value
from tallyweave.operators.elastic import ELASTIC_SLOTS
from tallyweave.operators.heavy import BucketState, ElasticGuard, GuardianGuard, coin, heavy_make
from tallyweave.operators.joinsketch import MIDDLE_SLOTS, TierBucket
from tallyweave.operators.linear import is_text
from tallyweave.operators.tasks import TASKS_PER_CORE
from tallyweave.operators.waving import CASTS, WavingBucket, cast_of, wave_sign
from tallyweave.spec import ELASTIC_FACTOR, GUARDIAN_BASE, GUARDIAN_GAP, SketchSpec

#: Arrivals of a block, about.
BLOCK_ROWS = 1 << 18
#: Hand-ons that a task keeps before it adds them up by key, and added-up ones that it keeps before it lets go of them.
REST_ROWS = 1 << 20
#: With fewer buckets than this in a round they are stepped through one by one.
FEW_BUCKETS = 64
LARGEST = np.iinfo(np.int64).max
PACKED = "part int, at bigint, bucket binary, key binary, seq binary, weight binary, extra binary"
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]
PACKED_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
OUT = ["cfg", "lane", "kind", "bucket", "pos", "key", "f", "flag"]


# --- states -----------------------------------------------------------------------------

class Rest:
    """Weights by (lane, key)."""

    def __init__(self):
        self.held, self.rows = [], 0

    def add(self, lane, key, weight):
        if len(key):
            self.held.append((lane, key, weight))
            self.rows += len(key)

    def sums(self):
        if not self.held:
            return None
        lane, key, weight = (np.concatenate(c) for c in zip(*self.held))
        low, span = int(key.min()), int(key.max()) - int(key.min()) + 1
        whole = span * (int(lane.max()) + 1) < 1 << 62  # lane and key in one number, which is sorted faster
        order = np.argsort(lane * span + (key - low)) if whole else np.lexsort((key, lane))
        lane, key, weight = lane[order], key[order], weight[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lane[1:] != lane[:-1])])
        self.held = [(lane[first], key[first], np.add.reduceat(weight, first))]
        return self.held[0]

    def full(self):
        """What is to be let go of now, if anything."""
        if self.rows < 2 * REST_ROWS:
            return None
        found = self.sums()
        if len(found[1]) < REST_ROWS:
            self.rows = len(found[1])
            return None
        self.held, self.rows = [], 0
        return found


class Block:
    """Arrivals of a part, sorted by bucket and in order inside each."""

    def __init__(self, bucket, key, seq, weight, extra):
        self.bucket, self.key, self.seq, self.weight, self.extra = bucket, key, seq, weight, extra
        n, other = len(key), bucket[1:] != bucket[:-1]
        self.starts = np.flatnonzero(np.r_[True, other])
        self.ends = np.r_[self.starts[1:], n]
        runs = np.flatnonzero(np.r_[True, other | (key[1:] != key[:-1])])
        ends = np.r_[runs[1:], n]
        self.run_end = np.repeat(ends, ends - runs)
        self.total = np.r_[0, np.cumsum(weight)]
        self.runs = self.total[self.run_end] - self.total[:-1]

    def every_arrival(self):
        """No arrivals are taken together."""
        self.run_end, self.runs = np.arange(1, len(self.key) + 1), self.weight

    def run_weight(self, at):
        return self.runs[at]


class Slots:
    """Buckets of residents with counts; ``lanes`` replays of the same arrivals side by side."""

    def __init__(self, buckets: int, slots: int, lanes: int = 1):
        n = buckets * lanes
        self.buckets, self.slots, self.lanes = buckets, slots, lanes
        self.keys, self.count = np.zeros((n, slots), np.int64), np.full((n, slots), LARGEST)
        self.flag, self.used = np.zeros((n, slots), bool), np.zeros(n, np.int64)
        self.rest = Rest()

    def replay(self, block: Block) -> None:
        local = block.bucket[block.starts]
        v = np.concatenate([local + lane * self.buckets for lane in range(self.lanes)])
        p, e = np.tile(block.starts, self.lanes), np.tile(block.ends, self.lanes)
        self.begin(block)
        while len(v) >= FEW_BUCKETS:
            p = self.round(block, v, p)
            left = p < e
            if not left.all():
                v, p, e = v[left], p[left], e[left]
        for one in zip(v.tolist(), p.tolist(), e.tolist()):
            self.alone(block, *one)
        self.end(block)

    def begin(self, block):
        pass

    def end(self, block):
        pass

    def round(self, block, v, p):
        """Every bucket takes a run of its resident or one other arrival; returns the next places."""
        p, k = p.copy(), block.key[p]
        same = self.keys[v] == k[:, None]
        slot = same.argmax(1)
        hit = same[np.arange(len(v)), slot] & (slot < self.used[v])
        room = ~hit & (self.used[v] < self.slots)
        if hit.any():
            i = np.flatnonzero(hit)
            self.again(block, v[i], slot[i], p[i])
            p[i] = block.run_end[p[i]]
        if room.any():
            i = np.flatnonzero(room)
            self.first(block, v[i], self.used[v[i]], p[i], k[i])
            self.used[v[i]] += 1
            p[i] = block.run_end[p[i]]
        i = np.flatnonzero(~hit & ~room)
        if len(i):
            self.miss(block, v[i], p[i], k[i])
            p[i] += 1
        return p

    def again(self, block, v, slot, p):
        self.count[v, slot] += block.run_weight(p)

    def first(self, block, v, slot, p, k):
        self.keys[v, slot], self.count[v, slot] = k, block.run_weight(p)

    def smallest(self, v):
        counts = self.count[v]
        slot = counts.argmin(1)
        return slot, counts[np.arange(len(v)), slot]

    def handed_on_rows(self, found):
        if found is not None:
            lane, key, weight = found
            yield "pass", lane, None, None, key, weight, None

    def flush(self):
        """Rows ``(kind, lane, bucket, pos, key, f, flag)`` that a part need not keep to its end."""
        yield from self.handed_on_rows(self.rest.full())

    def residents(self):
        """``(v, slot, key, count, flag)`` of the used slots."""
        v, slot = np.nonzero(np.arange(self.slots) < self.used[:, None])
        return v, slot, self.keys[v, slot], self.count[v, slot], self.flag[v, slot]


class Guards(Slots):
    """``BucketState`` of several strategies, a lane each."""

    def __init__(self, buckets: int, slots: int, strategies: Sequence[str], spec: SketchSpec):
        super().__init__(buckets, slots, len(strategies))
        self.rules = [heavy_make(s, spec.seed) for s in strategies]
        self.guard = np.zeros(buckets * self.lanes, np.int64)
        self.factor = np.repeat([ELASTIC_FACTOR if type(r) is ElasticGuard else 1 for r in self.rules], buckets)
        self.coins = np.repeat([isinstance(r, GuardianGuard) for r in self.rules], buckets)
        self.fn = hash_fn(spec.seed, "coin")
        self.powers = np.array([int(GUARDIAN_BASE ** gap) for gap in range(GUARDIAN_GAP + 1)])

    def miss(self, block, v, p, k):
        slot, smallest = self.smallest(v)
        guard, grow = self.guard[v], np.ones(len(v), np.int64)
        tossed = np.flatnonzero(self.coins[v])
        if len(tossed):
            gap = np.clip(smallest[tossed] - guard[tossed], 0, GUARDIAN_GAP)
            grow[tossed] = coin(self.fn, block.seq[p[tossed]]) % self.powers[gap] == 0
        guard = guard + grow
        full = guard > self.factor[v] * smallest
        self.guard[v] = np.where(full, 0, guard)
        on, i = ~full, full
        self.hand_on(block, v[on], p[on], k[on], block.weight[p[on]], None, None)
        if i.any():
            v, p, k, slot, smallest = v[i], p[i], k[i], slot[i], smallest[i]
            self.hand_on(block, v, p, self.keys[v, slot], smallest, self.flag[v, slot], slot)
            self.keys[v, slot], self.count[v, slot], self.flag[v, slot] = k, block.weight[p], True
            self.swapped(block, v, slot, p)

    def hand_on(self, block, v, p, key, weight, admitted, slot):
        self.rest.add(v // self.buckets, key, weight)

    def swapped(self, block, v, slot, p):
        pass

    def alone(self, block, v, p, e):
        n = int(self.used[v])
        state = BucketState(self.rules[v // self.buckets], self.slots)
        state.guard = int(self.guard[v])
        state.held = {k: [c, f, i] for i, (k, c, f) in enumerate(zip(*(x[v, :n].tolist() for x in (self.keys, self.count, self.flag))))}
        seq, key, weight, run_end, run = (x[p:e].tolist() for x in (block.seq, block.key, block.weight, block.run_end, block.runs))
        out, at = [], 0
        while at < e - p:
            k = key[at]
            if k in state.held or len(state.held) < self.slots:
                state.step(seq[at], k, run[at])
                at = run_end[at] - p
                continue
            row = state.step(seq[at], k, weight[at])
            out.append((p + at, row[3], row[4], row[0] == "evict", row[5]))
            at += 1
        self.guard[v], self.used[v] = state.guard, len(state.held)
        for k, (count, admitted, slot) in state.held.items():
            self.keys[v, slot], self.count[v, slot], self.flag[v, slot] = k, count, admitted
        if out:
            self.handed_on(block, v, *(np.array(c) for c in zip(*out)))

    def handed_on(self, block, v, at, key, weight, evicted, admitted):
        self.rest.add(np.full(len(key), v // self.buckets), key, weight)

    def close(self):
        v, slot, key, count, flag = self.residents()
        yield "heavy", v // self.buckets, v % self.buckets, slot, key, count, flag
        yield from self.handed_on_rows(self.rest.sums())


class LightGuards(Guards):
    """Elastic buckets over light cells, which what is handed on updates in the order of arrivals; ``extra`` tells the cell."""

    def __init__(self, buckets: int, slots: int, spec: SketchSpec, limit: int | None):
        super().__init__(buckets, slots, ["elastic"], spec)
        self.cell, self.known = np.zeros((buckets, slots), np.int64), {}
        self.cells, self.limit = np.zeros(spec.width, np.int64), limit or LARGEST

    def begin(self, block):
        self.moves, self.cell_at = [], block.extra % len(self.cells)

    def first(self, block, v, slot, p, k):
        super().first(block, v, slot, p, k)
        self.cell[v, slot] = self.cell_at[p]

    def swapped(self, block, v, slot, p):
        self.cell[v, slot] = self.cell_at[p]

    def hand_on(self, block, v, p, key, weight, admitted, slot):
        if slot is None:
            self.moves.append((block.seq[p], self.cell_at[p], weight, np.zeros(len(p), bool)))
        else:
            self.moves.append((block.seq[p], self.cell[v, slot], weight, ~admitted))

    def alone(self, block, v, p, e):
        n = int(self.used[v])
        self.known = dict(zip(self.keys[v, :n].tolist(), self.cell[v, :n].tolist())) | dict(
            zip(block.key[p:e].tolist(), self.cell_at[p:e].tolist()))
        super().alone(block, v, p, e)
        n = int(self.used[v])
        self.cell[v, :n] = [self.known[k] for k in self.keys[v, :n].tolist()]

    def handed_on(self, block, v, at, key, weight, evicted, admitted):
        cells = np.array([self.known[k] for k in key.tolist()])
        self.moves.append((block.seq[at], cells, weight, evicted & ~admitted))

    def end(self, block):
        """The moves of a block in one step for each cell: ``x -> max(x + all, a raise and what came after it)``."""
        if not self.moves:
            return
        seq, cell, weight, raises = (np.concatenate(c) for c in zip(*self.moves))
        if not len(seq):
            return
        order = np.lexsort((seq, cell))
        cell, weight, raises = cell[order], weight[order], raises[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ends = np.r_[first[1:], len(cell)]
        added = np.where(raises, 0, weight)
        upto = np.cumsum(added)
        after = np.repeat(upto[ends - 1], ends - first) - upto
        self.cells[cell[first]] += np.add.reduceat(added, first)
        up = raises & (weight > 0)
        np.maximum.at(self.cells, cell[up], np.minimum(weight[up], self.limit) + after[up])

    def close(self):
        yield from super().close()
        cell = np.flatnonzero(self.cells > 0)
        yield "light", np.zeros(len(cell), np.int64), None, cell, None, np.minimum(self.cells[cell], self.limit), None


class Waves(Slots):
    """``WavingBucket``; ``extra`` holds the signed counter of a key and, as its lowest bit, a minus."""

    def __init__(self, buckets: int, slots: int):
        super().__init__(buckets, slots)
        self.cast, self.sign = np.zeros((buckets, slots), np.int64), np.ones((buckets, slots), np.int64)
        self.casts = np.zeros((buckets, CASTS), np.int64)

    def again(self, block, v, slot, p):
        super().again(block, v, slot, p)
        i = np.flatnonzero(~self.flag[v, slot])
        v, slot, p = v[i], slot[i], p[i]
        self.casts[v, self.cast[v, slot]] += self.sign[v, slot] * block.run_weight(p)

    def first(self, block, v, slot, p, k):
        super().first(block, v, slot, p, k)
        self.flag[v, slot], self.cast[v, slot], self.sign[v, slot] = True, block.extra[p] >> 1, 1 - 2 * (block.extra[p] & 1)

    def miss(self, block, v, p, k):
        slot, smallest = self.smallest(v)
        cast, sign, weight = block.extra[p] >> 1, 1 - 2 * (block.extra[p] & 1), block.weight[p]
        swap = self.casts[v, cast] * sign >= smallest
        if swap.any():
            w, s = v[swap], slot[swap]
            free = self.flag[w, s]
            x, y = w[free], s[free]
            self.casts[x, self.cast[x, y]] += self.sign[x, y] * self.count[x, y]
            self.keys[w, s], self.count[w, s], self.flag[w, s] = k[swap], smallest[swap] + weight[swap], False
            self.cast[w, s], self.sign[w, s] = cast[swap], sign[swap]
        self.casts[v, cast] += sign * weight

    def alone(self, block, v, p, e):
        n = int(self.used[v])
        state = WavingBucket(self.slots)
        columns = (x[v, :n].tolist() for x in (self.keys, self.count, self.flag, self.cast, self.sign))
        state.held = {k: [c, f, i, cast, sign] for i, (k, c, f, cast, sign) in enumerate(zip(*columns))}
        state.casts = self.casts[v].tolist()
        key, extra, weight, run_end, run = (x[p:e].tolist() for x in (block.key, block.extra, block.weight, block.run_end, block.runs))
        at = 0
        while at < e - p:
            k, one = key[at], extra[at]
            whole = k in state.held or len(state.held) < self.slots
            state.step(None, (k, one >> 1, 1 - 2 * (one & 1)), run[at] if whole else weight[at])
            at = run_end[at] - p if whole else at + 1
        self.used[v], self.casts[v] = len(state.held), state.casts
        for k, (count, exact, slot, cast, sign) in state.held.items():
            self.keys[v, slot], self.count[v, slot], self.flag[v, slot] = k, count, exact
            self.cast[v, slot], self.sign[v, slot] = cast, sign

    def close(self):
        v, slot, key, count, exact = self.residents()
        yield "slot", np.zeros(len(v), np.int64), v, slot, key, count, exact
        v, pos = np.nonzero(self.casts)
        yield "cast", np.zeros(len(v), np.int64), v, pos, None, self.casts[v, pos], None


class TierBuckets(Slots):
    """``TierBucket``; ``flag`` tells the slots in use, ``heavy`` holds the keys that went up in any bucket."""

    def __init__(self, buckets: int, threshold: int):
        super().__init__(buckets, MIDDLE_SLOTS)
        self.threshold, self.heavy = threshold, {}

    def begin(self, block):
        if (block.weight < 0).any():
            # What a run adds up to doesn't tell whether it has reached the threshold on its way.
            block.every_arrival()
        self.names, self.code = np.unique(block.key, return_inverse=True)
        self.up = np.array([k in self.heavy for k in self.names.tolist()])
        self.gained, self.touched = np.zeros(len(self.names), np.int64), np.zeros(len(self.names), bool)

    def round(self, block, v, p):
        p, k, c = p.copy(), block.key[p], self.code[p]
        up = self.up[c]
        if up.any():
            self._gain(c[up], block.run_weight(p[up]))
        cand = ~self.flag[v] | (self.keys[v] == k[:, None])
        slot = cand.argmax(1)
        found = cand[np.arange(len(v)), slot] & ~up
        if found.any():
            i = np.flatnonzero(found)
            w, s = v[i], slot[i]
            count = np.where(self.flag[w, s], self.count[w, s], 0) + block.run_weight(p[i])
            rise = count >= self.threshold
            self._gain(c[i][rise], count[rise])
            self.up[c[i][rise]] = True
            self.keys[w, s], self.count[w, s], self.flag[w, s] = k[i], count, ~rise
        miss = ~found & ~up
        if miss.any():
            i = np.flatnonzero(miss)
            w = v[i]
            s, smallest = self.smallest(w)
            self.rest.add(np.zeros(len(i), np.int64), self.keys[w, s], smallest)
            self.keys[w, s], self.count[w, s] = k[i], block.weight[p[i]]
        return np.where(miss, p + 1, block.run_end[p])

    def _gain(self, code, weight):
        self.gained[code] += weight
        self.touched[code] = True

    def end(self, block):
        i = np.flatnonzero(self.touched)
        for k, weight in zip(self.names[i].tolist(), self.gained[i].tolist()):
            self.heavy[k] = self.heavy.get(k, 0) + weight
        self.gained[i], self.touched[i] = 0, False

    def alone(self, block, v, p, e):
        self.end(block)
        state = TierBucket(self.threshold)
        state.heavy = self.heavy
        state.slots = [(k, c) if f else None for k, c, f in zip(*(x[v].tolist() for x in (self.keys, self.count, self.flag)))]
        key, weight, run_end, run = (x[p:e].tolist() for x in (block.key, block.weight, block.run_end, block.runs))
        out, at = [], 0
        while at < e - p:
            k = key[at]
            if k in self.heavy:
                self.heavy[k] += run[at]
                at = run_end[at] - p
                continue
            row = state.step(None, k, weight[at])
            if row is not None:
                out.append((0, row[3], row[4]))
            at += 1
        for i, slot in enumerate(state.slots):
            self.flag[v, i] = slot is not None
            if slot is not None:
                self.keys[v, i], self.count[v, i] = slot
        if out:
            self.rest.add(*(np.array(c) for c in zip(*out)))

    def close(self):
        v, slot = np.nonzero(self.flag)
        yield "middle", np.zeros(len(v), np.int64), v, slot, self.keys[v, slot], self.count[v, slot], None
        key, count = (np.array(list(c), np.int64) for c in (self.heavy.keys(), self.heavy.values()))
        yield "heavy", np.zeros(len(key), np.int64), None, None, key, count, None
        yield from self.handed_on_rows(self.rest.sums())


# --- runner -----------------------------------------------------------------------------

class Names:
    """Numbers of text keys within a part; other keys are their own numbers."""

    def __init__(self, text: bool):
        self.text, self.number, self.names = text, {}, []

    def encode(self, packed: bytes) -> np.ndarray:
        if not self.text:
            return _unpack(packed)
        names, at = pickle.loads(packed)
        for name in names:
            if name not in self.number:
                self.number[name] = len(self.names)
                self.names.append(name)
        return np.array([self.number[name] for name in names], np.int64)[at]

    def decode(self, keys: np.ndarray):
        return [self.names[k] for k in keys.tolist()] if self.text else keys


def _pack(values) -> bytes:
    """The smallest value, and what the others are above it in as few bytes as the largest needs (none if all are equal)."""
    low = int(values.min())
    span = int(values.max()) - low
    size = next((i for i in (0, 1, 2, 4) if span < 1 << 8 * i), 8)
    data = b"" if not size else values.tobytes() if size == 8 else (values - low).astype(f"u{size}").tobytes()
    return low.to_bytes(8, "little", signed=True) + len(values).to_bytes(8, "little") + data


def _unpack(packed) -> np.ndarray:
    low, n = (int(x) for x in np.frombuffer(packed, np.int64, 2))
    size = (len(packed) - 16) // n
    if not size:
        return np.full(n, low)
    if size == 8:
        return np.frombuffer(packed, np.int64, offset=16)
    return np.frombuffer(packed, f"u{size}", offset=16).astype(np.int64) + low


def _pack_keys(keys, text: bool) -> bytes:
    if not text:
        return _pack(keys)
    names, at = np.unique(keys, return_inverse=True)
    return pickle.dumps((names.tolist(), at))


def part_groups(spark, settings: int) -> int:
    """In how many parts the buckets of a setting are dealt, so that all cores have several."""
    return max(1, -(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // settings))


def replay_parts(stream: DataFrame, specs: Sequence[SketchSpec], role: str, make: Callable[[int, int], Slots],
                 extra: Callable[[SketchSpec], Column] | None = None, groups: int = 1) -> DataFrame:
    """Replays ``(seq, key, weight)`` for each of ``specs``: ``(cfg, lane, kind, bucket, pos, key, f, flag)``.

    ``make(cfg, buckets)`` gives the state of a part with so many buckets, ``role`` the hash that deals keys to buckets
    and ``extra`` a number that the state is handed with each arrival. Specs of one seed share their hashes.
    """
    text = is_text(stream)
    seeds = list(dict.fromkeys(s.seed for s in specs))
    like = [next(s for s in specs if s.seed == seed) for seed in seeds]
    widths, seed_of = [s.buckets for s in specs], [seeds.index(s.seed) for s in specs]
    hashed = [F.shiftright(hash_value(F.col("key"), seed, role, text=text), 1).cast("int").alias(f"h{i}") for i, seed in enumerate(seeds)]
    more = [extra(s).cast("int").alias(f"e{i}") for i, s in enumerate(like)] if extra else []
    key = F.col("key") if text else F.col("key").cast("bigint")
    arrivals = stream.filter("key IS NOT NULL AND seq IS NOT NULL").select(
        key.alias("key"), "seq", F.coalesce(F.col("weight"), F.lit(0)).cast("bigint").alias("weight"), *hashed, *more)
    ordered = arrivals.repartitionByRange("seq").sortWithinPartitions("seq")

    def pack(batches):
        from pyspark import TaskContext

        at, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
                if rows < BLOCK_ROWS:
                    continue
            if rows:
                yield from packed(pa.Table.from_batches(held), at)
                at, held, rows = at + 1, [], 0

    def packed(block, at):
        column = {c: block[c].to_numpy() for c in block.column_names}
        for cfg, width in enumerate(widths):
            bucket = column[f"h{seed_of[cfg]}"] % width
            # Part by part, then bucket by bucket; 16 bits are sorted in linear time.
            place = bucket // groups + bucket % groups * -(-width // groups)
            order = np.argsort(place.astype(np.int16) if place.max() < 1 << 15 else place, kind="stable")
            bucket, columns = bucket[order], [column[c][order] for c in ("key", "seq", "weight")]
            more = column[f"e{seed_of[cfg]}"][order] if extra else None
            ends = np.searchsorted(place[order], np.arange(groups + 1) * -(-width // groups))
            rows = []
            for g, (a, z) in enumerate(zip(ends[:-1], ends[1:])):
                if a < z:
                    keys, seq, weight = (c[a:z] for c in columns)
                    rows.append((cfg * groups + g, at, _pack(bucket[a:z] // groups), _pack_keys(keys, text), _pack(seq), _pack(weight),
                                 b"" if more is None else _pack(more[a:z])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PACKED_TYPES)], names=PACKED_NAMES)

    def run(batches):
        state = names = None
        for batch in batches:
            for part, _, bucket, keys, seq, weight, more in zip(*(batch.column(i) for i in range(7))):
                if state is None:
                    cfg, g = divmod(part.as_py(), groups)
                    names, state = Names(text), make(cfg, -(-(widths[cfg] - g) // groups))
                bucket, seq, weight = (_unpack(x.as_buffer()) for x in (bucket, seq, weight))
                state.replay(Block(bucket, names.encode(keys.as_buffer()), seq, weight, _unpack(more.as_buffer()) if extra else None))
                yield from rows_of(state.flush(), cfg, g, names)
        if state is not None:
            yield from rows_of(state.close(), cfg, g, names)

    def rows_of(tables, cfg, g, names):
        for kind, lane, bucket, pos, key, f, flag in tables:
            n = len(f)
            none = lambda t: pa.nulls(n, t)
            ints = lambda x: none(pa.int64()) if x is None else pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, cfg), pa.int32()), pa.array(lane, pa.int32()), pa.array([kind] * n, pa.string()),
                ints(None if bucket is None else bucket * groups + g), ints(pos),
                none(key_type) if key is None else pa.array(names.decode(key), key_type), ints(f),
                pa.array(np.zeros(n, bool) if flag is None else flag)], names=OUT)

    key_type = pa.string() if text else pa.int64()
    blocks = ordered.mapInArrow(pack, PACKED)
    dealt = blocks.repartitionById(len(specs) * groups, F.col("part")).sortWithinPartitions("at")
    return dealt.mapInArrow(run, f"cfg int, lane int, kind string, bucket bigint, pos bigint, key {'string' if text else 'bigint'}, f bigint, flag boolean")


def guard_replays(stream: DataFrame, specs: Sequence[SketchSpec], strategies: Sequence[str]) -> DataFrame:
    """``heavy_fold`` with totals of every spec and strategy, the latter as ``lane``."""
    make = lambda cfg, buckets: Guards(buckets, specs[cfg].slots, strategies, specs[cfg])
    return replay_parts(stream, specs, "bucket", make, groups=part_groups(stream.sparkSession, len(specs)))


def elastic_replays(stream: DataFrame, specs: Sequence[SketchSpec], limit: int | None) -> DataFrame:
    """``elastic_fold`` with the light cells of ``elastic_light``, as rows of kind ``light``; they join all buckets of a setting in one task."""
    text = is_text(stream)
    make = lambda cfg, buckets: LightGuards(buckets, ELASTIC_SLOTS, specs[cfg], limit)
    cell = lambda spec: F.shiftright(hash_value(F.col("key"), spec.seed, "light", text=text), 1)
    return replay_parts(stream, specs, "bucket", make, cell)


def waving_replays(stream: DataFrame, specs: Sequence[SketchSpec]) -> DataFrame:
    """``waving_build`` of every spec."""
    text = is_text(stream)
    make = lambda cfg, buckets: Waves(buckets, specs[cfg].slots)
    packed = lambda spec: cast_of(spec, text) * F.lit(2) + (F.lit(1) - wave_sign(spec, text)) / F.lit(2)
    return replay_parts(stream, specs, "waving", make, packed, part_groups(stream.sparkSession, len(specs)))


def tier_replays(stream: DataFrame, specs: Sequence[SketchSpec], threshold: int) -> DataFrame:
    """``three_tier_fold`` of every spec, evictions added up by key as rows of kind ``pass``."""
    make = lambda cfg, buckets: TierBuckets(buckets, threshold)
    return replay_parts(stream, specs, "middle", make, groups=part_groups(stream.sparkSession, len(specs)))
