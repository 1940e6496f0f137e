"""Exact Jaccard self-join of documents' word-shingle sets in metric space.

Jaccard distance is a metric. A pivot p and the triangle inequality tell, for a radius r, that a document
within r of one at distance d from p is itself at a distance from d - r to d + r. So around a pivot

* the *core* (up to r) is linked to the pivot, and all of it is connected;
* the *ring* (over r, up to 2r) is the only place where else a partner of the core can be: without a ring,
  the pivot's Voronoi cell is closed and leaves the region whole; with one, only the core documents
  inside the ring's window, at most r nearer than its nearest member, stay beside the ring;
* what lies beyond 2r forms the rest, in which the next pivots are taken: the region is joined
  recursively until nothing is left or all that is left is connected.

Texts that have nothing to do with each other all lie at distance 1, where windows of the triangle
inequality part nothing. So regions are laid out first, by facts about sets that lose no pair:

* *lone documents* go: a document within r of another shares at least (1 - r) of its shingles, so one with fewer
  shingles that occur in any other set has no partner;
* *parts*: shingles are hashed into m parts, m by the size of the sets. Linked sets of sizes a and b differ in at
  most r (a + b) / (2 - r) shingles, so among more parts than that at least one is equal in both. Documents that
  share a whole part are neighbours; a region is a connected component of neighbours.

A region that fits is joined in one task. A larger one is first cut by rounds of pivots whose distances
to packs of its documents are computed all over the cluster; a round closes cells, drops what is
connected, and always resolves its pivots, so it ends, exactly, whatever the region looks like. Groups of
equal sets are one node each throughout.

Null and empty texts, and texts without a word, have no shingle, link with nothing and are their own
component. Repeated rows have equal sets and are one component. Component ids are the smallest doc_id
in reach; null ids come last. Other columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.components import connected_components
from tallyweave.llm.inputs import row_chunks, text_bytes
from tallyweave.llm.shingles import mix, shingle_sets
from tallyweave.sources.scratch import materialize

#: Shingles of a range of the hash space, which one task counts at a time.
RANGE_TOKENS = 2_000_000
#: Ranges that a batch of texts writes rows for at most.
HOP = 4_096
#: Shingles of a region that one task joins.
REGION_TOKENS = 1_000_000
#: Classes of four integers that are sent to every task at most; beyond, texts are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Pivots of a round, and documents in a pack.
PIVOTS = 128
#: Bytes of text whose documents count their shingles together before they are shuffled.
TOGETHER = 4 << 20
#: Of the hash that parts shingles.
SEED = 0x51ED270B9F652295


class Similar:
    """Whether two sets link: overlap * denominator >= numerator * union, in whole numbers."""

    def __init__(self, percent: int = 80):
        self.percent = percent

    def links(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)

    def within_twice(self, overlap, a, b):
        """Distance up to 2r: similarity of 1 - 2r or more."""
        return 100 * overlap >= (2 * self.percent - 100) * (a + b - overlap)

    def least(self, n: int) -> int:
        """Shingles that a set of n must share with a partner."""
        return -(-self.percent * n // 100)

    def differ(self, n: int) -> int:
        """The most shingles in which a set of n and a partner can differ: partners hold n / t at most."""
        return n * (100 - self.percent) // self.percent


def digest(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist())


# ---- sets and their classes


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """row, doc_id, check, n, d1, d2 for each row: its number, text hash, set size and set digest."""
    schema = "row long, doc_id long, check long, n int, d1 long, d2 long"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            own = shingle_sets(batch.column(2), width)
            digests = np.array([digest(s) for s in own], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(own))), batch.column(0), batch.column(1),
                 pa.array(np.array([len(s) for s in own], np.int32)), pa.array(digests[:, 0]), pa.array(digests[:, 1])],
                ["row", "doc_id", "check", "n", "d1", "d2"])
            row += len(own)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("check"), "text").mapInArrow(sets, schema)


def class_table(rows: DataFrame) -> DataFrame:
    """node, first_doc, holder, n, d1, d2 for each different set: its number, smallest id and one holder's id."""
    return rows.where("n > 0").groupBy("d1", "d2").agg(
        F.min(F.struct("row", "doc_id")).alias("at"), F.min("doc_id").alias("first_doc"), F.min("n").alias("n")).select(
        F.col("at.row").alias("node"), "first_doc", F.col("at.doc_id").alias("holder"), "n", "d1", "d2")


# ---- lone documents


def range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Which of ``ranges`` equal ranges of the hash space holds each shingle."""
    return (((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)


def pack_ranges(
    own: np.ndarray, who: np.ndarray, at: np.ndarray, several: np.ndarray, several_at: np.ndarray,
    home: np.ndarray, known: np.ndarray, home_at: np.ndarray, batch: int, kept: type,
) -> list[dict]:
    """One row for each range that has something: shingles by holder, shared shingles, and what is known already.

    ``own`` and ``who`` are in order of range and holder. ``kept`` is the type of a shingle in a row.
    """
    order, home_order = np.argsort(several_at, kind="stable"), np.argsort(home_at, kind="stable")
    several, several_at = several[order], several_at[order]
    home, known, home_at = home[home_order], known[home_order], home_at[home_order]
    firsts = [x[np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]] for x in (at, several_at, home_at)]  # all are sorted
    used = np.unique(np.concatenate(firsts).astype(np.int64))
    cuts = [(np.searchsorted(x, used, "left"), np.searchsorted(x, used, "right")) for x in (at, several_at, home_at)]
    out = []
    for k, r in enumerate(used.tolist()):
        mine, shared, homes = (slice(int(low[k]), int(high[k])) for low, high in cuts)
        owners, counts = np.unique(who[mine], return_counts=True)
        out.append({
            "r": r, "batch": batch, "names": owners.tobytes(), "counts": counts.astype(np.uint32).tobytes(),
            "tokens": own[mine].astype(kept).tobytes(), "several": several[shared].astype(kept).tobytes(),
            "home": home[homes].tobytes(), "known": known[homes].astype(np.uint32).tobytes()})
    return out


def range_blobs(sets: list[np.ndarray], names: np.ndarray, ranges: int, batch: int, finer: int = 1) -> list[dict]:
    """What some documents' shingles say to each range of the hash space.

    A shingle that several of these documents hold is sent once, as such; one that a single document
    holds is sent with that document's name. Documents learn of the former here, as ``known``. Where the
    ranges will be cut ``finer``, shingles are sent whole.
    """
    if not sets:
        return []
    names, picked = np.unique(names, return_index=True)
    sets = [sets[i] for i in picked]
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens)
    ordered = tokens[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(tokens) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(tokens)))
    single = np.zeros(len(tokens), bool)
    single[order[starts[lengths == 1]]] = True
    several = ordered[starts[lengths > 1]]
    known = np.bincount(owner[~single], minlength=len(sets))
    own, who = tokens[single], owner[single]
    at = range_of(own, ranges * finer) // finer
    order = np.argsort(at, kind="stable")  # by range and then by owner
    told = known > 0
    return pack_ranges(
        own[order], names[who[order]], at[order], several, range_of(several, ranges * finer) // finer,
        names[told], known[told], names[told].view(np.uint64) % np.uint64(ranges), batch, np.uint64 if finer > 1 else np.uint32)


def refine_range(group: pa.Table, ranges: int, finer: int) -> list[dict]:
    """The rows of one range from a group of batches, as rows of ``finer`` ranges from one larger batch.

    A copy that was counted in several batches is counted once from here on, with the most that one of them knew.
    """
    rows = group.to_pylist()
    r, batch = rows[0]["r"], rows[0]["batch_group"]
    joined = lambda k, kind: np.frombuffer(b"".join(row[k] for row in rows), kind)
    own, several = joined("tokens", np.uint64), np.unique(joined("several", np.uint64))
    who = np.repeat(joined("names", np.int64), joined("counts", np.uint32))
    at = range_of(own, ranges * finer)
    order = np.lexsort((own, who, at))
    own, who, at = own[order], who[order], at[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (who[1:] != who[:-1])
    home, place = np.unique(joined("home", np.int64), return_inverse=True)
    known = np.zeros(len(home), np.uint32)
    np.maximum.at(known, place, joined("known", np.uint32))
    home_at = home.view(np.uint64) % np.uint64(finer) + np.uint64(r * finer)
    return pack_ranges(
        own[new], who[new], at[new], several, range_of(several, ranges * finer), home, known, home_at, batch, np.uint32)


def count_range(group: pa.Table) -> pa.Table:
    """For the documents of one range, by batch, how many of their shingles others hold too: (batch, names, found)."""
    batches, names, counts, tokens, several, extra = [], [], [], [], [], []
    for row in group.to_pylist():
        who = np.frombuffer(row["names"], np.int64)
        batches.append(np.full(len(who), row["batch"]))
        names.append(who)
        counts.append(np.frombuffer(row["counts"], np.uint32))
        tokens.append(np.frombuffer(row["tokens"], np.uint32))
        several.append(np.frombuffer(row["several"], np.uint32))
        home = np.frombuffer(row["home"], np.int64)
        extra.append((np.full(len(home), row["batch"]), home, np.frombuffer(row["known"], np.uint32)))
    batches, names = np.concatenate(batches), np.concatenate(names)
    entry = np.repeat(np.arange(len(names)), np.concatenate(counts))
    tokens, several = np.concatenate(tokens), np.concatenate(several)
    order = np.argsort(tokens, kind="stable")
    ordered, who = tokens[order], names[entry[order]]
    shared = np.zeros(len(tokens), bool)
    if len(tokens):
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        more = np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)
        shared[order] = np.repeat(more, np.diff(np.append(starts, len(tokens))))
        shared |= np.isin(tokens, several)
    found = np.bincount(entry[shared], minlength=len(names))
    found, names = np.concatenate([found, *(e[2] for e in extra)]), np.concatenate([names, *(e[1] for e in extra)])
    batches = np.concatenate([batches, *(e[0] for e in extra)])
    hit = found > 0
    found, names, batches = found[hit].astype(np.uint32), names[hit], batches[hit]
    order = np.argsort(batches, kind="stable")
    cuts = np.flatnonzero(np.diff(batches[order])) + 1
    parts = [p for p in np.split(order, cuts) if len(p)]
    return pa.table({
        "batch": pa.array([int(batches[p[0]]) for p in parts], pa.int64()),
        "names": pa.array([names[p].tobytes() for p in parts], pa.binary()),
        "found": pa.array([found[p].tobytes() for p in parts], pa.binary())})


def sum_batch(group: pa.Table) -> pa.Table:
    """(name, shared) of the documents that were counted together, over all ranges."""
    names = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group["names"]])
    found = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["found"]])
    names, at = np.unique(names, return_inverse=True)
    return pa.table({"name": names, "shared": np.bincount(at, weights=found, minlength=len(names)).astype(np.int64)})


BLOBS = "r int, batch long, names binary, counts binary, tokens binary, several binary, home binary, known binary"
BLOB_TYPES = pa.schema([("r", pa.int32()), ("batch", pa.int64())] + [
    (k, pa.binary()) for k in ("names", "counts", "tokens", "several", "home", "known")])


def shared_counts(texts: DataFrame, width: int, tokens: int, range_tokens: int = RANGE_TOKENS, hop: int = HOP) -> DataFrame:
    """(name, shared): of each set, named by its digest, how many shingles occur in another set.

    ``tokens`` is the number of shingles in all. Copies of a set have one name; where they are counted apart
    the largest count holds. Two shingles that look alike in a range only ever raise a count.

    A batch of texts writes a row for each range. Beyond ``hop`` ranges such rows would hold next to nothing, so
    there batches go to ``hop`` wide ranges first, where groups of batches are cut to the narrow ones together.
    """
    ranges = max(8, ceil(tokens / range_tokens))
    finer = ceil(ranges / hop)
    ranges = ceil(ranges / finer)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for i, j in row_chunks(text_bytes(batch.column(0))[1], TOGETHER):
                own = [s for s in shingle_sets(batch.column(0).slice(i, j - i), width) if len(s)]
                names = np.array([digest(s)[0] for s in own], np.int64)
                yield pa.RecordBatch.from_pylist(range_blobs(own, names, ranges, number, finer), schema=BLOB_TYPES)
                number += 1

    def refine(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(refine_range(group, ranges, finer), schema=BLOB_TYPES)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            found = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in names])),
                 pa.array(np.concatenate([np.zeros(0, np.int64), *names])),
                 pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64))], ["batch", "name", "shared"])

    blobs = texts.mapInArrow(spread, BLOBS)
    if finer > 1:
        group = F.pmod(F.xxhash64("batch"), F.lit(finer)).alias("batch_group")
        blobs = blobs.select("*", group).groupBy("r", "batch_group").applyInArrow(refine, BLOBS)
    found = blobs.groupBy("r").applyInArrow(count_range, "batch long, names binary, found binary")
    if finer > 1:
        counts = found.mapInArrow(one_by_one, "batch long, name long, shared long").groupBy("batch", "name").agg(F.sum("shared").alias("shared"))
    else:
        counts = found.groupBy("batch").applyInArrow(sum_batch, "name long, shared long")
    return counts.groupBy("name").agg(F.max("shared").alias("shared"))


def read_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    return batch.column(0).to_numpy(), [np.frombuffer(s.as_py(), np.uint64) for s in batch.column(1)]


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, n, tokens) of the wanted classes (node, holder, d1, d2), read again from their holders' texts."""
    few = wanted.count() <= BROADCAST_ROWS
    joined = docs.select("doc_id", "text").join(
        F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("holder"))).select("node", "d1", "d2", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, d1, d2, s in zip(*(batch.column(i).to_pylist() for i in range(3)), shingle_sets(batch.column(3), width)):
                if (d1, d2) == digest(s):
                    out.append((node, len(s), s.tobytes()))
            nodes, sizes, tokens = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary())], ["node", "n", "tokens"])

    return joined.mapInArrow(sets, "node long, n int, tokens binary")


# ---- parts and regions


def size_classes(n: int) -> list[int]:
    """Upper bounds of size classes up to the one that holds n, and the next."""
    out = [1]
    while out[-1] < n:
        out.append(max(out[-1] + 1, out[-1] * 9 // 5))
    return [*out, max(out[-1] + 1, out[-1] * 9 // 5)]


def part_names(tokens: np.ndarray, similar: Similar, seed: int) -> np.ndarray:
    """Hashes of whole parts of a set, such that linked sets have at least one in common.

    The set is parted as all sets of its size class are, and, where a partner can be in the next class, as
    those are too. It names its fullest parts, one more than a partner can change; of two linked sets the
    one with the higher bound on fullness shares an unchanged one that the other names as well.
    """
    n, most = len(tokens), similar.differ(len(tokens))
    bounds = size_classes(n)
    out = []
    for k in (len(bounds) - 2, len(bounds) - 1):
        if k == len(bounds) - 1 and 100 * n < similar.percent * (bounds[k - 1] + 1):
            continue
        upper = bounds[k]
        parts = max(similar.differ(upper) + 1, ceil(0.32 * upper), min(upper, 16))
        at = (mix(tokens + np.uint64(seed)) % np.uint64(parts)).astype(np.int64)
        counts = np.bincount(at, minlength=parts)
        fullness = np.sort(counts)[::-1][most]
        order = np.argsort(at, kind="stable")
        content = np.zeros(parts, np.uint64)
        full = np.flatnonzero(counts)
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        content[full] = np.add.reduceat(mix(tokens[order] ^ np.uint64(0x2545F4914F6CDD1D)), starts)
        named = np.flatnonzero(counts >= fullness)
        out.append(mix(content[named] ^ mix((named + (upper << 32)).astype(np.uint64))))
    return np.concatenate(out)


def neighbour_edges(sets: DataFrame, similar: Similar, seed: int) -> DataFrame:
    """(a, b): each node, and the smallest node that shares a part with it."""
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                nodes, own = read_sets(batch.slice(i, 500))
                parts = [part_names(s, similar, seed) for s in own]
                sizes = [len(p) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(nodes, sizes))], ["part", "node"])

    held = materialize(sets.select("node", "tokens").mapInArrow(name, "part long, node long"))
    pivots = materialize(
        held.groupBy("part").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("part", "a"))
    return held.join(pivots, "part").select("a", F.col("node").alias("b")).where("a != b").distinct()


# ---- joining a region


class Overlaps:
    """The sets of a region, with the holders of each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The overlap of a set with each set of the region."""
        a, b = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        n = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sets))


def join_region(nodes: np.ndarray, sets: list[np.ndarray], similar: Similar) -> list[tuple[int, int]]:
    """As few links as connect what is connected in a region, by pivots, one after the other."""
    region = Overlaps(sets)
    label = np.arange(len(nodes))
    active = np.arange(len(nodes))
    radius = 1 - similar.percent / 100
    links = []
    while len(active) > 1:
        pivot, active = active[0], active[1:]
        overlap = region.of(region.sets[pivot])[active]
        a, b = region.sizes[pivot], region.sizes[active]
        core = similar.links(overlap, a, b)
        others, first = np.unique(label[active[core]], return_index=True)  # one link for each part it connects
        links += [(int(nodes[pivot]), int(nodes[x])) for k, x in zip(others, active[core][first]) if k != label[pivot]]
        label[np.isin(label, others)] = label[pivot]
        ring = similar.within_twice(overlap, a, b) & ~core
        distance = 1 - overlap / (a + b - overlap)
        window = distance[ring].min() - radius - 1e-9 if ring.any() else 2.0
        active = active[~core | (distance >= window)]
        if len(active) and (label[active] == label[active[0]]).all():
            break
    return links


def region_links(members: DataFrame, sets: DataFrame, similar: Similar) -> DataFrame:
    """(a, b) links inside regions (region, node) that each fit one task."""
    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        nodes, picked = np.unique(group["node"].to_numpy(), return_index=True)
        tokens = group["tokens"]
        links = join_region(nodes, [np.frombuffer(tokens[int(i)].as_py(), np.uint64) for i in picked], similar)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return members.join(sets, "node").select("region", "node", "tokens").groupBy("region").applyInArrow(join, "a long, b long")


def meet_pivots(packs: DataFrame, similar: Similar) -> DataFrame:
    """What each pack (region, own, pivots) of documents finds at its region's pivots.

    Rows (region, a, b, home, distance): a link a-b where b is not null, and for each document of a pivot's
    core the nearest pivot, ``home``; where a is a pivot with a null b, the distance of its nearest ring member.
    """
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, pivots = ({x["node"]: np.frombuffer(x["tokens"], np.uint64) for x in row[k]} for k in ("own", "pivots"))
                nodes, heads = np.array(list(own)), np.array(list(pivots))
                region = Overlaps(list(own.values()))
                overlap = np.array([region.of(s) for s in pivots.values()])
                a, b = np.array([len(s) for s in pivots.values()])[:, None], region.sizes[None, :]
                core = similar.links(overlap, a, b)
                ring = similar.within_twice(overlap, a, b) & ~core
                distance = 1 - overlap / (a + b - overlap)
                out = []
                label = np.arange(len(heads))
                for x in np.flatnonzero(core.any(axis=0)):
                    held = np.flatnonzero(core[:, x])
                    home = held[distance[held, x].argmin()]
                    out.append((row["region"], int(heads[home]), int(nodes[x]), int(heads[home]), float(distance[home, x])))
                    for k in held:
                        if label[k] != label[home]:
                            label[label == label[k]] = label[home]
                            out.append((row["region"], int(heads[k]), int(nodes[x]), None, None))
                for k in np.flatnonzero(ring.any(axis=1)):
                    out.append((row["region"], int(heads[k]), None, None, float(distance[k][ring[k]].min())))
                columns = zip(*out) if out else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], ["region", "a", "b", "home", "distance"])

    return packs.mapInArrow(meet, "region long, a long, b long, home long, distance double")


def pivot_round(members: DataFrame, sets: DataFrame, similar: Similar, turn: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """One round over large regions (region, node, n, label): new links, and the members left to join.

    Pivots are taken outside each region's most common label first, so that a round resolves documents
    that are not connected to the rest yet.
    """
    by_label = members.groupBy("region", "label").agg(F.count("*").alias("k"))
    sizes = materialize(
        by_label.groupBy("region").agg(
            F.max_by("label", F.struct("k", "label")).alias("main"),
            F.ceil(F.sum("k") / pivots).cast("int").alias("packs")))
    known = materialize(members.join(sizes, "region"))
    rank = Window.partitionBy("region").orderBy(
        (F.col("label") == F.col("main")).cast("int"), F.xxhash64("node", F.lit(turn)), "node")
    chosen = materialize(known.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= pivots).select("region", "node"))
    heads = chosen.join(sets, "node").groupBy("region").agg(F.collect_list(F.struct("node", "tokens")).alias("pivots"))
    packs = (
        known.select("region", "node", "packs").join(sets.select("node", "tokens"), "node")
        .groupBy("region", F.pmod(F.xxhash64("node"), F.col("packs")).alias("pack"))
        .agg(F.collect_list(F.struct("node", "tokens")).alias("own")))
    met = materialize(meet_pivots(packs.join(materialize(heads), "region").select("region", "own", "pivots"), similar))
    links = met.where("b IS NOT NULL").select("a", "b")
    rings = met.where("b IS NULL").groupBy(F.col("a").alias("home")).agg(F.min("distance").alias("ring"))
    radius = 1 - similar.percent / 100
    done = (
        met.where("home IS NOT NULL").join(rings, "home", "left")
        .where(F.col("ring").isNull() | (F.col("distance") < F.col("ring") - radius - 1e-9)).select(F.col("b").alias("node")))
    labels = connected_components(links.union(members.select("node", "label")))
    left = (
        members.drop("label").join(done.union(chosen.select("node")).distinct(), "node", "left_anti")
        .join(labels, "node", "left").select("region", "node", "n", F.coalesce("label", "node").alias("label")))
    return links, materialize(left)


def region_sizes(members: DataFrame) -> DataFrame:
    """Members of the regions that are not connected yet, with their regions' shingles, ``total``."""
    total = members.groupBy("region").agg(
        F.sum("n").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"))
    return members.join(materialize(total.where("low != high").select("region", "total")), "region")


def all_links(sets: DataFrame, similar: Similar, region_tokens: int = REGION_TOKENS, pivots: int = PIVOTS) -> DataFrame:
    """(a, b): links that connect all sets (node, n, tokens) that links connect."""
    regions = connected_components(neighbour_edges(sets, similar, SEED)).select(F.col("label").alias("region"), "node")
    members = materialize(regions.join(sets.select("node", "n"), "node").select("region", "node", "n", F.col("node").alias("label")))
    links, turn = None, 0
    while True:
        members = materialize(region_sizes(members))
        small = materialize(region_links(members.where(F.col("total") <= region_tokens).select("region", "node"), sets, similar))
        links = small if links is None else links.union(small)
        large = materialize(members.where(F.col("total") > region_tokens).drop("total"))
        if not large.limit(1).count():
            return links
        more, members = pivot_round(large, sets, similar, turn, pivots)
        links, turn = links.union(more), turn + 1


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, **limits) -> DataFrame:
    """row, doc_id, check, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    ``row`` is the row's number and ``check`` a hash of its text, so that a row can be told from others of
    its doc_id.
    """
    similar = Similar(percent)
    docs = docs.select("doc_id", "text")
    rows = materialize(document_sets(docs, width))
    classes = materialize(class_table(rows))
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    counts = shared_counts(docs.select("text"), width, tokens)
    suspects = materialize(
        classes.join(counts, F.col("d1") == F.col("name")).where(100 * F.col("shared") >= percent * F.col("n"))
        .select("node", "holder", "d1", "d2"))
    sets = materialize(sets_of(docs, suspects, width))
    linked = connected_components(all_links(sets, similar, **limits))
    linked = materialize(linked.join(classes.select("node", "first_doc"), "node"))
    ids = materialize(linked.groupBy("label").agg(F.min("first_doc").alias("component_id")))
    named = linked.join(ids, "label").select("node", "label", "component_id")
    named = materialize(classes.join(named, "node", "left").select(
        "d1", "d2", F.coalesce("label", "node").alias("component"), F.coalesce("component_id", "first_doc").alias("component_id")))
    return rows.join(named, ["d1", "d2"], "left").select(
        "row", "doc_id", "check", F.col("n").cast("long").alias("n_shingles"), "component",
        F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest doc_id, null ids last, and of those the first row.

    Rows without a shingle are linked with nothing and stay, but for rows of equal doc_id and text, of which one stays.
    No text is moved while the (doc_id, text hash) pairs that go, or that stay once of several times, can be broadcast.
    """
    found = materialize(jaccard_components(docs, **options).select("row", "doc_id", "check", "component"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min_by(F.struct("doc_id", "check"), order).alias("stay"))
    alone = found.where("component IS NULL").select(F.struct("doc_id", "check").alias("stay"))
    stay = first.select("stay").union(alone).distinct()
    pairs = found.groupBy(F.struct("doc_id", "check").alias("pair")).agg(F.count(F.lit(1)).alias("times"))
    decided = materialize(
        pairs.join(stay, F.col("pair") == F.col("stay"), "left").where("stay IS NULL OR times > 1")
        .select(F.col("pair.doc_id").alias("id"), F.col("pair.check").alias("check"), F.col("stay").isNotNull().alias("stays")))
    few = decided.count() <= BROADCAST_ROWS
    match = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64("doc.text") == F.col("check"))
    met = docs.select(F.struct(*docs.columns).alias("doc")).join(F.broadcast(decided) if few else decided, match, "left")
    several = met.where("stays").select("doc.*")
    return met.where("stays IS NULL").select("doc.*").union(several.dropDuplicates(["doc_id", "text"]))
