"""Centroid clustering in exact integers, with Fagin's threshold algorithm as the search for the nearest centroid.

Vectors become integers, floor(scale * x). In every dimension the centroids stand in a list sorted by that
component. From a vector's value the lists are walked outward, all dimensions one entry a step, and each centroid
met gets its exact squared distance. A centroid not met yet is at least as far as the next entry in every
dimension, so the search of a vector stops when the sum of those squared frontier distances strictly exceeds the best
distance. On a tie the smaller number holds, which is why equality doesn't stop.

One round is one pass: each task adds up its vectors by centroid and hands on k x dimensions sums, cut in limbs of
32 bits so that no sum can overflow. The driver holds centroids and sums only, k x dimensions numbers, whatever
the number of vectors. Rounds after one that moves no centroid would change nothing and are not run.

Vectors with another number of components, or with null or non-finite ones (also after scaling), are left out. Fewer
vectors than ``k`` give as many centroids as there are vectors. Repeated vectors and repeated ids all count. A null id
comes last among the seeds. Distances beyond 2^63 - 1 are given as that value; they are compared exactly.
An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.sources.scratch import materialize

BLOCK = 4096
FAR = 1 << 2200  # over every squared distance of scaled doubles
LIMIT = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, vec_id: str, column: str, dims: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of each component, as doubles that hold integers."""
    schema = T.StructType([vectors.schema[vec_id], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False))
            parts = pc.list_flatten(fit.column(1))
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(parts.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) * scale)
            x = x.reshape(-1, dims)
            good = np.isfinite(x).all(axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, good.sum() * dims + 1, dims, dtype=np.int32), x[good].ravel())
            yield pa.RecordBatch.from_arrays([fit.column(0).filter(pa.array(good)), lists], names=[vec_id, "v"])

    return vectors.select(vec_id, F.col(column).cast("array<double>")).mapInArrow(convert, schema)


def blocks(column: pa.ListArray, dims: int, centroids: list[list[int]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with their vectors and the centroids: in int64 where no distance can overflow, else exact."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    reach = max((abs(c) for row in centroids for c in row), default=0)
    for i in range(0, len(x), BLOCK):
        part = x[i: i + BLOCK]
        if dims * (float(np.abs(part).max()) + reach) ** 2 < 2.0**62:
            yield i, i + len(part), part.astype(np.int64), np.array(centroids, np.int64)
        else:
            exact = np.array([int(value) for value in part.ravel()], object).reshape(part.shape)
            yield i, i + len(part), exact, np.array(centroids, object).reshape(-1, dims)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid and its squared distance for each row of ``v``, and how many distances were taken."""
    n, dims = v.shape
    k = len(centroids)
    far = LIMIT if v.dtype == np.int64 else FAR
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    up = np.stack([np.searchsorted(values[:, j], v[:, j]) for j in range(dims)], axis=1)
    down = up - 1
    label, best = np.full(n, k), np.full(n, far, v.dtype)
    met = np.zeros((n, k), bool)
    every = np.arange(dims)
    alive, taken = np.arange(n), 0
    while len(alive):
        own, low, high = v[alive], down[alive], up[alive]
        below = np.where(low >= 0, own - values[np.maximum(low, 0), every], far)
        above = np.where(high < k, values[np.minimum(high, k - 1), every] - own, far)
        frontier = np.minimum(below, above)
        # All lists end in the same step, when every centroid has been met.
        open_ = ~met[alive].all(axis=1)
        open_[open_] = (frontier[open_] ** 2).sum(axis=1) <= best[alive[open_]]
        alive, low, high, below, above = alive[open_], low[open_], high[open_], below[open_], above[open_]
        if not len(alive):
            break
        downward = below <= above
        entry = order[np.where(downward, low, high), every]
        down[alive], up[alive] = low - downward, high + ~downward
        fresh = np.zeros((len(alive), k), bool)
        fresh[np.arange(len(alive))[:, None], entry] = True
        fresh &= ~met[alive]
        met[alive] |= fresh
        for c in range(k):
            rows = alive[fresh[:, c]]
            distance = ((v[rows] - centroids[c]) ** 2).sum(axis=1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (c < label[rows]))
            best[rows[better]], label[rows[better]] = distance[better], c
            taken += len(rows)
    return label, best, taken


def limbs(value: int) -> list[int]:
    """``value`` in base 2^32, lowest first; the last limb carries the sign."""
    out = []
    while not -(1 << 31) <= value < 1 << 31:
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def next_centroids(vectors: DataFrame, dims: int, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the componentwise floor of the mean of its vectors; one without vectors stays."""
    arrow = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = defaultdict(lambda: [0] * dims), defaultdict(int)
        for batch in batches:
            for _, _, v, c in blocks(batch.column(0), dims, centroids):
                label, _, _ = nearest(v, c)
                for cluster in np.unique(label).tolist():
                    own = v[label == cluster]
                    sums[cluster] = [a + int(b) for a, b in zip(sums[cluster], own.sum(axis=0))]
                    counts[cluster] += len(own)
        rows = [
            {"cluster": cluster, "dim": dim, "limb": limb, "value": value}
            for cluster, own in sums.items() for dim, total in enumerate([*own, counts[cluster]])
            for limb, value in enumerate(limbs(total))]
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    parts = vectors.select("v").mapInArrow(add_up, "cluster int, dim int, limb int, value long")
    totals = defaultdict(int)
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect():  # k x dims sums
        totals[r.cluster, r.dim] += r.value << (32 * r.limb)
    return [
        [totals[c, j] // totals[c, dims] for j in range(dims)] if totals.get((c, dims)) else old
        for c, old in enumerate(centroids)]


def seeds(vectors: DataFrame, vec_id: str, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors whose id, behind the salt, has the smallest sha256; equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(vec_id).cast("string")), 256)
    rows = vectors.select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()
    return [[int(x) for x in r.v] for r in rows]


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", dims: int = 64, k: int = 8,
                    rounds: int = 10, scale: int = 1024, salt: str = "3") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector, and the centroids after ``rounds`` rounds."""
    kept = materialize(integer_vectors(vectors, vec_id, column, dims, scale))
    centroids = seeds(kept, vec_id, k, salt)
    for _ in range(rounds if centroids else 0):
        moved = next_centroids(kept, dims, centroids)
        if moved == centroids:
            break
        centroids = moved
    schema = T.StructType([
        kept.schema[vec_id], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, v, c in blocks(batch.column(1), dims, centroids):
                label, best, _ = nearest(v, c)
                distance = best if best.dtype == np.int64 else np.array([min(x, LIMIT) for x in best], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(label.astype(np.int32)), pa.array(distance)],
                    names=[vec_id, "cluster", "distance"])

    return kept.select(vec_id, "v").mapInArrow(assign, schema), centroids


def cluster_report(vectors: DataFrame, vec_id: str = "vec_id", **settings) -> DataFrame:
    """:func:`cluster_vectors` with the sum of distances of each cluster and of all, and a digest of each centroid."""
    placed, centroids = cluster_vectors(vectors, vec_id, **settings)
    placed = materialize(placed)
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("own")).collect()  # k rows
    own = {r.cluster: int(r.own) for r in sums}
    rows = [
        (c, min(own.get(c, 0), LIMIT), min(sum(own.values()), LIMIT), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centroids)]
    told = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
