"""Lloyd's clustering of integer vectors, exactly, by pairs of trees.

Vectors are cut into blocks of at most BLOCK as they come; each block has its cover tree, built once and stored with it. Every
round builds a cover tree over the centroids, too, and walks the two together: a pair of nodes is dropped if the least distance
of any vector in the one to any centroid in the other is above a distance within which every vector of the block's node has a
centroid. Both trees go down to single points (or equal ones), since no pair of wide leaves can be dropped. Vectors of leaf
pairs that are left are compared with their centroids in integers; ties go to the smaller number.
Each task adds up its own vectors by centroid, so the sums that meet are one row a task, centroid and component, and what the
driver holds is the centroids (MOST_BYTES at most; more are an error).

A vector counts if it has the asked number of components, none null or non-finite, and none beyond LARGEST once it is an
integer (squared distances have to fit a long); others have no part and no row. Vectors with a null key count and never start
a centroid. Repeated rows are vectors of their own; they start centroids of their own, too. With fewer vectors than centroids
there are as many centroids as vectors. An empty table gives an empty one. A sum of distances that doesn't fit a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, covertree

BLOCK = 1024
LARGEST = 1 << 24
MOST_BYTES = 64 << 20
#: Pairs of a vector and a centroid that are compared at once.
PAIRS = 1 << 14


def _integers(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    return np.floor(np.asarray(column.flatten(), np.float64).reshape(-1, dim) * scale).astype(np.int32)


def _blocks(dim: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, BLOCK) for whole in batches for i in range(0, whole.num_rows, BLOCK)):
            points = _integers(batch.column(1), dim, scale)
            tree = covertree.build(points.astype(np.float64), 1)
            keys = batch.column(0).take(pa.array(tree.order))
            nodes = np.stack([np.argsort(tree.order)[tree.centre], tree.start, tree.stop, tree.first, tree.last]).astype(np.int32)
            yield pa.record_batch(
                [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([points[tree.order].tobytes()]), pa.array([nodes.tobytes()]), pa.array([tree.radius.tobytes()])],
                ["keys", "points", "nodes", "radius"],
            )

    return run


def blocks(vectors: DataFrame, key: str, vector: str, dim: int, scale: float) -> DataFrame:
    """A stored row a block: keys, points (32-bit integers, in the tree's order), and the tree's nodes."""
    kept = vectors.filter(common.finite(vector, dim) & F.forall(vector, lambda x: F.abs(F.floor(x.cast("double") * scale)) <= LARGEST)).select(key, vector)
    kind = T.StructType().add("keys", T.ArrayType(vectors.schema[key].dataType)).add("points", "binary").add("nodes", "binary").add("radius", "binary")
    return common.stored(kept.transform(common.in_arrow, _blocks(dim, scale), kind), "blocks", packed=True)


def _tree(points: np.ndarray, nodes: bytes, radius: bytes) -> covertree.Tree:
    centre, start, stop, first, last = np.frombuffer(nodes, np.int32).reshape(5, -1).astype(np.int64)
    return covertree.Tree(np.arange(len(points)), centre, np.frombuffer(radius), start, stop, first, last)


def _children(tree: covertree.Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of what to go on with at each node: its children, or a leaf itself."""
    leaf = tree.first[nodes] < 0
    return np.where(leaf, nodes, tree.first[nodes]), np.where(leaf, 1, tree.last[nodes] - tree.first[nodes])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within the owner) of counts[0] + counts[1] + ... things."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def nearest(points: np.ndarray, tree: covertree.Tree, centroids: np.ndarray, over: covertree.Tree) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of every point, in the tree's order. points and centroids: integers, as the trees' orders have them.

    Returned centroids are places in over.order."""
    a, b = points[tree.centre].astype(np.float64), centroids[over.centre].astype(np.float64)
    slack = 1e-6 * (1 + max(float(np.abs(a).max()), float(np.abs(b).max())) * points.shape[1] ** 0.5)  # for rounding
    bound = np.full(len(tree.centre), np.inf)
    v = c = np.zeros(1, np.int64)
    left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(v):
        far = np.concatenate([np.sqrt(((a[v[i : i + PAIRS]] - b[c[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(v), PAIRS)])
        np.minimum.at(bound, v, far + tree.radius[v] + slack)  # a node's centre is one of its centroids
        low = far - tree.radius[v] - over.radius[c] - slack
        v, c, low = (x[low <= bound[v]] for x in (v, c, low))
        (va, vn), (ca, cn) = _children(tree, v), _children(over, c)
        ends = (tree.first[v] < 0) & (over.first[c] < 0)
        left.append((v[ends], c[ends], low[ends]))
        v, va, vn, ca, cn = (x[~ends] for x in (v, va, vn, ca, cn))
        pair, at = _spread(vn * cn)
        parent, v, c = v[pair], va[pair] + at // cn[pair], ca[pair] + at % cn[pair]
        np.minimum.at(bound, v, bound[parent])
    v, c, low = (np.concatenate(x) for x in zip(*left, strict=True))
    v, c = (x[low <= bound[v]] for x in (v, c))
    best, number = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)
    pn, cn = tree.stop[v] - tree.start[v], over.stop[c] - over.start[c]
    upto = np.cumsum(pn * cn)
    start = 0
    while start < len(v):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        part = slice(start, stop)
        pair, at = _spread(pn[part] * cn[part])
        p, q = tree.start[v[part]][pair] + at // cn[part][pair], over.start[c[part]][pair] + at % cn[part][pair]
        far = ((points[p].astype(np.int64) - centroids[q]) ** 2).sum(1)
        which = np.lexsort((over.order[q], far, p))
        p, q, far = p[which], q[which], far[which]
        one = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        p, q, far = p[one], over.order[q[one]], far[one]
        better = (far < best[p]) | (far == best[p]) & (q < number[p])
        best[p[better]], number[p[better]] = far[better], q[better]
        start = stop
    return number, best


def _walked(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """(keys, points, centroid, squared distance) of every block."""
    over = covertree.build(centroids.astype(np.float64), 1)
    ordered = centroids[over.order]
    over.centre = np.argsort(over.order)[over.centre]
    for batch in batches:
        for i in range(batch.num_rows):
            keys, (points, nodes, radius) = batch.column(0).slice(i, 1).flatten(), (batch.column(j)[i].as_py() for j in (1, 2, 3))
            points = np.frombuffer(points, np.int32).reshape(-1, centroids.shape[1])
            yield keys, points, *nearest(points, _tree(points, nodes, radius), ordered, over)


def _sums(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = held.value
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, points, number, _ in _walked(batches, centroids):
            counts += np.bincount(number, minlength=len(centroids))
            by = np.argsort(number, kind="stable")
            used, first = np.unique(number[by], return_index=True)
            sums[used] += np.add.reduceat(points[by].astype(np.int64), first, axis=0)
        some = np.flatnonzero(counts)
        values = [[int(counts[i]), *sums[i].tolist()] for i in some]
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["name", "cells"])

    return run


def _assigned(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, number, far in _walked(batches, held.value):
            yield pa.record_batch([keys, pa.array(number, pa.int32()), pa.array(far)], ["key", "cluster", "distance"])

    return run


def _first(vectors: DataFrame, key: str, vector: str, k: int, dim: int, scale: float, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of a seed and their key, in its order; equal ones by their components."""
    kept = vectors.filter(common.finite(vector, dim) & F.forall(vector, lambda x: F.abs(F.floor(x.cast("double") * scale)) <= LARGEST) & F.col(key).isNotNull())
    rows = kept.select(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256).alias("hash"), F.col(vector).alias("vector")).orderBy("hash", "vector").limit(k).collect()
    return np.floor(np.array([r.vector for r in rows], np.float64).reshape(-1, dim) * scale).astype(np.int64)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: str = "1:") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts, after rounds of Lloyd's."""
    if k * dim * 8 > MOST_BYTES:
        raise ValueError(f"{k} centroids of {dim} components are larger than {MOST_BYTES} bytes")
    spark = vectors.sparkSession
    cut = blocks(vectors, key, vector, dim, scale)
    centroids = _first(vectors, key, vector, k, dim, scale, seed)
    kind = T.StructType().add("key", vectors.schema[key].dataType).add("cluster", "integer").add("distance", "long")
    if not len(centroids):
        empty = spark.createDataFrame([], kind).withColumnRenamed("key", key)
        return empty.selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centroids)
        found = common.summed(cut.transform(common.in_arrow, _sums(held), "name long, cells array<long>"), "decimal(38,0)")
        centroids = centroids.copy()
        for i, (count, *sums) in found.items():
            centroids[i] = [int(x) // int(count) for x in sums]
    held = spark.sparkContext.broadcast(centroids)
    done = common.stored(cut.transform(common.in_arrow, _assigned(held), kind), "clusters")
    inertia = {r.cluster: int(r.n) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    of = [(i, long(n), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, n in sorted(inertia.items())]
    table = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.withColumnRenamed("key", "__key").join(F.broadcast(table), "cluster").select(F.col("__key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
