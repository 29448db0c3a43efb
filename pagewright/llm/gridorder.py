"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are laid on a grid of cells as wide as the largest distance of a linked pair, along leading principal dimensions
(of the second moments of all vectors), and sorted by their cells, one dimension after the other. The sorted sequence is cut into tiles; intervals
of four, sixteen ... tiles form a tree. Pairs of intervals are joined from the top down, in as many rounds as the tree has
levels: a pair goes on to the pairs of its parts unless the boxes around the two are provably distant. Pairs of tiles that are
left meet in a task, which halves them in the same way, down to runs of LEAF vectors; these are compared by cosine. Runs that
are provably near to each other as a whole are counted without a comparison.

Equal vectors are one class with a count. A task sends no pairs: of a pair of tiles it sends for each class with a link the
number of vectors that it links with there, and one link into a forest that spans what hangs together there. Components are
those of the forests. So a large group of copies costs no more than one vector, and one of near copies sends two rows a vector
and pair of tiles.

Rows are compared if labels are equal and not null, and sizes of vectors are equal. Null, empty and zero vectors, and those with
null or non-finite components link with nothing; they are in the result. A null key is no smallest one where others are there.
Repeated rows are vectors of their own. Other columns have no part in it. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components

#: Leading principal dimensions of the grid; vectors of a tile, and of a run that is compared whole; tiles of an interval are
#: four times those of its parts (two binary digits).
DIMS, TILE, LEAF, DIGITS = 8, 4096, 256, 2
#: A size of vectors up to which the driver holds their covariance (8 MB).
MOST_SIZE = 1024
#: Cosines this near to the bound are computed again, and distances count as larger or smaller only beyond it.
SLACK = 1e-9


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


# --- principal dimensions and cells ---------------------------------------------------------------------------------


def _moments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = units(np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, size)) if batch.num_rows else total[:0]
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["name", "cells"])

    return run


def axes(classes: DataFrame) -> np.ndarray:
    """(size, dimensions): the directions in which the vectors of the most frequent size lie farthest, from all of them."""
    most = classes.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size = most.size if most else 1
    if size > MOST_SIZE:
        return np.eye(size, min(size, DIMS))
    own = classes.filter(F.size("vector") == size).select("vector")
    rows = common.summed(own.transform(common.in_arrow, _moments(size), "name long, cells array<double>"), "double")
    moments = np.array([rows[i] for i in range(size)]) if rows else np.eye(size)
    return np.linalg.eigh(moments)[1][:, ::-1][:, :DIMS]


def leading(unit: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Coordinates in the grid's dimensions; vectors of another size than the axes' have their own first components."""
    y = unit @ along if unit.shape[1] == len(along) else unit[:, :DIMS]
    return np.pad(y, ((0, 0), (0, DIMS - y.shape[1])))


def _celled(along: np.ndarray, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column(0)), np.int64)
            found = np.zeros((batch.num_rows, 2 * DIMS), np.int32)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                y = leading(units(np.asarray(batch.column(0).take(pa.array(own)).flatten(), np.float64).reshape(-1, size)), along)
                found[own] = np.floor(np.hstack([y / width, 4 * y / width]))  # finer cells order what shares one
            yield pa.record_batch([pa.array(found.tolist(), pa.list_(pa.int32())), *batch.columns], ["cells", *batch.schema.names])

    return run


# --- tiles ----------------------------------------------------------------------------------------------------------


def _tiles(along: np.ndarray, most: int):
    """Runs of sorted rows (vector, label, digest, n, least) of one label and size, at most so many, as one row each."""

    def tile(at: int, rows: pa.Table) -> pa.RecordBatch:
        x = np.asarray(rows.column("vector").combine_chunks().flatten())
        x = x.reshape(rows.num_rows, -1)
        y = leading(units(x), along)
        lists = [pa.array([rows.column(c).to_pylist()], pa.list_(rows.column(c).type)) for c in ("digest", "least")]
        part = TaskContext.get().partitionId()
        return pa.record_batch(
            [
                rows.column("label").combine_chunks().slice(0, 1), pa.array([x.shape[1]], pa.int32()), pa.array([part]), pa.array([at]), pa.array([x.tobytes()], pa.binary()),
                pa.array([np.asarray(rows.column("n")).astype(np.int64).tobytes()], pa.binary()), *lists, pa.array([y.min(0).tolist()]), pa.array([y.max(0).tolist()]),
            ],
            ["label", "size", "part", "seq", "vectors", "counts", "digests", "leasts", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, at = [], None, 0
        for batch in batches:
            kinds = list(zip(batch.column(1).to_pylist(), pa.compute.list_value_length(batch.column(0)).to_pylist(), strict=True))
            start, rows = 0, len(kinds)
            while start < rows:
                stop, room = start, most - sum(x.num_rows for x in held)
                while stop < rows and kinds[stop] == of and stop - start < room:
                    stop += 1
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                if stop < rows:  # another label or size, or a full tile
                    if held:
                        yield tile(at, pa.Table.from_batches(held))
                        at += 1
                    held, of = [], kinds[stop]
                start = stop
        if held:
            yield tile(at, pa.Table.from_batches(held))

    return run


def _gap(a: str, b: str) -> Column:
    """The squared distance of two boxes."""
    apart = [F.greatest(F.lit(0.0), F.col(f"{a}_low")[i] - F.col(f"{b}_high")[i], F.col(f"{b}_low")[i] - F.col(f"{a}_high")[i]) for i in range(DIMS)]
    return sum((x * x for x in apart[1:]), apart[0] * apart[0])


def tile_pairs(tiles: DataFrame, width: float) -> DataFrame:
    """(label, size, a, b) with a <= b: pairs of tiles that aren't provably distant. tiles: (label, size, number, low, high)."""
    top = (tiles.agg(F.max("number")).first()[0] or 0).bit_length()
    levels = -(-top // DIGITS)
    pairs = tiles.select("label", "size").distinct().select("label", "size", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        box = [F.array(*(f(F.col(c)[i]) for i in range(DIMS))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
        parts = tiles.groupBy("label", "size", F.shiftright("number", DIGITS * level).alias("number")).agg(*box)
        parts = common.stored(parts, "intervals", light=True)
        for side in "ab":
            own = parts.select("label", "size", F.shiftright("number", DIGITS).alias(side), F.col("number").alias(f"{side}_part"), F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high"))
            pairs = pairs.join(own, ["label", "size", side])
        pairs = pairs.filter((F.col("a_part") <= F.col("b_part")) & (_gap("a", "b") <= width * width + SLACK))
        pairs = common.stored(pairs.select("label", "size", F.col("a_part").alias("a"), F.col("b_part").alias("b")), "tile-pairs")
    return pairs


# --- a pair of tiles ------------------------------------------------------------------------------------------------


@dataclass
class Side:
    """A tile in a task: vectors as they are and of length 1, counts, and for every level its intervals' boxes and balls."""

    raw: np.ndarray
    unit: np.ndarray
    counts: np.ndarray
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    centre: list[np.ndarray] = field(default_factory=list)
    radius: list[np.ndarray] = field(default_factory=list)
    start: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, vectors: bytes, counts: bytes, size: int, kind, along: np.ndarray) -> Side:
        raw = np.frombuffer(vectors, kind).reshape(-1, size)
        side = cls(raw, units(raw), np.frombuffer(counts, np.int64).astype(np.float64))
        y = leading(side.unit, along)
        step = LEAF
        while True:
            start = np.arange(0, len(raw), step)
            sizes = np.diff(np.r_[start, len(raw)])
            centre = np.add.reduceat(side.unit, start) / sizes[:, None]
            far = np.sqrt(((side.unit - np.repeat(centre, sizes, 0)) ** 2).sum(1))
            for column, value in ((side.low, np.minimum.reduceat(y, start)), (side.high, np.maximum.reduceat(y, start)), (side.centre, centre), (side.radius, np.maximum.reduceat(far, start)), (side.start, np.r_[start, len(raw)])):
                column.append(value)
            if len(start) == 1:
                return side
            step *= 2

    def at(self, level: int, i: int) -> slice:
        return slice(self.start[level][i], self.start[level][i + 1])


def _hooked(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Make the trees of u[i] and v[i] one; every node points to its tree's smallest."""
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _linked(a: Side, b: Side, x: slice, y: slice, least: float) -> np.ndarray:
    """Which vectors of a run of a are linked with which of a run of b."""
    cosine = a.unit[x] @ b.unit[y].T
    found = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < SLACK), strict=True):
        p, q = a.raw[x.start + i].astype(np.float64), b.raw[y.start + j].astype(np.float64)
        found[i, j] = p @ q / np.sqrt(p @ p) / np.sqrt(q @ q) >= least
    return found


def compare(a: Side, b: Side | None, least: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the vectors of two tiles, or of one with itself: the number of vectors of other classes that each is linked
    with, and the first vector of what hangs together (places; b's come after a's)."""
    same, b = b is None, b or a
    off = 0 if same else len(a.unit)
    links, root = np.zeros(off + len(b.unit)), np.arange(off + len(b.unit))
    tops = len(a.low) - 1, len(b.low) - 1
    pairs = np.zeros((1, 2), np.int64)
    for level in range(max(tops), -1, -1):
        la, lb = (min(level, t) for t in tops)
        if level < max(tops):  # to the parts of both, where they have parts on this level
            half = [np.array([0, 1]) if level < t else np.array([0]) for t in tops]
            i, j = (pairs[:, k] * 2 if level < tops[k] else pairs[:, k] for k in (0, 1))
            pairs = np.stack([np.add.outer(i, np.repeat(half[0], len(half[1]))).ravel(), np.add.outer(j, np.tile(half[1], len(half[0]))).ravel()], 1)
            pairs = pairs[(pairs[:, 0] < len(a.low[la])) & (pairs[:, 1] < len(b.low[lb]))]
            if same:
                pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        i, j = pairs.T
        gap = np.maximum(0, np.maximum(a.low[la][i] - b.high[lb][j], b.low[lb][j] - a.high[la][i]))
        between = np.sqrt(((a.centre[la][i] - b.centre[lb][j]) ** 2).sum(1))
        reach = a.radius[la][i] + b.radius[lb][j]
        near = between + reach < width - 1e-6
        for p, q in pairs[near]:  # every one is linked with every one
            x, y = a.at(la, p), b.at(lb, q)
            links[x] += b.counts[y].sum() - (a.counts[x] if same and p == q else 0)
            if not (same and p == q):
                links[off + y.start : off + y.stop] += a.counts[x].sum()
            own = np.r_[np.arange(x.start, x.stop), np.arange(off + y.start, off + y.stop)]
            _hooked(root, own[:-1], own[1:])
        pairs = pairs[~near & ((gap * gap).sum(1) <= width * width + SLACK) & (between - reach <= width + 1e-6)]
    for p, q in pairs:
        x, y = a.at(0, p), b.at(0, q)
        found = _linked(a, b, x, y, least)
        if same and p == q:
            np.fill_diagonal(found, False)
        u, v = np.nonzero(found)
        if len(u):
            links[x] += found @ b.counts[y]
            if not (same and p == q):
                links[off + y.start : off + y.stop] += a.counts[x] @ found
            _hooked(root, u + x.start, v + off + y.start)
    return links.astype(np.int64), root


def _compared(kind, along: np.ndarray, least: float, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, a_base, a_vectors, a_counts, b_base, b_vectors, b_counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = Side.of(a_vectors, a_counts, size, kind, along)
                b = None if a_base == b_base else Side.of(b_vectors, b_counts, size, kind, along)
                links, root = compare(a, b, least, width)
                ids = a_base + np.arange(len(a.unit))
                ids = ids if b is None else np.r_[ids, b_base + np.arange(len(b.unit))]
                some = links > 0
                yield pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], ["id", "links", "root"])

    return run


# --- the whole ------------------------------------------------------------------------------------------------------


def _classes(tiles: DataFrame) -> DataFrame:
    """(id, label, digest, least) of every class."""
    return tiles.select("base", "label", F.posexplode(F.arrays_zip("digests", "leasts")).alias("at", "of")).select((F.col("base") + F.col("at")).alias("id"), "label", F.col("of.digests").alias("digest"), F.col("of.leasts").alias("least"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: pairs with one label and a cosine of least (above 0) or more are linked.

    n_links counts the other vectors that are linked directly; component_id is the smallest key that can be reached by links."""
    spark, width = vectors.sparkSession, (2 - 2 * least) ** 0.5
    counts = common.finite(vector) & F.col(label).isNotNull() & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    digest = F.unhex(F.md5(F.array_join(F.col(vector).cast("array<string>"), ",")))
    rows = vectors.select(F.col(key).alias("key"), F.when(counts, F.col(label)).alias("label"), F.when(counts, digest).alias("digest"))
    rows = common.stored(rows, "rows")
    own = vectors.filter(counts).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"), digest.alias("digest"))
    classes = own.groupBy("label", "digest").agg(F.any_value("vector").alias("vector"), F.count("*").alias("n"), F.min("key").alias("least"))
    classes = common.stored(classes.select("vector", "label", "digest", "n", "least"), "classes")
    along = axes(classes)
    kinds = {f.name: f.dataType for f in classes.schema}
    celled = T.StructType([T.StructField("cells", T.ArrayType(T.IntegerType())), *classes.schema.fields])
    # cells are made twice, for the ranges and for the rows, and not written: that would be all vectors once more; equal cells may lie in several ranges
    cells = classes.transform(common.in_arrow, _celled(along, width), celled)
    ordered = cells.repartitionByRange(common.shards(spark), "label", F.size("vector"), "cells", "digest").sortWithinPartitions("label", F.size("vector"), "cells", "digest")
    shape = T.StructType([T.StructField("label", kinds["label"])])
    for name, kind in (("size", T.IntegerType()), ("part", T.LongType()), ("seq", T.LongType()), ("vectors", T.BinaryType()), ("counts", T.BinaryType()), ("digests", T.ArrayType(T.BinaryType())), ("leasts", T.ArrayType(kinds["least"])), ("low", T.ArrayType(T.DoubleType())), ("high", T.ArrayType(T.DoubleType()))):
        shape = shape.add(name, kind)
    tiles = common.stored(ordered.select("vector", "label", "digest", "n", "least").transform(common.in_arrow, _tiles(along, tile), shape), "tiles", packed=True)
    bits = (tiles.agg(F.max("seq")).first()[0] or 0).bit_length()
    number = F.shiftleft("part", bits).bitwiseOR(F.col("seq"))
    tiles = tiles.withColumn("number", number).withColumn("base", F.shiftleft(number, tile.bit_length()))
    pairs = tile_pairs(tiles.select("label", "size", "number", "low", "high"), width)
    for side in "ab":
        pairs = pairs.join(tiles.select("label", "size", F.col("number").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("base", "vectors", "counts"))), ["label", "size", side])
    kind = np.float32 if kinds["vector"].elementType == T.FloatType() else np.float64
    met = pairs.select("size", "a_base", "a_vectors", "a_counts", "b_base", "b_vectors", "b_counts")
    found = common.stored(met.transform(common.in_arrow, _compared(kind, along, least, width), "id long, links long, root long"), "links")

    members = common.stored(components.components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "members")
    named = _classes(tiles)
    leasts = members.join(named.select(F.col("id").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    leasts = common.stored(leasts, "leasts")
    of = common.joined(members, leasts, ["root"], "n", members.count()).select(F.col("node").alias("id"), "component")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = named.join(of, "id", "left").join(links, "id", "left").join(classes.select("label", "digest", "n"), ["label", "digest"])
    told = told.select("label", "digest", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    told = common.stored(told, "told")
    lone = rows.filter("digest IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    done = common.joined(rows.filter("digest IS NOT NULL"), told, ["label", "digest"], "n", rows.count()).select("key", "n_links", "component_id").unionByName(lone)
    return done.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
