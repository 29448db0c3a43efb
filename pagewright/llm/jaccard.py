"""Exact Jaccard self-join of documents' word shingles by token-combination prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes (two different shingles of one pair of documents
share a hash with probability about 1e-14). Documents with equal sets are one node of the link graph (by a 64-bit hash of
the set). Two nodes link when 100 * intersection >= 75 * union.

Shingles are ordered by class, each class by hash: lone ones (in one set), rare ones, frequent ones (in ``frequent_at`` sets
or more). The class is told by two broadcast bitmaps of bounded size, in which a few count as more frequent than they are.
A set may miss at most slack = n - ceil(0.75 n) of its shingles in a similar set. So if its prefix holds slack + 1 lone or
rare shingles, a similar set's prefix shares one of them: rare ones are indexed alone, lone ones can't be shared and need no
entry, and a set whose prefix is lone ones only is similar to no other. A set with fewer of both extends its prefix into the
frequent ones, which are dealt by hash to groups: a group of g frequent shingles in the prefix is sure to give a common pair
once more than one of them is matched, so it counts g - 1; the prefix ends when single ones and groups count slack + 1, and
all pairs within a group are indexed. The number of groups follows the size: a set is indexed with the groups of its size
class and of the next smaller one, so two sets of similar size always share a scheme. Sets of 1 or 2 shingles are similar to
equal sets only.

Sets that share an index entry are candidates; each is verified in full. An entry's sets aren't paired with each other at
once: first all meet one of them, the hub, and verified links are contracted to components. An entry whose sets are in one
component then is done, so a group of copies costs a comparison a set, whatever its size. What is left, entries with sets in
several components, is brought together by what such entries chain: a chain's sets, with their entries, go to a block, or
to blocks of similar size that meet in pairs where there are too many for one. There two sets are compared if they share an
entry and aren't in one component yet: first by size, then by bitmaps (where these differ in so many bits that the sets
can't be similar, they aren't), then in full. So pairs that may be similar but aren't are never rows. Only links that join
components come out, not all links. Any choice of classes and blocks gives equal results.

Null or wordless text has an empty set, linked with nothing. A null key is no candidate for a component's smallest key
(null if all are). Repeated rows get equal results; an empty table gives an empty one. Extra columns of docs don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
PERCENT = 75
#: Sets that a frequent shingle is in, at least.
FREQUENT_AT = 4
#: Bytes of each of the two bitmaps of shingles at most.
BITMAP_BYTES = 32 << 20
#: A block of a chain: so many sets and shingles at most, about; and ROOT_SETS times the root of its class's sets, so that
#: the pairs of blocks are dealt to many tasks before a block is full.
BLOCK_SETS, BLOCK_SHINGLES, ROOT_SETS = 4096, 4_000_000, 5
_HELD = 1_000_000
#: Bytes of text whose words are objects at once.
_TEXT_BYTES = 2 << 20
_SEED = 11
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def sets_of(raws: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    place: dict[bytes, int] = {}
    put, ids, sizes = place.setdefault, [], []
    for raw in raws:
        own = raw.lower().split()
        ids += [put(w, len(place)) for w in own]
        sizes.append(len(own))
    hashes = np.array([xxhash.xxh64_intdigest(w, _SEED) for w in place], np.uint64)
    flat = hashes[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
    n = len(flat) - words + 1
    if n > 0:
        made = flat[:n] * _ODD[0]
        for i in range(1, words):
            made += common.mixed(flat[i : n + i] + _ODD[i % 8]) * _ODD[(i + 3) % 8]
        made = common.mixed(made)
    out, at = [], 0
    for size in sizes:
        if size >= words:
            out.append(np.unique(made[at : at + size - words + 1]))
        elif size:  # fewer words: the whole sequence as one
            out.append(np.array([xxhash.xxh64_intdigest(flat[at : at + size].tobytes(), _SEED)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def node_of(own: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)))


def can_link(n: int, percent: int = PERCENT) -> bool:
    """Whether a set of n can be similar to one that isn't equal: at best to one of n + 1."""
    return 100 * n >= percent * (n + 1)


def slack(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100)


def _ascending(values: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as 32-bit steps; plain where a step is larger."""
    steps = np.diff(values, prepend=values[:1])
    if len(values) and int(steps.max()) < 1 << 32:
        return b"\x01" + values[:1].astype("<u8").tobytes() + steps.astype("<u4").tobytes()
    return b"\x00" + values.astype("<u8").tobytes()


def _values(raw: bytes) -> np.ndarray:
    if raw[0]:
        return np.cumsum(np.frombuffer(raw, "<u4", offset=9), dtype=np.uint64) + np.frombuffer(raw[1:9], "<u8")[0]
    return np.frombuffer(raw, "<u8", offset=1)


def _dealt(values: np.ndarray, other: np.ndarray, bits: int, n: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted numbers of so many bits, and what goes with each (packed), by shards of equal ranges."""
    shard = (values * np.uint64(n) >> np.uint64(bits)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange(n + 1))
    for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield s, _ascending(values[cuts[s] : cuts[s + 1]]), zlib.compress(other[cuts[s] : cuts[s + 1]].tobytes(), 1)


_CENSUS = ("shard", "values", "other")


def _surveyed(n: int, words: int, percent: int, kind: str):
    """Each row's id, size and node; and by shard, how many sets each shingle is in, each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, id_type = [], 0, set(), None
        for batch in common.and_none(common.slices(batches, 1, _TEXT_BYTES)):
            if batch is not None:
                sets = sets_of(common.byte_values(batch.column(1)), words)
                nodes = [node_of(x) if len(x) else None for x in sets]
                ids, id_type, none = batch.column(0), batch.column(0).type, len(sets)
                yield pa.record_batch([ids, pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.binary())], ["id", "n_shingles", "node", *_CENSUS])
                for node, own in zip(nodes, sets, strict=True):
                    if can_link(len(own), percent) and node not in seen:
                        seen.add(node)
                        held.append(own)
                        size += len(own)
            if held and (batch is None or size > _HELD):
                values, times = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
                shard, steps, other = zip(*_dealt(values, times.astype("<u4"), 48, n), strict=True)
                none = len(shard)
                yield pa.record_batch([pa.nulls(none, id_type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.array(shard, pa.int32()), pa.array(steps, pa.binary()), pa.array(other, pa.binary())], ["id", "n_shingles", "node", *_CENSUS])
                held, size = [], 0

    return run


def _often(least: tuple[int, ...]):
    """Of a shard, the shingles that are in so many sets or more, for each of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, times = [], []
        for batch in batches:
            for v, t in zip(batch.column("values").to_pylist(), batch.column("other").to_pylist(), strict=True):
                values.append(_values(v))
                times.append(np.frombuffer(zlib.decompress(t), "<u4"))
        if values:
            value, at = np.unique(np.concatenate(values), return_inverse=True)
            total = np.bincount(at, np.concatenate(times))
            for bound in least:
                often = value[total >= bound]
                for i in range(0, len(often), 1 << 20):
                    part = often[i : i + (1 << 20)]
                    yield pa.record_batch([pa.array([bound], pa.int64()), pa.array([_ascending(part)], pa.binary()), pa.array([len(part)], pa.int64())], ["least", "values", "n"])

    return run


def _marked(shift: int):
    """A part of the bitmap for each block of values: where it begins, and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("values").to_pylist():
                places = (_values(raw) >> np.uint64(shift)).astype(np.int64)
                begin = int(places[0]) // 8
                bits = np.zeros((int(places[-1]) // 8 - begin + 1) * 8, bool)
                bits[places - 8 * begin] = True
                yield pa.record_batch([pa.array([begin], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["begin", "bits"])

    return run


class Bitmap:
    """Over the hash range: which shingles may be in so many sets."""

    def __init__(self, table: DataFrame, most_bytes: int):
        total = table.agg(F.sum("n")).first()[0] or 0
        bits = min(max(16, math.ceil(math.log2(10 * total + 1))), int(math.log2(8 * most_bytes)))
        self.shift, self.raw = 48 - bits, np.zeros(1 << max(0, bits - 3), np.uint8)
        for row in table.transform(common.in_arrow, _marked(self.shift), "begin long, bits binary").toLocalIterator():
            part = np.frombuffer(row.bits, np.uint8)
            self.raw[row.begin : row.begin + len(part)] |= part

    def mask(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(16 + self.shift)
        return (self.raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


LONE, RARE, FREQUENT = 0, 1, 2


class Classes:
    """The class of shingles, from the census: at ten bits for each that isn't lone, but most_bytes a bitmap at most. Beyond
    that more count as frequent, which changes the entries (one a shingle at most, about) but not the result."""

    def __init__(self, census: DataFrame, frequent_at: int, most_bytes: int):
        n, least = common.shards(census.sparkSession), (2, max(2, frequent_at))
        sent = census.repartitionById(n, F.col("shard"))
        table = common.stored(sent.transform(common.in_arrow, _often(least), "least long, values binary, n long"), "often")
        self.shared, self.frequent = (Bitmap(table.filter(F.col("least") == bound), most_bytes) for bound in least)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        shared = self.shared.mask(hashes)
        return shared.astype(np.int8) + (shared & self.frequent.mask(hashes))


def entries(own: np.ndarray, kind: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The index entries of a set (sorted hashes, and the class of each)."""
    if not can_link(len(own), percent):
        return own[:0]
    need = slack(len(own), percent) + 1 - int((kind == LONE).sum())
    if need <= 0:
        return own[:0]
    rare = own[kind == RARE]
    if len(rare) >= need:
        return rare[:need]
    often, found = own[kind == FREQUENT], [rare]
    ratio = math.log(100 / percent)
    size_class = int(math.log(len(own)) / ratio + 1e-9)
    for scheme in (size_class, size_class - 1):
        groups = max(1, math.ceil(math.exp(scheme * ratio) / 8))
        group = often % np.uint64(groups)
        first = np.zeros(len(often), bool)
        first[np.unique(group, return_index=True)[1]] = True
        counted = len(rare) + np.cumsum(~first)
        end = int(np.searchsorted(counted, need)) + 1
        order = np.argsort(group[:end], kind="stable")
        token, group = often[:end][order], group[:end][order]
        for apart in range(1, end):
            both = np.flatnonzero(group[apart:] == group[:-apart])
            if not len(both):
                break
            found.append(common.mixed(token[both] * _ODD[0] + common.mixed(token[both + apart]) + np.uint64(scheme * int(_ODD[5]) % (1 << 64))))
    return np.unique(np.concatenate(found))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def _opened(words: int, percent: int, classes):
    """The sets that have index entries, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, seen = classes.value, set()
        for batch in common.slices(batches, 0, _TEXT_BYTES):
            found = {}
            for own in sets_of(common.byte_values(batch.column(0)), words):
                if can_link(len(own), percent) and (node := node_of(own)) not in seen:
                    seen.add(node)
                    found[node] = own
            if not found:
                continue
            sets = list(found.values())
            kinds = np.split(by.of(np.concatenate(sets)), np.cumsum([len(x) for x in sets])[:-1])
            made = [(node, own, index) for node, own, kind in zip(found, sets, kinds, strict=True) if len(index := entries(own, kind, percent))]
            if made:
                nodes, sets, indexes = zip(*made, strict=True)
                yield pa.record_batch([pa.array(nodes, pa.int64()), _lists(sets), _lists(indexes)], ["node", "shingles", "entries"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets (node, shingles) are similar."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    n, m = F.size("x"), F.size("y")
    near = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * both >= percent * (n + m - both))
    return pairs.join(right, "b").join(left, "a").filter(near).select("a", "b")


def joining_links(sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, owned: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (i, j) that join the components of similar sets which share an entry. owned: the entries of each; root: the
    component that each is known to be in. side: 0 and 1; where both occur, only sets of different sides are compared."""
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    wide = 1 << int(np.clip(math.ceil(math.log2(4 * max(1, int(np.median(sizes))))), 8, 14))
    marks = np.zeros((len(sets), wide), bool)
    for row, i in enumerate(order):
        marks[row, (sets[i] & np.uint64(wide - 1)).astype(np.int64)] = True
    bits = np.packbits(marks, axis=1).view(np.uint64)
    del marks
    ordered, side, both_sides = sizes[order], side[order], len(np.unique(side)) > 1
    root = np.unique(root, return_inverse=True)[1][order]
    # rows by entry, and where the entries of each row are
    entry = np.unique(np.concatenate([owned[i] for i in order]), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sets)), [len(owned[i]) for i in order])
    by_entry = np.argsort(entry, kind="stable")
    begin, ends = np.searchsorted(entry[by_entry], np.arange(entry.max(initial=-1) + 2)), np.searchsorted(row, np.arange(len(sets) + 1))
    rows, shares, found = row[by_entry], np.zeros(len(sets), bool), []
    for x in range(len(sets)):
        n = int(ordered[x])
        last = int(np.searchsorted(ordered, 100 * n // percent, "right"))  # none larger can be similar
        open_rows = root[x + 1 : last] != root[x]
        if both_sides:
            open_rows &= side[x + 1 : last] != side[x]
        if not open_rows.any():
            continue
        for e in entry[ends[x] : ends[x + 1]].tolist():
            shares[rows[begin[e] : begin[e + 1]]] = True
        y = x + 1 + np.flatnonzero(open_rows & shares[x + 1 : last])
        shares[:] = False
        most = (n + ordered[y] - np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)) // 2
        y = y[100 * most >= percent * (n + ordered[y] - most)]
        own = sets[order[x]]
        for k in y.tolist():
            if root[k] == root[x]:
                continue
            other = sets[order[k]]
            both = int((other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum())
            if 100 * both >= percent * (n + len(other) - both):
                found.append((int(order[x]), int(order[k])))
                root[root == root[k]] = root[x]
    return found


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) for x in column]


def _met(percent: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        links = joining_links(_arrays(table["shingles"]), table["side"].to_numpy(), table["root"].to_numpy(), _arrays(table["entries"]), percent)
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[at[:, 0]], "b": nodes[at[:, 1]]})

    return run


def block_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components of sets which share an entry, for entries (entry, node, root) with several.

    Blocks of a chain are size classes, cut further by hash where a class is large; a block meets those of its own class
    and of the next, since sets further apart in size can't be similar."""
    hubs = common.stored(left.groupBy("entry").agg(F.min("node").alias("a")), "chain_hubs", light=True)
    chains = components(left.join(hubs, "entry").select("a", F.col("node").alias("b")))
    owned = left.groupBy("node").agg(F.min("root").alias("root"), F.collect_list("entry").alias("entries"))  # a set's own entries
    size_class = F.floor(F.log(F.size("shingles")) / math.log(100 / percent) + 1e-9).cast("int")
    own = sets.join(owned, "node").join(chains.select("node", F.col("root").alias("chain")), "node").withColumn("class", size_class)
    own = common.stored(own, "chains")
    sums = own.groupBy("chain", "class").agg(F.count("*").alias("m"), F.sum(F.size("shingles")).alias("total"))
    blocks = F.greatest(F.floor(F.sqrt("m") / ROOT_SETS), F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    counts = common.stored(sums.select("chain", "class", blocks.alias("k")), "sizes", light=True)
    around = counts.select("chain", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.struct(F.col("class").alias("of"), "k").alias("there"))
    around = around.groupBy("chain", "class").agg(F.collect_list("there").alias("there"))  # three at most
    plan = common.stored(counts.join(around, ["chain", "class"]), "blocks", light=True)
    dealt = own.join(plan, ["chain", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    copies = dealt.withColumn("there", F.explode("there")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("there.k") - 1)))
    mine, theirs = F.struct(F.col("class").alias("c"), F.col("block").alias("b")), F.struct(F.col("there.of").alias("c"), F.col("other").alias("b"))
    pairs = copies.select("chain", F.least(mine, theirs).alias("low"), F.greatest(mine, theirs).alias("high"), mine.alias("mine"), "node", "root", "entries", "shingles")
    pairs = pairs.withColumn("side", (F.col("mine") == F.col("high")).cast("int")).drop("mine")
    return pairs.groupBy("chain", "low", "high").applyInArrow(_met(percent), "a long, b long")


def joined(index: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of all nodes that links join to others. index: (entry, node); sets: (node, shingles)."""
    names = index.groupBy("entry").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("nodes")).filter("low <> high")
    hubs = names.groupBy("low", "high", "n", "nodes").agg(F.min("entry").alias("entry"))  # entries with the same nodes are one
    hubs = common.stored(hubs.select("entry", F.col("low").alias("a")), "hubs", light=True)
    groups = common.stored(index.join(hubs, "entry").filter("node <> a"), "groups")
    links = common.stored(verified(groups.select("a", F.col("node").alias("b")).distinct(), sets, percent), "links")
    roots = common.stored(components(links), "roots", light=True)
    # the hub has met all others, so it is left out; which of them are still apart?
    left = common.stored(groups.select("entry", "node").join(roots, "node", "left").select("entry", "node", F.coalesce("root", "node").alias("root")), "left")
    apart = left.groupBy("entry").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("entry")
    more = block_links(common.stored(left.join(common.stored(apart, "apart", light=True), "entry"), "open"), sets, percent)
    return components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, frequent_at: int = FREQUENT_AT, bitmap_bytes: int = BITMAP_BYTES) -> DataFrame:
    """(key, n_shingles, component_id) of each row: the smallest key that a row reaches by links, itself included."""
    spark, n = docs.sparkSession, common.shards(docs.sparkSession)
    kind = common.ddl(docs.schema[key].dataType)
    survey = docs.select(F.col(key), F.col(text)).transform(common.in_arrow, _surveyed(n, words, percent, kind), f"id {kind}, n_shingles long, node long, shard int, values binary, other binary")
    survey = common.stored(survey, "survey", packed=True)
    members = survey.filter("shard IS NULL").select("id", "n_shingles", "node")
    classes = spark.sparkContext.broadcast(Classes(survey.filter("shard IS NOT NULL").select(*_CENSUS), frequent_at, bitmap_bytes))
    opened = docs.select(F.col(text)).transform(common.in_arrow, _opened(words, percent, classes), "node long, shingles array<long>, entries array<long>")
    opened = common.stored(opened.dropDuplicates(["node"]), "opened", packed=True)  # copies of a set in several tasks are one row again
    roots = joined(opened.select(F.explode("entries").alias("entry"), "node"), opened.select("node", "shingles"), percent)
    rooted = common.stored(members.join(roots, "node", "left").select("id", "n_shingles", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    least = common.stored(least, "least", light=True)  # apart from the join, so that it can split a root with many rows
    return rooted.join(least, "root", "left").select(F.col("id").alias(key), "n_shingles", F.coalesce("least", "id").alias("component_id"))
