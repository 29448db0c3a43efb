"""Language-model scoring with a log-frequency Bloom filter.

Tokens are words (A-Z lower-cased; runs of anything but U+0020 and U+0009-000D) and one end of text, which is also the
context of the first word. The filter holds counts of all words and of all word pairs, quantised to level
1 + floor(log_1.5(count)): every level from 1 up to its own is a member, and probing upwards until the first miss gives
the level back. It is built in slices by hash, each where its n-grams' counts meet, with 10 to 20 bits a member at every
size. A filter within filter_bytes is broadcast with the words' exact counts, if they are within broadcast_bytes; beyond, the
documents' n-grams are sent to their slices, and levels and counts come back, which gives the same scores. The probability of w after v is (count(v, w) + M * p(w)) / (count(v) + M), with
p(w) = (count(w) + 0.5) / (N + 0.5 * (V + 1)), all counts from the filter. The base score has p(w) alone, with exact
counts.

Words go by 64-bit hashes: two different ones that share a hash count as one word. Among 10^9 words that is expected for one
pair in some forty models, among 10^10 for three pairs.

Null text is empty: its end token only. Repeated rows are scored each for itself; an empty table gives an empty one; with
nothing learned every token is unknown (N = V = 0).
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = b"\n"  # can't be a word
BASE = 1.5  # of the quantiser
MASS = 500.0  # M: of 5000, 500, 50 and 5 the one with the best held-out probability on the test tables
PROBES = 4
BITS = 10  # of the filter for each member, before rounding up to a power of two
#: Bytes of the filter that may be broadcast; the n-grams are sent to the slices of a larger one.
FILTER_BYTES = 256 << 20
#: Bytes of exact (hash, count) pairs that may be broadcast; a larger vocabulary is asked by slices, too.
BROADCAST_BYTES = 96 << 20
_PAIRS_HELD = 3_000_000
_SEED = 7


class Flat:
    """Tokens of some texts one after the other: distinct tokens, which of them each token is, and whose it is."""

    def __init__(self, raws: list[bytes]):
        place: dict[bytes, int] = {END: 0}
        put, sizes, at = place.setdefault, [], []
        for raw in raws:
            words = raw.lower().split()
            at += [put(w, len(place)) for w in words]
            at.append(0)
            sizes.append(len(words) + 1)
        self.words, self.at = list(place), np.array(at, np.int64)
        self.sizes, self.owner = np.array(sizes, np.int64), np.repeat(np.arange(len(raws)), sizes)
        self.hashes = np.array([xxhash.xxh64_intdigest(w, _SEED) for w in self.words], np.uint64)

    def pairs(self) -> np.ndarray:
        return pairs_of(self.hashes, self.at)


def pairs_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it; the end of text stands before the first."""
    before = np.r_[0, at[:-1]]  # the token before a text is an end, too
    return pair_keys(hashes[before], hashes[at])


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return common.mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def word_keys(words: np.ndarray) -> np.ndarray:
    return common.mixed(words ^ np.uint64(0xD6E8FEB86659FD93))


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _estimates(most: int = 200) -> np.ndarray:
    """The count that a level stands for: the mean of the whole numbers in it (0 for level 0)."""
    edges = BASE ** np.arange(most + 1)
    low, high = np.ceil(edges[:-1] - 1e-9), np.ceil(edges[1:] - 1e-9) - 1
    return np.r_[0, np.where(high >= low, (low + high) / 2, edges[:-1])]


ESTIMATES = _estimates()


def _starts(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the probes for (key, level): probe i is at start + i * step."""
    start = common.mixed(keys + np.uint64(level * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    return start, (start >> np.uint64(32)) | np.uint64(1)


def slice_bits(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A slice with members (key, 1) to (key, level): bytes of a power-of-two number of bits."""
    members = int(levels.sum())
    size = 1 << max(6, int(np.ceil(np.log2(max(1, members * BITS)))))
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        start, step = _starts(keys[levels >= level], level)
        for i in range(PROBES):
            bits[(start + np.uint64(i) * step) & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """Slices side by side; a key's slice is by its hash."""

    def __init__(self, slices: list[bytes]):
        self.n = len(slices)
        self.raw = np.frombuffer(b"".join(slices), np.uint8)
        sizes = np.array([len(x) * 8 for x in slices], np.uint64)
        self.mask, self.begin = sizes - np.uint64(1), np.r_[np.uint64(0), np.cumsum(sizes)[:-1]].astype(np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), np.int64)
        if not self.n:
            return found
        own = shard_of(keys, self.n)
        mask, begin, left, level = self.mask[own], self.begin[own], np.arange(len(keys)), 1
        while len(left) and level < len(ESTIMATES):  # a slice without a miss ends there, too
            start, step = _starts(keys, level)
            for i in range(PROBES):
                at = ((start + np.uint64(i) * step) & mask) + begin
                hit = (self.raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                keys, mask, begin, left, start, step = (x[hit] for x in (keys, mask, begin, left, start, step))
            found[left] = level
            level += 1
        return found


def _gathered(n: int):
    names = ["shard", "words", "times", "pairs", "pair_times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[np.ndarray] = []

        def sent() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(shard_of(keys, n), np.arange(n + 1))
            own = list(words)
            hashes = word_keys(np.array([xxhash.xxh64_intdigest(w, _SEED) for w in own], np.uint64))
            shard = shard_of(hashes, n)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(n + 1))
            counts = np.fromiter(words.values(), np.int64, len(words))
            for s in range(n):
                if cuts[s] == cuts[s + 1] and ends[s] == ends[s + 1]:
                    continue
                mine = order[ends[s] : ends[s + 1]]
                # words are parted by a byte that can't be in one; the end token is put in its place
                blob = b" ".join([own[i] for i in mine])
                row = [[s], [zlib.compress(blob, 1)], [zlib.compress(counts[mine].astype("<i8").tobytes(), 1)], [keys[cuts[s] : cuts[s + 1]].tobytes()], [zlib.compress(times[cuts[s] : cuts[s + 1]].astype("<u4").tobytes(), 1)]]
                yield pa.record_batch([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], names)
            words.clear()
            held.clear()

        for batch in common.slices(batches, 0):
            flat = Flat(common.byte_values(batch.column(0)))
            for word, times in zip(flat.words, np.bincount(flat.at, minlength=len(flat.words)).tolist(), strict=True):
                words[word] += times
            held.append(flat.pairs())
            if sum(map(len, held)) > _PAIRS_HELD:
                yield from sent()
        yield from sent()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: its slice of the filter, and its words' sorted keys with exact counts."""
    words: Counter = Counter()
    keys, times, shard = [], [], None
    for batch in batches:
        for row in batch.to_pylist():
            shard = row["shard"]
            if row["words"]:
                raw = zlib.decompress(row["words"])
                own = raw.split(b" ") if raw else []
                for word, t in zip(own, np.frombuffer(zlib.decompress(row["times"]), "<i8").tolist(), strict=True):
                    words[word] += t
            keys.append(np.frombuffer(row["pairs"], np.uint64))
            times.append(np.frombuffer(zlib.decompress(row["pair_times"]), "<u4"))
    if shard is None:
        return
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)
    del keys, times, inverse
    known, counts = word_keys(np.array([xxhash.xxh64_intdigest(w, _SEED) for w in words], np.uint64)), np.fromiter(words.values(), np.int64, len(words))
    known, inverse = np.unique(known, return_inverse=True)
    counts = np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.int64)
    bits = slice_bits(np.r_[known, key], level_of(np.r_[counts, total]))
    yield pa.record_batch([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in (bits.tobytes(), known.tobytes(), counts.astype("<i8").tobytes())), pa.array([len(known)]), pa.array([int(counts.sum())])], ["shard", "bits", "known", "counts", "distinct", "total"])


class Exact:
    """Exact counts of words by their sorted keys."""

    def __init__(self, known: np.ndarray, counts: np.ndarray):
        self.known, self.counts = known, counts

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[place] == keys, self.counts[place], 0)


class Model:
    """slices: a row for each shard with its part of the log-frequency Bloom filter and the exact counts of its words, in the
    shared folder; filter and exact: all of them together, or None where they are larger than what may be broadcast; total
    and distinct: N and V."""

    def __init__(self, docs: DataFrame, text: str = "text", filter_bytes: int = FILTER_BYTES, broadcast_bytes: int = BROADCAST_BYTES):
        spark = docs.sparkSession
        self.n = n = common.shards(spark)
        sent = docs.select(F.col(text)).transform(common.in_arrow, _gathered(n), "shard int, words binary, times binary, pairs binary, pair_times binary")
        made = sent.repartitionById(n, F.col("shard")).transform(common.in_arrow, _merged, "shard int, bits binary, known binary, counts binary, distinct long, total long")
        self.slices = common.stored(made, "model", packed=True)
        size, self.total, self.distinct = (x or 0 for x in self.slices.agg(F.sum(F.octet_length("bits")), F.sum("total"), F.sum("distinct")).first())
        self.filter = self.exact = None
        if size <= filter_bytes and self.distinct * 16 <= broadcast_bytes:
            bits, held = [bytes(8)] * n, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for r in self.slices.toLocalIterator():
                bits[r.shard] = bytes(r.bits)
                held.append((np.frombuffer(r.known, np.uint64), np.frombuffer(r.counts, np.int64)))
            self.filter = Filter(bits if self.total else [])
            known, counts = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(known)
            self.exact = Exact(known[order], counts[order])


def _measures(ids: pa.Array, sizes: np.ndarray, at: np.ndarray, hashes: np.ndarray, levels, counts, held) -> pa.RecordBatch:
    """The scores of some texts (as in Flat); levels and counts: of an array of keys."""
    *_, total, distinct = held
    floor, n = total + 0.5 * (distinct + 1), len(sizes)
    owner, own = np.repeat(np.arange(n), sizes), word_keys(hashes)
    about = ESTIMATES[levels(own)]
    context = about[np.r_[0, at[:-1]]]
    both = np.minimum(ESTIMATES[levels(pairs_of(hashes, at))], context)
    chance = (both + MASS * (about[at] + 0.5) / floor) / (context + MASS)
    count = counts(own)
    columns = [np.bincount(owner, np.log10(chance), n), np.bincount(owner, count[at] > 0, n).astype(np.int64), np.bincount(owner, np.log10((count + 0.5) / floor)[at], n)]
    return pa.record_batch([ids, pa.array(sizes), *map(pa.array, columns)], ["id", "n_tokens", "score", "n_known", "base_score"])


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            flat = Flat(common.byte_values(batch.column(1)))
            yield _measures(batch.column(0), flat.sizes, flat.at, flat.hashes, held.value[0].levels, held.value[1].of, held.value)

    return run


def _keys_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The distinct keys of words and pairs, sorted and so by shard, too."""
    return np.unique(np.r_[word_keys(hashes), pairs_of(hashes, at)])


def _asked(n: int):
    """Texts in parts: a row with a part's tokens (shard -1), and its distinct keys in a row for each shard."""
    names = ["part", "shard", "ids", "sizes", "at", "hashes", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            flat = Flat(common.byte_values(batch.column(1)))
            keys = _keys_of(flat.hashes, flat.at)
            cuts = np.searchsorted(shard_of(keys, n), np.arange(n + 1))
            to = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            none = [None] * len(to)
            ids = pa.ListArray.from_arrays(pa.array([0] + [batch.num_rows] * (len(to) + 1), pa.int32()), batch.column(0))
            tokens = ([x, *none] for x in (flat.sizes.astype("<i8").tobytes(), zlib.compress(flat.at.astype("<u4").tobytes(), 1), flat.hashes.tobytes()))
            sent = [None, *(keys[cuts[s] : cuts[s + 1]].tobytes() for s in to)]
            yield pa.record_batch([pa.array([uuid.uuid4().hex] * (len(to) + 1)), pa.array([-1, *to], pa.int32()), ids, *(pa.array(x, pa.binary()) for x in (*tokens, sent))], names)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of keys, and exact counts of those that are words, by their shard's slice, which comes first."""
    own: dict[int, tuple[Filter, Exact]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] is None:
                own = {row["shard"]: (Filter([row["bits"]]), Exact(np.frombuffer(row["known"], np.uint64), np.frombuffer(row["counts"], "<i8")))}
            else:
                keys = np.frombuffer(row["keys"], np.uint64)
                levels, exact = own.get(row["shard"]) or (Filter([]), Exact(keys[:0], keys[:0]))
                packed = (zlib.compress(levels.levels(keys).astype("<u2").tobytes(), 1), zlib.compress(exact.of(keys).astype("<i8").tobytes(), 1))
                yield pa.record_batch([pa.array([row["part"]]), pa.array([row["shard"]], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["part", "shard", "levels", "counts"])


def _put_together(held):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")  # the part's tokens first
        sizes, at, hashes = (table[c][0].as_py() for c in ("sizes", "at", "hashes"))
        sizes, at, hashes = np.frombuffer(sizes, "<i8"), np.frombuffer(zlib.decompress(at), "<u4").astype(np.int64), np.frombuffer(hashes, np.uint64)
        keys = _keys_of(hashes, at)
        levels, counts = (np.concatenate([np.frombuffer(zlib.decompress(x), kind) for x in table[c].to_pylist()[1:]]).astype(np.int64) for c, kind in (("levels", "<u2"), ("counts", "<i8")))
        ids = table["ids"][0].values
        return pa.Table.from_batches([_measures(ids, sizes, at, hashes, lambda x: levels[np.searchsorted(keys, x)], lambda x: counts[np.searchsorted(keys, x)], held.value)])

    return run


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each row.

    The model is broadcast, or asked by slices where it is too large for that. Both give equal results."""
    kind = common.ddl(docs.schema[key].dataType)
    schema = f"id {kind}, n_tokens long, score double, n_known long, base_score double"
    held = docs.sparkSession.sparkContext.broadcast((model.filter, model.exact, model.total, model.distinct))
    rows = docs.select(F.col(key).alias("id"), F.col(text))
    if model.filter is not None:
        found = rows.transform(common.in_arrow, _scored(held), schema)
    else:
        # parts have random names, so they are stored before they are read twice
        asked = common.stored(rows.transform(common.in_arrow, _asked(model.n), f"part string, shard int, ids array<{kind}>, sizes binary, at binary, hashes binary, keys binary"), "asked", packed=True)
        slices = model.slices.select("shard", F.lit(None).cast("string").alias("part"), F.lit(None).cast("binary").alias("keys"), "bits", "known", "counts")
        met = asked.filter("shard >= 0").select("shard", "part", "keys").unionByName(slices, allowMissingColumns=True)
        met = met.repartitionById(model.n, F.col("shard")).sortWithinPartitions(F.col("part").asc_nulls_first())
        answers = met.transform(common.in_arrow, _answered, "part string, shard int, levels binary, counts binary")
        tokens = asked.filter("shard = -1").select("part", "shard", "ids", "sizes", "at", "hashes")
        found = tokens.unionByName(answers, allowMissingColumns=True).groupBy("part").applyInArrow(_put_together(held), schema)
    return found.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
