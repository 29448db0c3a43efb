"""Token counts by pre-token: every distinct pre-token is cut into pieces once, its count is joined to the documents'
pre-token frequencies, and the sums never see an id.

The texts are read once. Each task numbers the pre-tokens that it meets and writes every document's frequencies by number,
and, for each shard, the pre-tokens that belong there by hash. The shards count the pieces, each distinct pre-token once,
and answer with counts in the order asked; a part's counts then meet its documents' frequencies. Nothing is broadcast, a
frequent pre-token costs a part one line, and the path is the same at every size.

A tokenizer file (``tokenizers`` JSON) is a parameter: byte-level BPE without a normalizer or a prefix space; another kind
is refused. Special strings inside a text count as the library's default has it: one token each. Null text is empty (0
tokens). Repeated rows give repeated results; an empty table an empty one. Other columns of docs don't matter.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  loads pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A part of a task ends at so many stretches or pre-tokens, or bytes of text.
CACHE, PART_BYTES = 400_000, 64 << 20


#: A stretch of Latin letters with marks at its end: two pre-tokens of a byte-level tokenizer, or one without marks.
_SIMPLE = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:?!]*)").fullmatch


class PreTokens:
    """Cuts a text into stretches whose pre-tokens don't depend on what stands around them, and those into pre-tokens.

    A single U+0020 between two characters that aren't white space always begins a pre-token of a byte-level tokenizer,
    so a text may be cut there; the library itself cuts the stretches.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        way = said["pre_tokenizer"] or {}
        plain = not said["normalizer"] and way.get("type") == "ByteLevel" and way.get("use_regex") and not way.get("add_prefix_space")
        if not plain or said["model"]["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        specials = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))).split if specials else None
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.space = self.library.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        letters = [chr(x) for x in range(0xC0, 0x100) if chr(x).isalpha()]
        self.byte_level = str.maketrans({x: "".join(p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(x)) for x in letters})

    def stretches(self, text: str) -> tuple[list[str], int]:
        """Stretches, and how many special strings stood between them. A stretch that continues a text has its space."""
        parts = self.special(text) if self.special else [text]
        found: list[str] = []
        for part in parts:
            if part:
                first, *rest = self.cut(part)
                found.append(first)
                found += [" " + x for x in rest]
        return found, len(parts) - 1

    def of(self, simple: list[str], after: list[str], other: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of stretches in turn, and how many each has. The library cuts those that aren't simple. after: with
        a space before and no white space at their ends, so that they part from each other when they are cut together."""
        parts = [x for stretch in simple for x in _SIMPLE(stretch).groups()]
        parts[::2] = "\n".join([x if x.isascii() else x.translate(self.byte_level) for x in parts[::2]]).replace(" ", self.space).split("\n") if parts else []
        sizes = [np.fromiter((1 + bool(x) for x in parts[1::2]), np.int64, len(simple))]
        found = self.library.pre_tokenizer.pre_tokenize_str("".join(after)) if after else []
        words = [x for x in parts if x] + [piece for piece, _ in found]
        starts = np.fromiter((start for _, (start, _) in found), np.int64, len(found))
        sizes.append(np.diff(np.searchsorted(starts, np.cumsum([0, *map(len, after)]))))
        rest = [self.library.pre_tokenizer.pre_tokenize_str(x) for x in other]
        words += [piece for own in rest for piece, _ in own]
        return words, np.concatenate([*sizes, np.array([len(own) for own in rest], np.int64)])

    def pieces(self, pre_token: str) -> int:
        return len(self.library.model.tokenize(pre_token))


@functools.lru_cache(2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


_SENT = ["part", "shard", "ids", "sizes", "special", "ends", "numbers", "times", "words"]


def sorted_out(stretches: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(simple, after, other), as ``PreTokens.of`` takes them."""
    kinds: tuple[list[str], list[str], list[str]] = [], [], []
    for x in stretches:
        kinds[0 if _SIMPLE(x) else 1 if x[0] == " " and x[1:2].strip() and x[-1].strip() else 2].append(x)
    return kinds


class _Part:
    """The pre-tokens that a task has met since the part began, by number."""

    def __init__(self, by: PreTokens):
        self.by, self.name, self.bytes = by, uuid.uuid4().hex, 0
        self.number: dict[str, int] = {}
        self.place: dict[str, int] = {}  # of stretches; their pre-tokens are side by side
        self.begin, self.owned = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _learn(self, stretches: list[str]) -> None:
        new = [x for x in dict.fromkeys(stretches) if x not in self.place]
        count, begins, owned = self.number.setdefault, [self.begin], [self.owned]
        for i in range(0, len(new), 20_000):
            kinds = sorted_out(new[i : i + 20_000])
            words, sizes = self.by.of(*kinds)
            self.place.update(zip(chain(*kinds), range(len(self.place), len(self.place) + len(sizes)), strict=True))
            owned.append(np.array([count(w, len(self.number)) for w in words], np.int64))
            begins.append(begins[-1][-1] + np.cumsum(sizes))
        self.begin, self.owned = np.concatenate(begins), np.concatenate(owned)

    def frequencies(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, numbers, times): how often each document has which pre-token."""
        stretches = list(chain.from_iterable(docs))
        self._learn(stretches)
        at = np.fromiter(map(self.place.__getitem__, stretches), np.int64, len(stretches))
        owner = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
        size = self.begin[at + 1] - self.begin[at]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        wide = max(1, len(self.number))
        key, times = np.unique(np.repeat(owner, size) * wide + self.owned[np.repeat(self.begin[at], size) + within], return_counts=True)
        return np.searchsorted(key, np.arange(1, len(docs) + 1) * wide), key % wide, times

    def by_shard(self, n: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
        """(shard, numbers, words with a line end between) for each shard."""
        raws = [x.encode() for x in self.number]
        shard = np.fromiter(map(zlib.crc32, raws), np.int64, len(raws)) % n
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(n + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            mine = order[cuts[s] : cuts[s + 1]]
            yield s, mine, b"\n".join([raws[i] for i in mine.tolist()])


def _packed(array: np.ndarray, kind: str) -> bytes:
    return zlib.compress(array.astype(kind).tobytes(), 1)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind).astype(np.int64)


def _steps(numbers: np.ndarray) -> bytes:
    """Numbers that mostly ascend, as steps."""
    return _packed(np.diff(numbers, prepend=0), "<i4")


def _numbers(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw, "<i4"))


def _row(part: str, shard: int, ids: pa.Array, *blobs: bytes | None) -> pa.RecordBatch:
    whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.record_batch([pa.array([part]), pa.array([shard], pa.int32()), whole, *(pa.array([x], pa.binary()) for x in blobs)], _SENT)


def _frequencies(path: str, n: int):
    """A row for some documents (shard -1), with their frequencies; at a part's end a row for each shard, with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = pre_tokens(path)
        part, none = _Part(by), None
        for batch in common.and_none(common.slices(batches, 1, 4 << 20)):
            if batch is not None:
                none = batch.column(0).slice(0, 0)
                texts = batch.column(1).to_pylist()
                cut = [by.stretches(x or "") for x in texts]
                ends, numbers, times = part.frequencies([x for x, _ in cut])
                sizes, special = np.array([len((x or "").encode()) for x in texts]), np.array([s for _, s in cut])
                part.bytes += int(sizes.sum())
                yield _row(part.name, -1, batch.column(0), _packed(sizes, "<i8"), _packed(special, "<i8"), _packed(ends, "<i8"), _steps(numbers), _packed(times, "<u4"), None)
            if part.bytes and (batch is None or part.bytes > PART_BYTES or max(len(part.place), len(part.number)) > CACHE):
                for shard, asked, words in part.by_shard(n):
                    yield _row(part.name, shard, none, None, None, None, _steps(asked), None, zlib.compress(words, 1))
                part = _Part(by)

    return run


def _counted(path: str):
    """The pieces of the pre-tokens asked for, in their order; each distinct one is cut once a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, known = pre_tokens(path), {}
        for batch in batches:
            for row in batch.to_pylist():
                words = zlib.decompress(row["words"]).decode().split("\n")
                for word in words:
                    if word not in known:
                        known[word] = by.pieces(word)
                pieces = np.array([known[w] for w in words])
                yield pa.record_batch([pa.array([row["part"]]), pa.array([row["shard"]], pa.int32()), pa.array([row["numbers"]], pa.binary()), pa.array([_packed(pieces, "<u4")], pa.binary())], ["part", "shard", "numbers", "times"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """One part: the pieces of its pre-tokens by number, then the sum of each document."""
    shard = table["shard"].to_numpy()
    answers, texts = table.filter(pa.array(shard >= 0)), table.filter(pa.array(shard < 0))
    numbers = [_numbers(x) for x in answers["numbers"].to_pylist()]
    pieces = np.zeros(1 + max((int(x.max()) for x in numbers), default=0), np.int64)
    for own, found in zip(numbers, answers["times"].to_pylist(), strict=True):
        pieces[own] = _unpacked(found, "<u4")
    ids, sizes, sums = [], [], []
    for row in range(texts.num_rows):
        raw = {c: texts[c][row].as_py() for c in ("sizes", "special", "ends", "numbers", "times")}
        total = np.r_[0, np.cumsum(pieces[_numbers(raw["numbers"])] * _unpacked(raw["times"], "<u4"))]
        ends = _unpacked(raw["ends"], "<i8")
        sums.append(total[ends] - total[np.r_[0, ends[:-1]]] + _unpacked(raw["special"], "<i8"))
        sizes.append(_unpacked(raw["sizes"], "<i8"))
        ids.append(texts["ids"][row].values)
    return pa.table({"id": pa.chunked_array(ids, table["ids"].type.value_type), "n_bytes": np.concatenate(sizes or [np.zeros(0, np.int64)]), "n_tokens": np.concatenate(sums or [np.zeros(0, np.int64)])})


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for each row of docs."""
    n = common.shards(docs.sparkSession)
    kind = common.ddl(docs.schema[key].dataType)
    schema = f"part string, shard int, ids array<{kind}>, sizes binary, special binary, ends binary, numbers binary, times binary, words binary"
    # parts have random names, so they are stored before they are read twice
    sent = common.stored(docs.select(F.col(key), F.col(text)).transform(common.in_arrow, _frequencies(tokenizer, n), schema), "frequencies", packed=True)
    asked = sent.filter("shard >= 0").select("part", "shard", "numbers", "words").repartitionById(n, F.col("shard"))
    answers = asked.transform(common.in_arrow, _counted(tokenizer), "part string, shard int, numbers binary, times binary")
    texts = sent.filter("shard < 0").drop("words")
    return texts.unionByName(answers, allowMissingColumns=True).groupBy("part").applyInArrow(_summed, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", key)
