"""Best-fit packing of token sequences by the sum-of-squares rule.

Each document's ids plus one end id are laid into sequences of a fixed capacity. A document longer than the capacity is
cut into full pieces and a rest; only rests are packed with others. A rest goes where the sum over all gaps g of
(number of open bins with gap g) squared becomes smallest; a new bin is opened only where no open bin can take it, and
equal sums go to the smallest gap. Rests come longest first. Pieces are dealt at random to shards of about
``shard_pieces`` rests, each packed alone, so the work is spread and a hot source or key is too.

Null text is an empty document (its end id only). Repeated rows are packed each for itself; an empty table gives none.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
SHARD_PIECES = 40_000
#: Entries at which a worker's cache of words or pre-tokens is dropped.
CACHE = 250_000


#: Words that need no library to be cut: letters of Latin-1 (composed, lower-cased letter by letter), then marks.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:?!#*$%&|]*)").fullmatch


#: Words that tell tokenizers apart: capitals, accents, marks, digits, an apostrophe.
_PROBES = ("Hello", "naïve,", "ÉTÉ.", "straße!?", "x&|*", "A1b2", "don't", "ÿþ", "plain", "a.b")


class _Kept(dict):
    """Values by key, made when first asked for; dropped at CACHE entries."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        found = self[key] = self.make(key)
        return found


class Ids:
    """Ids of a text as little-endian 32-bit bytes, by way of caches of its words and of their pre-tokens.

    For byte-level tokenizers that drop white space: no token spans it, so the ids of a text are those of its words in
    turn. Simple words are cut into pre-tokens here, others by the library, and every pre-token into ids by its model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters = [chr(x) for x in range(0xFF + 1) if chr(x).isalpha()]
        self.byte_level = str.maketrans({x: "".join(p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(x)) for x in letters})
        self.words, self.simple = _Kept(self.word), _SIMPLE
        self.part_cache = _Kept(lambda pre_token: np.array([t.id for t in self.library.model.tokenize(pre_token)], "<u4").tobytes())
        self.part = self.part_cache.__getitem__

        self._probe()

    def _probe(self) -> None:
        """Whether this is such a tokenizer: an error if white space counts, the library alone if simple words differ."""
        whole = lambda x: np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        if any(whole(x + gap + y) != whole(x) + whole(y) for gap in (" ", "\n", " \t ") for x, y in zip(_PROBES, _PROBES[1:], strict=False)):
            raise ValueError("the tokens of this tokenizer depend on white space")
        if any(self.word(x.encode()) != whole(x) for x in _PROBES):
            self.simple = lambda word: None
            self.part_cache.clear()

    def word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if simple := self.simple(word):
            letters, marks = simple.groups()
            own = self.part(letters.lower().translate(self.byte_level))
            return own + self.part(marks) if marks else own
        if any(x in word for x in self.specials):
            return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        plain = self.library.normalizer.normalize_str(word) if self.library.normalizer else word
        return b"".join(self.part(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain))

    def all(self, texts: list[bytes]) -> list[bytes]:
        of = self.words.__getitem__
        return [b"".join(map(of, x.split())) for x in texts]


@functools.lru_cache(1)
def _ids(path: str) -> Ids:
    """One for all tasks of a worker."""
    return Ids(path)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, wide = _ids(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in common.slices(batches, 1):
            rows: list[tuple] = []
            for at, raw in enumerate(ids.all(common.byte_values(batch.column(1)))):
                raw += end
                for piece, start in enumerate(range(0, len(raw), wide)):
                    part = raw[start : start + wide]
                    rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            at, *rest = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(0).take(pa.array(at)), *(pa.array(x, pa.int32() if i == 0 else pa.int64()) for i, x in enumerate(rest))], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; a full bin is none
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        here = count[s:]  # by gap from s up
        change = np.where(here > 0, 2 * (count[: capacity - s + 1] - here) + 2, never)
        if here[0]:
            change[0] = 1 - 2 * here[0]  # the bin becomes full and counts no more
        best = int(change.argmin())
        if change[best] == never:
            gap, own = capacity, made
            made += 1
        else:
            gap = s + best
            own = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = own, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(own)
    return bins, offsets


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        lengths, shard = table["length"].to_numpy(), int(table["shard"][0].as_py())
        order = np.lexsort((table["ids_crc32"].to_numpy(), -lengths))
        bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bins[order], offsets[order] = sum_of_squares(lengths[order], capacity)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins + (shard << 40))).append_column("offset", pa.array(offsets))

    return run


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): the pieces of each document's ids."""
    kind = common.ddl(docs.schema[key].dataType)
    return docs.select(F.col(key), F.col(text)).transform(common.in_arrow, _pieces(tokenizer, end_id, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", key)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces (with a ``length`` and ``ids_crc32``) plus sequence_id and offset."""
    pieces = common.stored(pieces, "pieces")  # fixed before the deal, so that a lost task is dealt the same way again
    rests = pieces.filter(F.col("length") < capacity)
    n = max(1, round(rests.count() / shard_pieces))
    dealt = rests.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    fields = ", ".join("`{}` {}".format(f.name.replace("`", "``"), common.ddl(f.dataType)) for f in pieces.schema)
    packed = dealt.groupBy("shard").applyInArrow(_packed(capacity), f"{fields}, sequence_id long, offset long")
    whole = pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)
