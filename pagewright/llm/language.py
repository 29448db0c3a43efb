"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +-1. The vector of a letter trigram binds (multiplies) its letters' vectors, the first
permuted twice, the second once. A text's vector is the sum (bundle) of its trigrams' vectors, a language's prototype the
sum over its texts; a text goes to the prototype with the largest cosine. Trigrams lie within words: runs of letters
(Unicode) with a mark at either end, lower-cased; a letter outside a-z has one of a fixed number of vectors by its
code point.

Null text, and text without a letter, is ``und`` with score 0; so is every text if nothing was learned. Texts whose
language is null teach nothing. Equal cosines go to the first language by code point. Repeated rows are handled each for
itself; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 1024
CLASSES = 128  # 0: no letter; 1-26: a-z; the rest: other letters
UNKNOWN = "und"
_SEED = 20240601
#: Bytes of prototypes that may be broadcast.
MODEL_BYTES = 256 << 20


@functools.cache
def _classes() -> np.ndarray:
    found = np.zeros(sys.maxunicode + 1, np.int32)
    for point in range(sys.maxunicode + 1):
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            found[point] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % (1 << 32) * (CLASSES - 27) // (1 << 32)
    return found


@functools.cache
def _letters(dim: int) -> tuple[np.ndarray, ...]:
    own = np.random.default_rng(_SEED).integers(0, 2, (CLASSES, dim), np.int8) * 2 - 1
    return np.roll(own, 2, 1), np.roll(own, 1, 1), own


def _vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    first, second, third = _letters(dim)
    return (first[grams // CLASSES**2] * second[grams // CLASSES % CLASSES] * third[grams % CLASSES]).astype(np.float32)


class Grams:
    """Trigrams of some texts: the distinct ones, and for each occurrence its text and which of them it is."""

    def __init__(self):
        self.place = np.full(CLASSES**3, -1, np.int32)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [x or "" for x in texts]
        codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _classes()[codes]
        owner = np.repeat(np.arange(len(texts) + 1), [len(x) + 1 for x in texts] + [1])  # a text's line end begins it
        keep = np.r_[True, (kind[1:] > 0) | (kind[:-1] > 0)]
        kind, owner = kind[keep], owner[keep]
        mid = np.flatnonzero(kind[1:-1] > 0) + 1
        grams = (kind[mid - 1] * CLASSES + kind[mid]) * CLASSES + kind[mid + 1]
        self.place[grams] = 0
        distinct = np.flatnonzero(self.place >= 0)
        self.place[distinct] = np.arange(len(distinct), dtype=np.int32)
        at = self.place[grams]
        self.place[distinct] = -1
        return distinct, owner[mid], at


def _counts(group: np.ndarray, at: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return np.bincount(group * np.int64(columns) + at, minlength=rows * columns).reshape(rows, columns)


def _bundles(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(), {}
        for batch in common.slices(batches, 1, 2 << 20, 500):
            langs = sorted({x for x in batch.column(0).to_pylist()})
            own = np.array([langs.index(x) for x in batch.column(0).to_pylist()])
            distinct, owner, at = grams.of(batch.column(1).to_pylist())
            if not len(distinct):
                continue
            # exact in float64: sums of whole numbers
            made = _counts(own[owner], at, len(langs), len(distinct)).astype(np.float64) @ _vectors(distinct, dim)
            for lang, vector in zip(langs, made, strict=True):
                sums[lang] = sums.get(lang, 0) + vector
        for lang, vector in sums.items():
            yield pa.record_batch([pa.array([lang]), pa.array([vector.astype(np.int64)], pa.list_(pa.int64()))], ["lang", "bundle"])

    return run


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes): each task sends one vector per language, summed by (language, dimension)."""
    taught = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text))
    cells = taught.transform(common.in_arrow, _bundles(dim), "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = cells.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells")).select("lang", F.col("cells.value").alias("vector"))
    rows = common.stored(rows, "prototypes")
    if (n := rows.count()) * dim * 4 > MODEL_BYTES:
        raise ValueError(f"{n} languages: their prototypes are larger than {MODEL_BYTES} bytes")
    found = sorted((r.lang, r.vector) for r in rows.collect())
    return [x for x, _ in found], np.array([v for _, v in found], np.float32).reshape(len(found), dim)


def _predicted(model, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = model.value
        grams = Grams()
        norms = np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
        unit = (prototypes / norms).astype(np.float32)
        for batch in common.slices(batches, 1, 1 << 20, 64):
            distinct, owner, at = grams.of(batch.column(1).to_pylist())
            n = batch.num_rows
            pred, score, n_grams = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
            if len(distinct) and langs:
                vectors = _counts(owner, at, n, len(distinct)).astype(np.float32) @ _vectors(distinct, dim)
                size = np.linalg.norm(vectors, axis=1)
                cosine = vectors @ unit.T / np.maximum(size, 1e-9)[:, None]
                n_grams = np.bincount(owner, minlength=n).astype(np.int64)
                some = n_grams > 0
                best = cosine.argmax(1)
                pred = [langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                score = np.where(some, np.clip(cosine.max(1), 0, 1), 0).astype(np.float64)
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(n_grams)], ["id", "lang_pred", "score", "n_grams"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, n_grams) of each row; n_grams is how many trigrams the score stands on. key may be a struct that carries other columns along."""
    kind = common.ddl(docs.schema[key].dataType)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(key), F.col(text)).transform(common.in_arrow, _predicted(held, model[1].shape[1]), f"id {kind}, lang_pred string, score double, n_grams long").withColumnRenamed("id", key)


def remainder(key: str, modulus: int):
    """crc32 of a key as text (null: empty) modulo a number."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus
