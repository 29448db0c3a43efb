"""Text scalars: white space and lines as Python has them, edit-distance rates, diffs.

Null text gives null. A reference without characters (or words) has no rate: null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from pagewright.functions import diffs, distance

# The code points that str.split() and str.strip() take as white space, as a character class.
PY_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Where str.splitlines() ends a line.
PY_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Words joined by single spaces; no space at either end."""
    return F.trim(F.regexp_replace(text, f"{PY_SPACE}+", " "))


def normalized(text: Column, strip_ends: bool = True, collapse_spaces: bool = True) -> Column:
    return collapse(text) if collapse_spaces else strip(text) if strip_ends else text


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, PY_SPACE, "") == ""


def split_lines(text: Column) -> Column:
    """Lines without their ends; an end at the end of the text begins no further line."""
    parts = F.split(text, PY_LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def page_terminated(text: Column) -> Column:
    return F.concat(strip(text), F.lit("\n"))


def _rate(edits: Column, size: Column) -> Column:
    return F.when(size > 0, edits / size)


def cer_builtin(reference: Column, hypothesis: Column) -> Column:
    """Character error rate by the built-in distance: for short strings (its cost is the product of the lengths)."""
    edits = F.when(reference == hypothesis, 0).otherwise(F.levenshtein(reference, hypothesis))
    return _rate(edits, F.char_length(reference))


def edit_distance(a: str, b: str) -> int:
    return 0 if a == b else distance.single(list(a), list(b))


def word_distance(a: str, b: str) -> int:
    return 0 if a == b else distance.single([w for w in a.split(" ") if w], [w for w in b.split(" ") if w])


def _batched(of: Callable, a: pd.Series, b: pd.Series) -> pd.Series:
    """A distance of the pairs of a batch that have two different texts; equal ones are 0 apart, null ones have none."""
    there = (a.notna() & b.notna()).to_numpy()
    out, differ = pd.Series(np.zeros(len(a), np.int64)).astype("Int64"), there & (a != b).to_numpy()
    out[~there] = pd.NA
    if differ.any():
        out[differ] = of(a[differ].tolist(), b[differ].tolist())
    return out


@F.pandas_udf(LongType())
def edit_distance_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield _batched(distance.of_texts, a, b)


@F.pandas_udf(LongType())
def word_distance_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield _batched(distance.of_words, a, b)


#: Product of two lengths up to which the built-in distance is used; its cost is that product.
BUILT_IN_CELLS = 16_000


def edits(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of texts of any length: short ones by the built-in function, others by the bit-parallel one, which gets
    nulls in place of the short ones."""
    short = F.char_length(reference).cast("long") * F.char_length(hypothesis) <= BUILT_IN_CELLS  # a product of ints overflows
    only = lambda c: F.when(~short, c)
    return F.when(short, F.levenshtein(reference, hypothesis)).otherwise(edit_distance_udf(only(reference), only(hypothesis)))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate, for texts of any length."""
    return _rate(edits(reference, hypothesis), F.char_length(reference))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate: words are what stands between spaces, empty ones dropped."""
    return _rate(word_distance_udf(reference, hypothesis), F.size(words(reference)))


def wer_builtin(reference: Column, hypothesis: Column) -> Column:
    """Word error rate without a user function: every distinct word of the two becomes a character. For texts of up to
    about 20,000 distinct words together; beyond that null (use ``wer``)."""
    a, b = words(reference), words(hypothesis)
    vocabulary = F.array_distinct(F.concat(a, b))

    def coded(own: Column) -> Column:
        code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 0x4DFF), 4, "0")), "UTF-16BE")
        return F.array_join(F.transform(own, code), "")

    return F.when(F.size(vocabulary) < 20_000, _rate(F.levenshtein(coded(a), coded(b)), F.size(a)))


def accuracy(error_rate: Column) -> Column:
    """1 - error rate: an extension; below 0 where there are more edits than characters."""
    return 1 - error_rate


#: What a diff calls the two texts.
DIFF_NAMES = ("ocr_raw", "llm_corrected")


def _headed(hunks: list[str], names: tuple[str, str] = DIFF_NAMES) -> str:
    return f"--- {names[0]}+++ {names[1]}" + "".join(hunks) if hunks else ""


def diff_text(before: str, after: str, names: tuple[str, str] = DIFF_NAMES) -> str:
    """A unified diff with three lines of context; empty for equal texts. Header lines have no line ends of their own."""
    return _headed([h["text"] for h in diffs.hunks(before, after)], names)


_HUNK = StructType([*(StructField(c, IntegerType()) for c in ("old_start", "old_lines", "new_start", "new_lines")), StructField("text", StringType())])


@F.pandas_udf(ArrayType(_HUNK))
def hunks(before: pd.Series, after: pd.Series) -> pd.Series:
    """The hunks of a line diff (starts count from 0); none for equal texts."""
    return pd.Series([None if a is None or b is None else diffs.hunks(a, b) for a, b in zip(before, after, strict=True)])


def unified_diff(before: Column, after: Column) -> Column:
    """The hunks of two texts under a header; empty for equal texts."""
    whole = F.concat(F.lit(_headed([""])), F.array_join(hunks(before, after)["text"], ""))
    return F.when(before == after, "").when(before.isNotNull() & after.isNotNull(), whole)
