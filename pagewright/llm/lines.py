"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line occurrence goes if an earlier occurrence, by (key, line number), has the same line or one within one edit (a
character put in, left out or changed), whatever became of that earlier one; the earliest stays. Lines are what stands
between \\n, of any length; those without a visible character always stay.

Near lines: of two lines within one edit let L be the length of the shorter (or equal) one, cut into segments; the edit
lies in one segment, and the lines agree before and after it. So every line emits, for each segment of its own length and
of one less, a hashed key of what stands outside it. Keys that two different lines share mark the few lines whose deletion
neighbourhood within that segment is then emitted as hashed keys: the segment without its i-th character, for every i,
plus the segment itself. Of the lines that share such a key the earliest is the candidate, and its edit distance is
verified. Segments are at most
2048 characters, so the neighbourhood of a long line stays in proportion to it.

Keys are 64-bit hashes that only propose; equality of lines is decided by a 128-bit digest, nearness by levenshtein. Null
text stays null, with no lines. A null key comes last. Repeated rows share the same places and all stay or go alike. An
empty table gives an empty one. Other columns stay; only n_lines and n_dropped replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENTS = 3
SEGMENT_CHARS = 2048
#: Counted bytes of a table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 48 << 20
VISIBLE = r"[^\x00-\x20\x7f]"


def _split(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(place, line): place is (key is null, key, text hash, line number); the hash keeps rows with one key apart."""
    named = docs.filter(F.col(text).isNotNull()).select(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    lines = named.select("none", "key", "hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select(F.struct("none", "key", F.col("hash").alias("text"), "at").alias("place"), "line")


def _segments(length: Column) -> Column:
    return F.greatest(F.lit(SEGMENTS), F.ceil(length / SEGMENT_CHARS)).cast("int")


def _start(s: Column, length: Column, n: Column) -> Column:
    return F.floor(s.cast("long") * length / n).cast("int")


def _cut(lines: DataFrame) -> DataFrame:
    """lines (with line, length) by (shorter, segment): start and end of the segment in the line, and its outside key."""
    both = lines.withColumn("shorter", F.explode(F.array(F.col("length"), F.col("length") - 1)))
    both = both.withColumn("n", _segments(F.col("shorter"))).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    both = both.withColumn("start", _start(F.col("segment"), F.col("shorter"), F.col("n")))
    after = F.col("shorter") - _start(F.col("segment") + 1, F.col("shorter"), F.col("n"))  # characters after it, in either line
    both = both.withColumn("end", F.col("length") - after)
    outside = F.xxhash64("shorter", "segment", F.substr("line", F.lit(1), F.col("start")), F.substr("line", F.col("end") + 1, after))
    return both.withColumn("outside", outside).drop("n")


def _bounded(table: DataFrame, row_bytes: int, most_bytes: int) -> DataFrame:
    """A stored table with a broadcast hint if its counted rows are within a bound."""
    return F.broadcast(table) if table.count() * row_bytes <= most_bytes else table


def near_earliest(lines: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, other): the earliest place of a different line within one edit, for lines that have one.

    lines: occurrences (id, line, length, place). Key groups are only aggregated, never paired: lines that lack the same
    character of equal length are all near to each other, so the two earliest stand for them; and the line that is equal
    to others without a character is one line."""
    keys = _cut(lines)
    shared = keys.select("outside", F.xxhash64("id").alias("h")).groupBy("outside").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("outside")
    shared = common.stored(shared, "outside")
    if shared.count() * 8 <= broadcast_bytes:
        near = keys.join(F.broadcast(shared), "outside", "left_semi")
    else:  # lines are shuffled once, not once a key: first to those with a shared key
        wanted = keys.select("outside", "id").join(shared, "outside", "left_semi").select("id").distinct()
        near = _cut(lines.join(wanted, "id", "left_semi")).join(shared, "outside", "left_semi")
    # the occurrences of a line are one from here on
    inner = F.substr("line", F.col("start") + 1, F.col("end") - F.col("start"))
    near = near.select("id", "line", "place", "outside", (F.col("length") > F.col("shorter")).alias("longer"), inner.alias("inner"))
    near = near.groupBy("id", "outside", "longer").agg(F.min("place").alias("place"), F.first("line").alias("line"), F.first("inner").alias("inner"))
    near = common.stored(near, "open")
    size = F.char_length("inner")
    at = near.select("id", "place", "outside", "longer", "inner", F.explode(F.sequence(F.when(F.col("longer"), 1).otherwise(0), size)).alias("i"))
    variant = F.when(F.col("i") == 0, F.col("inner")).otherwise(F.concat(F.substr("inner", F.lit(1), F.col("i") - 1), F.substr("inner", F.col("i") + 1, size)))
    # i tells changed characters apart by position; a left-out one meets the line without it wherever it was
    where = F.when(F.col("longer"), 0).otherwise(F.col("i"))
    kind = F.when(F.col("longer"), 1).when(F.col("i") == 0, 2).otherwise(0)
    variants = common.stored(at.select("id", "place", kind.alias("kind"), F.xxhash64("outside", where, variant).alias("variant")), "variants")
    own = F.struct("place", "id")
    many = variants.groupBy("variant").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("variant")
    variants = common.stored(variants.join(_bounded(common.stored(many, "many", light=True), 8, broadcast_bytes), "variant", "left_semi"), "shared")
    groups = variants.groupBy("variant").agg(
        F.min(F.when(F.col("kind") == 1, own)).alias("long"), F.min(F.when(F.col("kind") == 2, own)).alias("short"), F.min(F.when(F.col("kind") == 0, own)).alias("first")
    )
    other = F.when(F.col("kind") == 0, F.col("first")).when(F.col("kind") == 1, F.col("short")).otherwise(F.col("long"))
    found = variants.join(groups, "variant").select("id", other.alias("other")).filter(F.col("other").isNotNull() & (F.col("other.id") != F.col("id")))
    found = found.select("id", F.col("other.id").alias("other_id"), F.col("other.place").alias("other")).distinct()
    texts = near.groupBy("id").agg(F.first("line").alias("line"))
    said = found.join(texts.withColumnRenamed("line", "left"), "id").join(texts.select(F.col("id").alias("other_id"), F.col("line").alias("right")), "other_id")
    return said.filter(F.levenshtein("left", "right", 1) == 1).groupBy("id").agg(F.min("other").alias("other"))


def dropped(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, text, gone): line numbers that go, for each document (by key and text hash) that loses any."""
    split = _split(docs, key, text).filter(F.col("line").rlike(VISIBLE)).withColumn("id", F.unhex(F.md5("line")))
    twice = split.groupBy("id").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter(F.col("first") < F.col("last")).select("id", "first")
    other = near_earliest(split.withColumn("length", F.char_length("line")), broadcast_bytes)
    # lines that occur twice or have a near line, and the earliest place of either
    bounds = common.stored(twice.join(other, "id", "full_outer").select("id", F.least("first", "other").alias("earliest")), "bounds")
    gone = split.select("id", "place").join(_bounded(bounds, 100, broadcast_bytes), "id").filter(F.col("earliest") < F.col("place"))
    return gone.groupBy("place.none", "place.key", "place.text").agg(F.array_sort(F.collect_set("place.at")).alias("gone")).drop("none")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the text's remaining lines, and n_lines and n_dropped."""
    gone = dropped(docs.select(key, text), key, text, broadcast_bytes)
    gone = common.stored(gone.select(F.col("key").alias("__key"), F.col("text").alias("__text"), F.col("gone").alias("__gone")), "gone")
    numbers = gone.agg(F.sum(F.size("__gone") + 16)).first()[0] or 0
    small = F.broadcast(gone) if numbers * 4 <= broadcast_bytes else gone
    own = docs.select(common.row(docs).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    joined = own.join(small, F.col("key").eqNullSafe(F.col("__key")) & (F.xxhash64("text") == F.col("__text")), "left")
    lines = F.split("text", "\n", -1)
    left = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n"))
    rest = [(left if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*rest, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
