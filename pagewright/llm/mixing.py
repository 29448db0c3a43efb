"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed 60-bit hash. Of each source whole passes are taken, and of the rest of its target the rows whose hash
lies below a threshold, so a larger budget always takes a superset. The threshold is found without sorting: sizes are
summed by source and hash bucket (4096 buckets), the first bucket that goes over the budget is the boundary, and only that
bucket is refined, 12 bits at a time, until one row is left in it; it is taken if that comes nearer to the budget.

The list of sources with their weights is the caller's configuration and lies on the driver; rows never do; more than MOST_SOURCES are an error. Null text has
size 0; null is a source of its own. Rows that agree in key (and, where the key is null, in text) share a hash and are
taken together. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS, LEVELS = 12, 5
#: Sources whose shares are held by the driver and broadcast at most (some 10 MB).
MOST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def hash60(key: str, text: str) -> Column:
    """The first 60 bits of the md5 of a key as text; of the text where the key is null."""
    plain = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.md5(F.col(text))), F.lit("none"))
    return F.conv(F.substring(F.md5(plain), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, hash): size is the number of words. Written to the shared folder, so texts are read once."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return common.stored(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), size.alias("size"), hash60(key, text).alias("hash")), "sizes")


def targets(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Shares of share * all sizes by weight; none is above most * its source's size, the excess goes to the others."""
    caps = {s: most * n for s, n in sizes.items()}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = [s for s in sizes if s not in full]
        each = (total - sum(caps[s] for s in full)) / sum(weights[s] for s in left) if left else 0.0
        over = {s for s in left if each * weights[s] > caps[s]}
        if not over:
            return {s: caps[s] if s in full else each * weights[s] for s in sizes}
        full |= over


def by_code_point(sources: list[str | None]) -> list[str | None]:
    return sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)


@dataclass
class Share:
    """Of a source: its size and target, whole passes, and the budget left for rows below a threshold."""

    source: str | None
    size: int
    target: float
    passes: int
    rest: float
    threshold: int = 0
    prefix: int = 0
    level: int = 0


def _thresholds(rows: DataFrame, shares: list[Share]) -> None:
    """Find each share's threshold; a pass over the rows of boundary buckets per level."""
    spark, wide = rows.sparkSession, 1 << BITS
    todo = [s for s in shares if s.rest > 0]
    while todo:
        level = todo[0].level
        shift = BITS * (LEVELS - 1 - level)
        table = spark.createDataFrame([(i, s.source, s.prefix, float(s.rest)) for i, s in enumerate(todo)], "i int, of string, prefix long, rest double")
        within = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["of"]) & (F.shiftright(rows["hash"], shift + BITS) == table["prefix"]))
        cells = within.groupBy("i", "rest", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        before = F.sum("size").over(Window.partitionBy("i").orderBy("bucket")) - F.col("size")
        # 4096 cells of a source at most; the first that goes over is its boundary
        edge = cells.withColumn("before", before).filter(F.col("before") + F.col("size") > F.col("rest"))
        found = {r.i: r.least for r in edge.groupBy("i").agg(F.min(F.struct("bucket", "before", "size", "n")).alias("least")).collect()}
        refined = []
        for i, s in enumerate(todo):
            if i not in found:  # all that is left fits
                s.threshold = (s.prefix + 1) << (shift + BITS)
                continue
            bucket, before_it, size, n = found[i]
            s.rest -= before_it
            if n > 1 and level + 1 < LEVELS:
                s.prefix, s.level = bucket, level + 1
                refined.append(s)
            else:
                s.threshold = (bucket + (size - s.rest < s.rest)) << shift
        todo = refined
    assert wide ** LEVELS == 1 << 60


def plan(rows: DataFrame, weigh: Callable[[list], dict], share: float = 1.5, most: float = 2.0) -> list[Share]:
    """The share of each source, from rows of ``sized``. weigh: from the list of sources to their weights."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: their shares aren't for a driver and a broadcast")
    sizes = {r.source: r.size for r in found}
    shares = []
    for source, target in targets(sizes, weigh(list(sizes)), share, most).items():
        passes = math.floor(target / sizes[source]) if sizes[source] else 0
        shares.append(Share(source, sizes[source], target, passes, target - passes * sizes[source] if sizes[source] else 0.0))
    _thresholds(rows, shares)
    return shares


def with_copies(rows: DataFrame, shares: list[Share], source: str = "source", hash_column: str = "hash") -> DataFrame:
    """rows plus source_size, target and copies (how often the mix takes a row); columns of these names are replaced."""
    rows = rows.drop("source_size", "target", "copies")
    schema = "__of string, source_size long, target double, __passes long, __threshold long"
    table = rows.sparkSession.createDataFrame([(s.source, s.size, s.target, s.passes, s.threshold) for s in shares], schema)
    copies = F.col("__passes") + (F.col(hash_column) < F.col("__threshold")).cast("long")
    return rows.join(F.broadcast(table), F.col(source).cast("string").eqNullSafe(F.col("__of"))).withColumn("copies", copies).drop("__of", "__passes", "__threshold")


def mix(rows: DataFrame, weigh: Callable[[list], dict], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """rows of ``sized`` plus source_size, target, copies and taken (words the mix takes of a row, repeats counted)."""
    return with_copies(rows, plan(rows, weigh, share, most)).withColumn("taken", F.col("size") * F.col("copies"))


def repeating(weights: tuple[float, ...] = (3, 1, 2)) -> Callable[[list], dict]:
    """Sources by code point, null last, have these weights in turn."""
    return lambda sources: {s: weights[i % len(weights)] for i, s in enumerate(by_code_point(sources))}
