"""A prefix trie of conversations, by prefix-doubling naming.

A turn is known by the SHA-256 of its role and text, so texts are read once and never shuffled. Equal turns get one dense
name; then blocks of two, four, eight ... turns (at multiples of their size) get one for each different pair of names: as many
rounds of joins as the longest conversation's number of turns has binary digits. A prefix is its blocks in binary
decomposition, longest first; it is named by the name of all but the last block and that of the last, from long last blocks to
short ones, in as many rounds. Conversations whose prefixes of a length have one name are the members of a node.

Sums over subtrees need no walk: a node belongs to its smallest member, whose nodes are the end of its path, from a first
depth on; so every conversation's turns add to the nodes on its own path by sums from its end.

No conversation, turn or node is gathered whole in one task: turns get their places by ranges of a sort, hot keys are broadcast
(common.joined), sums run in chunks of a conversation, and the hash of a node's ends streams over sorted chunks of ids.

Turns are ordered by turn number, null first, equal numbers by the turn's hash; equal rows are turns of their own. Null role or
text is empty. Rows without a conversation id belong to none and are left out. Other columns have no part in it. Without any
conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation that are summed in one window, and conversation ids that are joined to one text, as powers of two.
TURN_BITS, ID_BITS = 12, 12


def placed(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, digest, words): every turn with its place in its conversation, from 0."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said), 256))
    turns = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("words")
    ).withColumn("row", F.monotonically_increasing_id())
    # a long conversation, and equal rows, too, lie in several ranges
    ranged = turns.repartitionByRange(common.shards(rows.sparkSession), "conv", F.asc_nulls_first("turn"), "digest", "row")
    ranged = common.stored(ranged.withColumn("part", F.spark_partition_id()), "turns")
    counts = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    own = Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "digest", "row")
    found = ranged.withColumn("own", F.row_number().over(own) - 1).join(starts, ["conv", "part"])
    return common.stored(found.select("conv", (F.col("start") + F.col("own")).alias("at"), "digest", "words"), "turns")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, n): the number of turns of every conversation."""
    return common.stored(turns.groupBy("conv").agg(F.count("*").alias("n")), "lengths")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations that begin as the first of their group does, as stored tables.

    Conversation c gets the first h turns of c - c % group (remainders have c's sign) in place of its own first h, with
    h = crc32(c as text) % heads."""
    sizes = lengths(turns)
    total = turns.count()
    h = F.crc32(F.col("conv").cast("string")) % heads
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    info = sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")).join(bases, "base", "left")
    info = info.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv", "base", "n", "h", "k")
    info = common.stored(info.withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "lengths")
    own = common.joined(turns.filter(F.col("at") >= h), info.select("conv", "n", "h", "k", F.col("n").alias("rows")), ["conv"], "rows", total)
    own = own.select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "digest", "words", (F.col("at") == F.col("n") - 1).alias("last"))
    first = turns.filter((F.col("at") < heads - 1) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    taken = info.join(first, "base").filter("at < h").select("conv", "at", "digest", "words", (F.col("at") == F.col("length") - 1).alias("last"))
    return common.stored(own.unionByName(taken), "turns"), info.select("conv", F.col("length").alias("n"))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations as they were placed."""
    sizes = lengths(turns)
    counted = sizes.select("conv", "n", F.col("n").alias("rows"))
    marked = common.joined(turns, counted, ["conv"], "rows", turns.count())
    return common.stored(marked.select("conv", "at", "digest", "words", (F.col("at") == F.col("n") - 1).alias("last")), "turns"), sizes


def _blocks(turns: DataFrame) -> list[DataFrame]:
    """A table (conv, at, name, words, last) for blocks of 1, 2, 4 ... turns; words and last are those of a block's last turn."""
    level = common.stored(common.named(turns, ["digest"], "name").drop("digest"), "blocks")
    found = []
    while not level.isEmpty():
        found.append(level)
        right = F.col("at") % 2 == 1
        of = [F.max(F.when(~right, F.col("name"))).alias("left"), *(F.max(F.when(right, F.col(c))).alias(a) for c, a in (("name", "right"), ("words", "words"), ("last", "last")))]
        pairs = level.groupBy("conv", F.shiftright("at", 1).alias("at")).agg(*of).filter("right IS NOT NULL")
        pairs = common.stored(pairs, "pairs")
        level = common.stored(common.named(pairs, ["left", "right"], "name").drop("left", "right"), "blocks")
    return found


def prefixes(turns: DataFrame) -> list[DataFrame]:
    """Tables (conv, depth, name, words, last) of every prefix: those of one depth and name are equal. turns: (conv, at, digest, words, last)."""
    found: list[DataFrame] = []
    levels = _blocks(turns)
    for k, level in reversed([*enumerate(levels)]):
        depth = F.shiftleft(F.col("at") + 1, k).alias("depth")
        own = level.filter("at = 0").select("conv", depth, "name", "words", "last")  # a power of two is one block
        if longer := found:
            known = longer[0].select("conv", "depth", "name")
            for table in longer[1:]:
                known = known.unionByName(table.select("conv", "depth", "name"))
            blocks = level.filter("at > 0 AND at % 2 = 0").select("conv", F.shiftleft("at", k).alias("before"), depth, F.col("name").alias("block"), "words", "last")
            parts = blocks.join(known.select("conv", F.col("depth").alias("before"), F.col("name").alias("prefix")), ["conv", "before"])
            parts = common.stored(parts.drop("before"), "prefixes")
            own = own.unionByName(common.named(parts, ["depth", "prefix", "block"], "name").drop("prefix", "block"))
        found = [*found, common.stored(own, "prefixes")]
    return found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's ids; chunks come sorted by node and place, so one hash is open at a time."""
    open_at, running = None, None
    for batch in batches:
        done = []
        for depth, name, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, name) == open_at:
                running.update(b"," + ids.encode())
                continue
            if running is not None:
                done.append((*open_at, running.hexdigest()))
            open_at, running = (depth, name), hashlib.sha256(ids.encode())
        yield _hashes(done)
    yield _hashes([(*open_at, running.hexdigest())] if running is not None else [])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    of = lambda i, kind: pa.array([r[i] for r in rows], kind)
    return pa.record_batch([of(0, pa.int64()), of(1, pa.int64()), of(2, pa.string())], ["depth", "name", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) of nodes at which conversations end: the hash of their ids in order, joined by commas."""
    chunk = F.shiftright("conv", ID_BITS).alias("chunk")  # as many ids at most as it has numbers
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    chunks = paths.filter("last").groupBy("depth", "name", chunk).agg(ids.alias("ids"))
    ordered = chunks.repartition(common.shards(paths.sparkSession), "depth", "name").sortWithinPartitions("depth", "name", "chunk")
    return common.in_arrow(ordered.select("depth", "name", "ids"), _hashed, "depth long, name long, ends_sha256 string")


def _path_sums(paths: DataFrame, chains: DataFrame, total: int) -> DataFrame:
    """(conv, depth, name, child, leaf, saved): what a conversation adds to each node on its path.

    chains: (conv, n, first, leaf): rows, the depth from which it is its nodes' smallest member (null: never), and whether it
    ends in a leaf there."""
    rows = common.joined(paths, chains, ["conv"], "n", total)
    smallest = F.coalesce(F.col("depth") >= F.col("first"), F.lit(False))
    child = F.coalesce(F.col("depth") + 1 >= F.col("first"), F.lit(False)) & ~F.col("last")
    rows = rows.select("conv", "depth", "name", child.cast("long").alias("child"), "leaf", F.when(smallest, 0).otherwise(F.col("words")).alias("gain"), F.shiftright("depth", TURN_BITS).alias("chunk"))
    rows = common.stored(rows, "paths")
    own = Window.partitionBy("conv", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    tails = rows.groupBy("conv", "chunk").agg(F.sum("gain").alias("gain"))
    tails = tails.select("conv", "chunk", F.sum("gain").over(later).alias("tail")).filter("tail <> 0")
    summed = rows.withColumn("own", F.sum("gain").over(own)).join(tails, ["conv", "chunk"], "left")
    return summed.select("conv", "depth", "name", "child", "leaf", (F.col("own") + F.coalesce("tail", F.lit(0))).alias("saved"))


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv, at, digest, words, last), sizes: (conv, n), of rebuilt() or as_they_are(); a conversation may have no turns."""
    paths = sizes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("words"), (F.col("n") == 0).alias("last"))
    for table in prefixes(turns):
        paths = paths.unionByName(table)
    nodes = common.stored(paths.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("ended")), "nodes")
    owned = nodes.groupBy("conv").agg(F.min("depth").alias("first"), F.max((F.col("n") == F.col("ended")).cast("long")).alias("leaf"), F.count("*").alias("owned"))
    chains = sizes.select("conv", (F.col("n") + 1).alias("n")).join(owned, "conv", "left")
    chains = common.stored(chains.select("conv", "n", "first", F.coalesce("leaf", F.lit(0)).alias("leaf"), "owned"), "chains")
    total = paths.count()
    sums = _path_sums(paths, chains.drop("owned"), total)
    sums = sums.groupBy("depth", "name").agg(F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    full = nodes.join(sums, ["depth", "name"]).join(ends(paths), ["depth", "name"], "left")
    full = common.stored(full, "nodes")
    # where a conversation's nodes begin, their parent is another's
    above = paths.join(chains.filter("first > 0").select("conv", (F.col("first") - 1).alias("depth")), ["conv", "depth"]).select("depth", "name", F.col("conv").alias("child"))
    parents = common.joined(common.stored(above, "above"), full.filter("n_children > 0").select("depth", "name", F.col("conv").alias("parent"), "n_children"), ["depth", "name"], "n_children", total)
    parents = chains.filter("first IS NOT NULL").join(parents.select(F.col("child").alias("conv"), "parent"), "conv", "left")
    parents = common.stored(parents.select("conv", "first", "parent", "owned"), "parents")
    found = common.joined(full, parents, ["conv"], "owned", total)
    parent = F.when(F.col("depth") == 0, None).otherwise(F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("parent")))
    return found.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
