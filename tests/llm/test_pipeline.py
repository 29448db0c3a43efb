"""Every stage, judged on its own input."""

import os
import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from pagewright.llm import common, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    def say(i, words):
        rng = random.Random(i)
        return " ".join(rng.choice(words) + "".join(rng.choices("abcdefg", k=3)) for _ in range(70))

    one, two = ["karo", "milu", "tena", "sora", "lino"], ["gruschel", "pfint", "zwack", "schnurz"]
    rows = [(i, say(i, one if i % 2 else two), "aa" if i % 2 else "bb", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[7][1], "aa", "s1"), (101, rows[8][1].replace(" ", "\n", 1) + " ende", "bb", None), (102, None, None, "s0"), (103, "123 !!", "aa", "s0"), (104, rows[9][1] + "\nAnd one line that stands here alone\n" + rows[10][1], None, "s1"), (None, say(71, one), "aa", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mix_sources", "pack"]
    now, ids = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = common.stored(stage(spark, now, ""), name)
        ids.append(Counter(r.doc_id for r in now.collect()))
        if name != "pack":
            assert now.columns == COLUMNS
            assert all(r.n_chars == len(r.text) for r in now.collect())
    language, deduped, near, mixed, packed = ids
    assert set(language) == {*range(60), 100, 101, 104, None}
    assert set(deduped) == set(language) - {100}  # nothing of an exact copy is left
    assert set(near) == set(deduped) - {101}
    assert set(mixed) <= set(near) and max(mixed.values()) <= 2 and set(packed) == set(mixed)


def test_what_language_id_rejects(spark, docs):
    rng = random.Random(3)
    noise = lambda n: " ".join("".join(rng.choices("qxzjwvykñßþ", k=rng.randrange(4, 9))) for _ in range(n))
    planted = [(200 + i, noise(12 + 15 * i), None, "s0", 1) for i in range(8)]  # from about 80 letters on
    short = [(300 + i, text, None, "s0", 1) for i, text in enumerate(("karoabc", "milu", "a", "pfintgab zwackefg", "tena sora lino"))]
    made = docs.unionByName(spark.createDataFrame(planted + short, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, made, "").collect()}
    assert not kept & set(range(200, 208)) and set(range(300, 305)) <= kept and set(range(60)) <= kept


def test_one_of_equal_rows_stays(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve and more"
    rows = [(None, text, "aa", "s1", 33), (None, text, "aa", "s0", 33), (5, other, "aa", "s0", 37), (5, other, "aa", "s0", 37), (6, "alone " * 9, None, None, 54)]
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert found.columns == COLUMNS and sorted(map(tuple, found.collect()), key=repr) == sorted([rows[1], rows[2], rows[4]], key=repr)


def test_columns_of_any_name(spark, docs):
    """Names that stages use themselves, names that have to be quoted, and a map go through all of them."""
    from pyspark.sql import functions as F

    names = ["key", "rest", "row", "hash", "copies", "copy", "target", "source_size", "__key", "__text", "n_lines", "n_dropped", "id", "lang_pred", "score", "n_grams", "my col", "a.b", "tick`s"]
    more = docs.select("*", *(F.concat(F.lit(f"{i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for i, n in enumerate(names)), F.create_map(F.lit("k"), "source").alias("m"), F.struct("lang").alias("deep one"))
    more = common.stored(more, "docs")
    now, plain = more, docs
    for name, stage in corpus_pipeline.STAGES:
        now, plain = common.stored(stage(spark, now, ""), name), common.stored(stage(spark, plain, ""), name)
        if name == "pack":
            continue
        assert now.columns == more.columns and now.schema == more.schema
        assert Counter(map(tuple, now.select(COLUMNS).collect())) == Counter(map(tuple, plain.collect()))
        for r in now.collect():
            assert [r[n] for n in names] == [f"{i} {'none' if r.doc_id is None else r.doc_id}" for i in range(len(names))] and r.m == {"k": r.source} and r["deep one"].lang == r.lang
    assert now.count() == plain.count()


def test_workers_keep_nothing_of_a_task(spark):
    """Of the blocks that a task's batches took, Arrow's pool holds none when the next task of the worker begins."""

    held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20  # noqa: E731  MB of this process

    def run(batches):
        before = held()
        for _ in batches:
            parts = [(pa.array([bytes(1000)] * 1000), bytearray(30_000)) for _ in range(200)]  # 200 MB
            peak = held()
            del parts
        yield pa.record_batch([pa.array([before]), pa.array([peak])], ["before", "peak"])

    rows = spark.range(8).coalesce(1)
    found = [rows.transform(common.in_arrow, run, "before long, peak long").collect()[0] for _ in range(3)]
    assert found[0].peak - found[0].before > 150 and all(r.before < found[0].before + 50 for r in found[1:]), found


def test_empty(spark, docs):
    now = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        now = common.stored(stage(spark, now, ""), name)
        assert now.count() == 0


def test_queries_are_registered():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
