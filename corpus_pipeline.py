"""A corpus pipeline out of the training-text operators: language ID, line dedup, near-duplicate removal, source mixing,
packing. Every stage takes all that the one before kept; its result is written as Parquet and read again.

All stages but the last return the columns of documents (doc_id, text, lang, source, n_chars). Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common, jaccard, language, lines, mixing, packing

#: A text that is like no learned language to this cosine at least is rejected. A cosine of few trigrams is lower, by the
#: root of n / (n + HALF_GRAMS), and uncertain, by 1 / sqrt(dimensions) each way; the bound gives way by DEVIATIONS of that.
LEAST_SCORE, HALF_GRAMS, DEVIATIONS = 0.36, 60, 4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no language: null or letterless texts, and those that are like no learned language.

    The languages are learned from the stage's own labelled documents; a text's label has no part in its verdict."""
    bound = LEAST_SCORE * F.sqrt(F.col("n_grams") / (F.col("n_grams") + HALF_GRAMS)) - DEVIATIONS / language.DIM**0.5
    model = language.learn(docs)
    found = language.predict(docs.select(common.row(docs).alias("row"), "text"), model, "row")
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= bound)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that have an earlier equal or near one, and without documents that have no line left."""
    found = lines.deduplicated(docs.select(common.row(docs).alias("row"), "doc_id", "text")).filter(F.col("text").rlike(lines.VISIBLE))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; of rows equal in id and text, one."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = jaccard.linked(docs.select(key.alias("key"), "text"), "key").filter("key = component_id")
    kept = common.stored(found.groupBy("key").agg(F.count("*").alias("n")), "kept", light=True)
    rows = docs.select(common.row(docs).alias("row"), key.alias("key"))
    # texts are aggregated only where there are equal rows
    others = [F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    first = F.to_json(F.struct(*others)) if others else F.lit("")
    equal = rows.join(kept.filter("n > 1").select("key"), "key", "left_semi").groupBy("key").agg(F.min_by("row", first).alias("row"))
    return rows.join(kept.filter("n = 1").select("key"), "key", "left_semi").select("row").unionByName(equal.select("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 150% of all words, sources weighted 3, 1, 2 in turn, twice at most."""
    shares = mixing.plan(mixing.sized(docs), mixing.repeating((3, 1, 2)), 1.5, 2.0)
    taken = mixing.with_copies(docs.select(common.row(docs).alias("row"), "source", mixing.hash60("doc_id", "text").alias("hash")), shares)
    copies = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return taken.select("row", F.explode(copies)).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, packed into sequences."""
    return packing.pack(packing.cut_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Stages 1, 3 and 5 can't be said in SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
