"""The thin queries over the test tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, conversations, gridorder, jaccard, language, lines, media, mixing, packing, quality, scoring, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


@_query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of each document."""
    rows = mixing.sized(_documents(spark, sf_dir, "doc_id", "source", "text"))
    return mixing.mix(rows, mixing.repeating((3, 1, 2)), 1.5, 2.0).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLES["op1_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'text ' || md5(text), 'none')), 1, 15) AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, 2 * s AS cap, CASE turn WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS w FROM sources),
ranked AS (
  SELECT *, row_number() OVER o AS k, sum(cap) OVER o - cap AS caps_before, sum(w) OVER () - (sum(w) OVER o - w) AS w_left
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(s) FROM sources) - caps_before) / w_left AS each FROM ranked),
stop AS (SELECT min(k) AS k FROM levels WHERE each * w <= cap),
aimed AS (
  SELECT l.source, l.s, CASE WHEN stop.k IS NULL OR l.k < stop.k THEN l.cap ELSE (SELECT each FROM levels m WHERE m.k = stop.k) * l.w END AS target
  FROM levels l, stop),
laid AS (
  SELECT d.*, a.s, a.target, CASE WHEN a.s > 0 THEN floor(a.target / a.s) ELSE 0 END AS passes,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       (size * (passes + CASE WHEN target - passes * s > 0 AND (upto <= target - passes * s OR upto - (target - passes * s) < (target - passes * s) - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM laid
"""


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose crc32 remainder isn't 2."""
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.learn(docs.filter(language.remainder("doc_id", 4) != 2))
    kept = docs.select(F.struct("doc_id", (language.remainder("doc_id", 4) == 2).alias("held_out")).alias("row"), "text")
    return language.predict(kept, model, "row").select("row.*", "lang_pred", "score", "n_grams")


@_query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log probabilities of all documents, learned from those whose crc32 remainder isn't 1."""
    docs = _documents(spark, sf_dir, "doc_id", "text")
    held_out = language.remainder("doc_id", 5) == 1
    model = scoring.Model(docs.filter(~held_out))
    kept = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("row"), "text")
    return scoring.scores(kept, model, "row").select("row.*", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of all documents."""
    found = quality.judged(_documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@_query
def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as JPEG images and read back."""
    return media.media_features(_documents(spark, sf_dir, "doc_id", "text"))


@_query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents."""
    return jaccard.linked(_documents(spark, sf_dir, "doc_id", "text"))


@_query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 4096 tokens."""
    pieces = packing.cut_documents(_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    counts = tokens.token_counts(_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@_query
def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back through the index."""
    capture = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return warc.read(spark, capture).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_warc_index"] = """
WITH p AS (
  SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM response AND response IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM g
"""


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that have an earlier equal or near one."""
    return lines.deduplicated(_documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")


# Candidates share the characters before or after their middle, as lines within one edit do; then the places where they
# differ are counted (equal lengths), or the longer one without the character at the first difference is compared.
ORACLES["op10_line_dedup"] = """
WITH split AS (
  SELECT doc_id, u.pos - 1 AS pos, string_split(text, chr(10))[u.pos] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos) u
  WHERE text IS NOT NULL),
seen AS (SELECT * FROM split WHERE regexp_matches(line, '[^\\x00-\\x20\\x7f]')),
uniq AS (SELECT line, length(line) AS n, min(row(doc_id, pos)) AS first FROM seen GROUP BY line),
keys AS (
  SELECT line, n, first, m, 0 AS side, left(line, (m // 2)::BIGINT) AS k FROM uniq, LATERAL (SELECT unnest([n, n - 1]) AS m) x
  UNION ALL
  SELECT line, n, first, m, 1 AS side, right(line, (m - m // 2)::BIGINT) AS k FROM uniq, LATERAL (SELECT unnest([n, n - 1]) AS m) x),
pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.first AS fa, b.first AS fb, a.n AS na, b.n AS nb
  FROM keys a JOIN keys b ON a.m = b.m AND a.side = b.side AND a.k = b.k AND a.line <> b.line AND b.first < a.first AND abs(a.n - b.n) <= 1),
said AS (
  SELECT *, CASE WHEN na >= nb THEN a ELSE b END AS x, CASE WHEN na >= nb THEN b ELSE a END AS y FROM pairs),
chars AS (SELECT *, string_split(x, '') AS xs, string_split(y, '') AS ys FROM said),
diff AS (SELECT *, list_filter(range(1, len(ys) + 1), lambda i: xs[i] <> ys[i]) AS d FROM chars),
near AS (
  SELECT a, fb FROM diff
  WHERE CASE WHEN na = nb THEN len(d) = 1
             WHEN len(d) = 0 THEN true
             ELSE left(x, d[1] - 1) || substr(x, d[1] + 1) = y END),
other AS (SELECT a AS line, min(fb) AS fb FROM near GROUP BY a),
bounds AS (SELECT u.line, least(u.first, coalesce(o.fb, u.first)) AS earliest FROM uniq u LEFT JOIN other o USING (line)),
marked AS (
  SELECT s.doc_id, s.pos, s.line, b.earliest IS NOT NULL AND b.earliest < row(s.doc_id, s.pos) AS gone
  FROM split s LEFT JOIN bounds b ON s.line = b.line AND regexp_matches(s.line, '[^\\x00-\\x20\\x7f]'))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM marked GROUP BY doc_id
"""


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun as the first of its twenty is."""
    turns = conversations.placed(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return conversations.trie(*conversations.rebuilt(turns, 20, 4))


# crc32 runs over a list: every byte is followed by seven zeros, and each entry is one bit's step
ORACLES["op11_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_hash, turn,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_hash) - 1 AS pos FROM t),
convs AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
             lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 4 AS h
  FROM placed GROUP BY conv_id),
info AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
turns AS (
  SELECT conv_id, pos - h + k AS pos, turn_hash, words FROM placed JOIN info USING (conv_id) WHERE pos >= h
  UNION ALL
  SELECT i.conv_id, p.pos, p.turn_hash, p.words FROM info i JOIN placed p ON p.conv_id = i.base WHERE p.pos < i.h),
paths AS (
  SELECT conv_id, pos + 1 AS depth, list(turn_hash) OVER (PARTITION BY conv_id ORDER BY pos) AS path, words FROM turns
  UNION ALL
  SELECT conv_id, 0, [], 0 FROM convs),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM ended GROUP BY depth, path),
children AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
above AS (
  SELECT a.depth, n.path[:a.depth] AS path, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS depth) a
  GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, a.n_leaves, a.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above a ON a.depth = n.depth AND a.path = n.path
LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
"""


@_query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components, in 64ths, after three rounds of Lloyd's with 16 centroids."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return centroids.cluster(vectors, k=16, rounds=3, dim=64, scale=64.0, seed="1:")


_NEAREST = """
d{i} AS (
  SELECT v.rid, v.vec_id, v.x, c.number, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept v, c{i} c),
a{i} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min_by(number, row(distance, number)) AS number, min(distance) AS distance FROM d{i} GROUP BY rid),"""

_MOVED = """
s{i} AS (SELECT number, u.pos, sum(x[u.pos])::BIGINT AS s, count(*) AS n FROM a{i}, LATERAL (SELECT unnest(range(1, 65)) AS pos) u GROUP BY number, u.pos),
m{i} AS (SELECT number, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM s{i} GROUP BY number),
c{j} AS (SELECT number, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (number)),"""

ORACLES["op12_centroid_clustering"] = (
    """
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY hash) - 1 AS number, x
  FROM (SELECT x, sha256('1:' || vec_id::VARCHAR) AS hash FROM kept WHERE vec_id IS NOT NULL ORDER BY hash LIMIT 16)),"""
    + "".join((_NEAREST + _MOVED).format(i=i, j=i + 1) for i in range(3))
    + _NEAREST.format(i=3)
    + """
sums AS (SELECT number, sum(distance)::BIGINT AS cluster_inertia FROM a3 GROUP BY number)
SELECT a.vec_id, a.number::INTEGER AS cluster, a.distance, s.cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM sums) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 a JOIN sums s USING (number) JOIN c3 c USING (number)
"""
)


@_query
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of all vectors, by label, at a cosine of 0.93 or more."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return gridorder.near_duplicates(vectors, least=0.93)


ORACLES["op13_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS x,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
         AND len(list_filter(embedding, lambda y: y <> 0)) > 0 AS counts
  FROM embeddings),
links AS (
  SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.rid <> b.rid
  WHERE a.counts AND b.counts AND list_cosine_similarity(a.x, b.x) >= 0.93),
reached(rid, seen) AS (
  SELECT rid, rid FROM v
  UNION
  SELECT r.rid, l.b FROM reached r JOIN links l ON l.a = r.seen),
least AS (SELECT r.rid, min(v.vec_id) AS component_id FROM reached r JOIN v ON v.rid = r.seen GROUP BY r.rid),
counted AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, v.vec_id IS NOT DISTINCT FROM l.component_id AS kept
FROM v JOIN least l USING (rid) LEFT JOIN counted c USING (rid)
"""
