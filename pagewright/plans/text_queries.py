"""Queries of text, evaluation and manifest operators over the test tables; names as in the blueprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import pages as P
from pagewright.functions import text as T
from pagewright.operators import evaluate, manifest, models
from pagewright.plans.registry import query
from pagewright.session import shared_dir
from pagewright.sources import pages as S

SPACE_SQL = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOISE = ("eosn", "c05u")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noisy(text):
    """What an imperfect reader makes of a text: four letters changed."""
    return F.translate(text, *NOISE)


def repaired(text):
    return F.translate(text, "c0", "eo")


def spread(rows: DataFrame, key: str, a_core: int = 1) -> DataFrame:
    """Rows dealt out before work that is heavy per row, where the scan has fewer partitions than the cluster has cores (a
    table in one file is one partition), or so many for each core; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores, key) if rows.rdd.getNumPartitions() < a_core * cores else rows


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, truth, raw, corrected) of every page: labelled documents have a truth; two of three pages are partly repaired."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    labelled = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("labelled")).distinct()
    raw = noisy("text")
    return docs.join(labelled, "page_id", "left").select("page_id", F.when(F.col("labelled"), F.col("text")).alias("truth"), raw.alias("raw"), F.when(F.col("page_id") % 3 != 0, repaired(raw)).alias("corrected"))


def by_line(pages: DataFrame) -> DataFrame:
    """The same by line instead of document."""
    sides = ("truth", "raw", "corrected")
    own = spread(pages, "page_id").select("page_id", *(F.split(c, "\n", -1).alias(c) for c in sides))
    rows = own.select("page_id", F.posexplode("raw").alias("n", "raw"), "truth", "corrected")
    return rows.select(F.format_string("%d_%d", "page_id", "n").alias("page_id"), F.get("truth", F.col("n")).alias("truth"), "raw", F.get("corrected", F.col("n")).alias("corrected"))


# The twin's distance counts bytes, so every character beyond ASCII of the table becomes one that no text has (23 of them).
LINES_SQL = rf"""
docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
alphabet AS (SELECT coalesce(string_agg(DISTINCT c, '' ORDER BY c), '') AS others FROM (SELECT unnest(string_split(text, '')) AS c FROM docs) WHERE c > chr(127)),
codes AS (SELECT string_agg(chr(i), '' ORDER BY i) AS codes FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 127]) AS i)),
lines AS (
  SELECT doc_id, u.n - 1 AS n, string_split(text, chr(10))[u.n] AS line, doc_id IN (SELECT doc_id FROM labels) AS labelled
  FROM docs, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n) u),
folded AS (
  SELECT doc_id, n, trim(regexp_replace(line, '{SPACE_SQL}+', ' ', 'g')) AS truth,
         trim(regexp_replace(translate(line, 'eosn', 'c05u'), '{SPACE_SQL}+', ' ', 'g')) AS raw,
         CASE WHEN doc_id % 3 <> 0 THEN trim(regexp_replace(translate(translate(line, 'eosn', 'c05u'), 'c0', 'eo'), '{SPACE_SQL}+', ' ', 'g')) END AS corrected
  FROM lines WHERE labelled),
coded AS (SELECT doc_id, n, translate(truth, others, codes) AS truth, translate(raw, others, codes) AS raw, translate(corrected, others, codes) AS corrected FROM folded, alphabet, codes),
rates AS (
  SELECT doc_id, n, CASE WHEN length(truth) > 0 THEN levenshtein(truth, raw)::DOUBLE / length(truth) END AS cer_raw,
         CASE WHEN length(truth) > 0 THEN levenshtein(truth, corrected)::DOUBLE / length(truth) END AS cer_corrected
  FROM coded)
"""


@query("page_ids", r"""
SELECT page_id AS page, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem,
       printf('%s_p%04d', regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1), page_id + 1) AS id
FROM pages""")
def page_ids(spark, sf_dir):
    stem = P.stem(F.col("url"))
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), stem.alias("stem"), P.page_id(stem, F.col("page_id") + 1).alias("id"))


@query("page_selection", """
SELECT o_orderkey, p.page FROM orders, LATERAL (SELECT unnest([1, 2, 3, 5, 8, 9, 10, 11, 12]) AS page) p
WHERE p.page BETWEEN 1 AND o_orderkey % 12 + 1""")
def page_selection(spark, sf_dir):
    sized = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 12 + 1).alias("n_pages"))
    return manifest.selected_pages(sized, [2, 5, 2], [(1, 3), (8, 12)]).select("o_orderkey", "page")


@query("normalize_text", rf"""
SELECT doc_id, trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g')) AS text FROM documents""")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("text"))


@query("split_lines", r"""
WITH parts AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents),
own AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM parts)
SELECT doc_id, u.n - 1 AS n, p[u.n] AS line FROM own, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS n) u""")
def split_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("n", "line"))


def line_rates(spark: SparkSession, sf_dir: str, *metrics: str) -> DataFrame:
    return evaluate.rates(by_line(predictions(spark, sf_dir)).filter("truth IS NOT NULL"), metrics=metrics)


def rounded(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", *(F.round(c, 9).alias(c) for c in pages.columns if c != "page_id"))


@query("cer_lines", f"WITH {LINES_SQL} SELECT printf('%d_%d', doc_id, n) AS page_id, round(cer_raw, 9) AS cer_raw, round(cer_corrected, 9) AS cer_corrected FROM rates")
def cer_lines(spark, sf_dir):
    return rounded(line_rates(spark, sf_dir, "cer"))


@query("cer_report_lines", f"""WITH {LINES_SQL}
SELECT count(*) AS evaluated, (SELECT count(*) FROM lines) AS total_processed, round(avg(cer_raw), 9) AS cer_raw_mean, round(avg(cer_corrected), 9) AS cer_corrected_mean FROM rates""")
def cer_report_lines(spark, sf_dir):
    lines = predictions(spark, sf_dir).select(F.explode(F.split("raw", "\n", -1)))
    return evaluate.report(line_rates(spark, sf_dir, "cer"), lines, 9)


@query("accuracy_ext", f"WITH {LINES_SQL} SELECT doc_id, round(avg(1 - cer_raw), 9) AS accuracy_raw, round(avg(1 - cer_corrected), 9) AS accuracy_corrected FROM rates GROUP BY doc_id")
def accuracy_ext(spark, sf_dir):
    """Mean accuracy of a document's lines."""
    doc = F.split_part("page_id", F.lit("_"), F.lit(1)).cast("long").alias("doc_id")
    return line_rates(spark, sf_dir, "cer").groupBy(doc).agg(*(F.round(F.avg(T.accuracy(F.col(f"cer_{s}"))), 9).alias(f"accuracy_{s}") for s in ("raw", "corrected")))


@query("eval_per_page")
def eval_per_page(spark, sf_dir):
    """Character and word error rates of whole documents."""
    return evaluate.rates(spread(predictions(spark, sf_dir).filter("truth IS NOT NULL"), "page_id"))


@query("eval_report")
def eval_report(spark, sf_dir):
    """The flagship: coverage and mean error rates over all documents."""
    return evaluate.report(eval_per_page(spark, sf_dir), read(spark, sf_dir, "documents"), 9)


@query("wer_lines")
def wer_lines(spark, sf_dir):
    return rounded(line_rates(spark, sf_dir, "wer"))


@query("eval_no_ground_truth", "SELECT true AS skipped, 'no ground truth' AS reason, 0::BIGINT AS evaluated, count(*) AS total_processed FROM documents")
def eval_no_ground_truth(spark, sf_dir):
    return evaluate.evaluate(None, predictions(spark, sf_dir).select("page_id", F.col("raw").alias("text")))[1]


@query("ground_truth_lines_form", "SELECT conv_id::VARCHAR AS page_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ground_truth_lines_form(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return S.truth_from_json(turns.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("document"), F.col("t.text").alias("lines"))).alias("value")))


@query("ground_truth_map_form", "SELECT 'page_' || item_id AS page_id, text FROM benchmark")
def ground_truth_map_form(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 8).alias("file")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("page_"), "item_id"), "text"))).alias("m"))
    return S.truth_from_json(items.select(F.to_json("m").alias("value")))


@query("manifest_upsert", """
SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, min(event_id) AS position FROM events GROUP BY user_id""")
def manifest_upsert(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("order", F.col("event_id"))
    return manifest.latest(events.select("user_id", "event_type", "event_id", "order"), ["user_id"], "order").select("user_id", "event_type", "event_id", "position")


@query("manifest_merge", """
WITH old AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'view' OR event_id % 2 = 0 GROUP BY user_id),
new AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)""")
def manifest_merge(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    last = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return manifest.upsert(last(events.filter("event_type = 'view' OR event_id % 2 = 0")), last(events.filter("event_id % 2 = 1")), ["user_id"])


ARTIFACTS_SQL = "SELECT user_id::VARCHAR AS page_id, event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'image' ELSE 'text' END AS kind, max(event_id)::VARCHAR AS path FROM events GROUP BY ALL"


def _artifacts(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "image").otherwise("text")
    return events.groupBy(F.col("user_id").cast("string").alias("page_id"), F.col("event_type").alias("stage"), kind.alias("kind")).agg(F.max("event_id").cast("string").alias("path"))


@query("artifact_register", ARTIFACTS_SQL)
def artifact_register(spark, sf_dir):
    found = _artifacts(spark, sf_dir)
    older = found.withColumn("path", F.lit("old")).filter("stage <> 'view'")
    return manifest.as_rows(manifest.as_maps(manifest.register(older, found)))


@query("artifact_lookup", """
SELECT user_id::VARCHAR AS page_id, max(event_id) FILTER (event_type = 'click' AND event_id % 2 = 0)::VARCHAR AS path FROM events GROUP BY user_id""")
def artifact_lookup(spark, sf_dir):
    return manifest.as_maps(_artifacts(spark, sf_dir)).select("page_id", manifest.path_of(F.col("artifacts"), "click", "image").alias("path"))


@query("resume_pending", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_pending(spark, sf_dir):
    return manifest.pending(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("missing_prereq", "SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_prereq(spark, sf_dir):
    return manifest.missing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id").agg(F.count("*").alias("missing"))


@query("raw_image_fallback", """
SELECT d.doc_id, coalesce('raw/' || l.quality, 'clean/' || d.lang) AS path FROM documents d LEFT JOIN labels l USING (doc_id)""")
def raw_image_fallback(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    first = labels.select("doc_id", F.concat(F.lit("raw/"), F.col("quality").cast("string")).alias("path"))
    return manifest.with_fallback(docs, first, docs.select("doc_id", F.concat(F.lit("clean/"), "lang").alias("path")), "doc_id")


@query("duplicate_page_ids", r"""
SELECT regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS page_id, count(DISTINCT url) AS sources FROM pages GROUP BY 1 HAVING count(DISTINCT url) > 1""")
def duplicate_page_ids(spark, sf_dir):
    return manifest.duplicates(read(spark, sf_dir, "pages").select(P.stem(F.col("url")).alias("page_id"), F.col("url").alias("source")))


@query("correct_passthrough", "SELECT doc_id, text, text AS corrected, true AS skipped, 'pass_through' AS reason FROM documents")
def correct_passthrough(spark, sf_dir):
    found = models.corrected(read(spark, sf_dir, "documents").select("doc_id", "text"), models.CorrectionConfig(enabled=True))
    return found.select("doc_id", "text", "corrected", "meta.skipped", "meta.reason")


@query("correct_rule_stub", "SELECT doc_id, replace(replace(translate(text, 'eosn', 'c05u'), 'thc', 'the'), '0', 'o') AS corrected, false AS skipped FROM documents")
def correct_rule_stub(spark, sf_dir):
    config = models.CorrectionConfig(enabled=True, backend="rules", rules=(("thc", "the"), ("0", "o")))
    found = models.corrected(read(spark, sf_dir, "documents").select("doc_id", noisy("text").alias("text")), config)
    return found.select("doc_id", "corrected", "meta.skipped")


@query("prompts", f"SELECT doc_id, '{models.correction_prompt('').replace(chr(39), chr(39) * 2)}' || text AS prompt FROM documents")
def prompts(spark, sf_dir):
    return models.prompts(read(spark, sf_dir, "documents")).select("doc_id", "prompt")


@query("rate_limited", """
SELECT event_id, contains(props, '429') OR contains(lower(props), 'rate_limit') AS openai, contains(props, '429') OR contains(lower(props), 'quota') AS gemini FROM events""")
def rate_limited(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", models.is_rate_limit(F.col("props")).alias("openai"), models.is_rate_limit(F.col("props"), "gemini").alias("gemini"))


# No line of a repaired text with a change is a line of the text before, so the lines that stay are those that are alike in place.
END_SQL = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
DIFF_SQL = rf"""
cut AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'eosn', 'c05u'), '[^{END_SQL}]*(?:\r\n|[{END_SQL}])|[^{END_SQL}]+') AS p FROM documents WHERE text IS NOT NULL),
rows_ AS (SELECT doc_id, u.i, p[u.i] AS a, translate(p[u.i], 'c0', 'eo') AS b, len(p) AS n FROM cut, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) u),
changed AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM rows_ WHERE a <> b),
numbered AS (SELECT *, count(*) FILTER (step > 7) OVER w AS hunk, i - row_number() OVER w AS run FROM changed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, run) AS first FROM numbered),
spans AS (SELECT doc_id, hunk, greatest(1, min(i) - 3) AS low, least(max(n), max(i) + 3) AS high FROM numbered GROUP BY doc_id, hunk),
said AS (
  SELECT s.doc_id, s.hunk, s.low, s.high, coalesce(c.first, r.i) AS run, k.k, r.i, CASE WHEN c.first IS NULL THEN ' ' || r.a WHEN k.k = 0 THEN '-' || r.a ELSE '+' || r.b END AS line
  FROM spans s JOIN rows_ r ON r.doc_id = s.doc_id AND r.i BETWEEN s.low AND s.high LEFT JOIN runs c ON c.doc_id = r.doc_id AND c.i = r.i, (SELECT unnest([0, 1]) AS k) k
  WHERE k.k = 0 OR c.first IS NOT NULL),
marked AS (SELECT *, CASE WHEN low = high THEN low::VARCHAR ELSE low || ',' || (high - low + 1) END AS span FROM said),
hunks AS (
  SELECT doc_id, hunk, low - 1 AS old_start, high - low + 1 AS old_lines, '@@ -' || any_value(span) || ' +' || any_value(span) || ' @@' || string_agg(line, '' ORDER BY run, k, i) AS text
  FROM marked GROUP BY doc_id, hunk, low, high)
"""


@query("diff_hunks", f"WITH {DIFF_SQL} SELECT doc_id, hunk, old_start, old_lines, old_start AS new_start, old_lines AS new_lines, text FROM hunks")
def diff_hunks(spark, sf_dir):
    docs = spread(read(spark, sf_dir, "documents"), "doc_id")
    return docs.select("doc_id", F.posexplode(T.hunks(noisy("text"), repaired(noisy("text")))).alias("hunk", "h")).select("doc_id", "hunk", "h.*")


@query("unified_diffs", f"""WITH {DIFF_SQL}, whole AS (SELECT doc_id, '--- ocr_raw+++ llm_corrected' || string_agg(text, '' ORDER BY hunk) AS diff FROM hunks GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(w.diff, '') END AS diff FROM documents d LEFT JOIN whole w USING (doc_id)""")
def unified_diffs(spark, sf_dir):
    docs = spread(read(spark, sf_dir, "documents"), "doc_id")
    return docs.select("doc_id", T.unified_diff(noisy("text"), repaired(noisy("text"))).alias("diff"))


@query("resume_stream_ext", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def resume_stream_ext(spark, sf_dir):
    """The latest event of each user by way of a file stream; the same rows as a batch gives."""
    import uuid

    from pagewright.streaming import resume

    root = f"{shared_dir(spark)}/pagewright/stream-{uuid.uuid4().hex}"
    like = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    resume.upserting(resume.table_stream(spark, sf_dir, read(spark, sf_dir, "events"), "events.parquet").select(*like.columns, F.col("event_id").alias("order")), f"{root}/table", ["user_id"], "order", f"{root}/state").awaitTermination()
    return resume.latest(spark, f"{root}/table", None, ["user_id"], "order").select("user_id", "event_id", "event_type")
