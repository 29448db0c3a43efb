"""Queries of layout operators over the test tables.

Boxes come from order lines (a page per order), profiles and pixels from documents seen as rasters: a line is a row, a
character a pixel, anything but a space is ink.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import pages as P
from pagewright.operators import layout, models
from pagewright.plans.registry import query
from pagewright.plans.text_queries import read, spread

BOX_SQL = """
boxes AS (
  SELECT l_orderkey AS page_id, l_linenumber::INT AS n, (l_partkey * 7 % 900)::INT AS x, (l_suppkey * 37 % 1300)::INT AS y,
         (20 + l_partkey % 300)::INT AS w, (10 + l_quantity::BIGINT * 5)::INT AS h
  FROM lineitem)
"""


def boxes(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") * 7 % 900).cast("int").alias("x"), (F.col("l_suppkey") * 37 % 1300).cast("int").alias("y"),
        (20 + F.col("l_partkey") % 300).cast("int").alias("w"), (10 + F.col("l_quantity").cast("long") * 5).cast("int").alias("h"),
    )


@query("box_filter", f"WITH {BOX_SQL} SELECT *, w * h AS area FROM boxes WHERE w * h >= 5000 AND w >= 30 AND h >= 30")
def box_filter(spark, sf_dir):
    found = layout.region_filter(boxes(spark, sf_dir))
    return found.withColumn("area", P.area(F.struct("x", "y", "w", "h")))


@query("reading_order_single", f"WITH {BOX_SQL} SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, n, h, w) - 1 AS \"order\" FROM boxes")
def reading_order_single(spark, sf_dir):
    return layout.reading_order(boxes(spark, sf_dir), tie=("n", "h", "w"))


@query("reading_order_two_column", f"""WITH {BOX_SQL}
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN x + w / 2.0 < 500 THEN 0 ELSE 1 END, y, x, n, h, w) - 1 AS "order" FROM boxes""")
def reading_order_two_column(spark, sf_dir):
    return layout.reading_order(boxes(spark, sf_dir), two_columns=True, width=F.lit(1000), tie=("n", "h", "w"))


@query("regions_to_items", f"""WITH {BOX_SQL},
regions AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, n, h, w) - 1 AS o FROM boxes),
lines AS (
  SELECT r.*, u.k AS k, y + u.k * 20 AS ly FROM regions r, LATERAL (SELECT unnest(range(0, 3)) AS k) u WHERE o % 2 = 0 AND h >= (u.k + 1) * 20)
SELECT page_id, 'line' AS type, o AS region_order, k AS line_order, x, ly AS y, w, 20 AS h FROM lines
UNION ALL
SELECT page_id, 'region', o, NULL, x, y, w, h FROM regions r WHERE NOT (o % 2 = 0 AND h >= 20)""")
def regions_to_items(spark, sf_dir):
    regions = layout.reading_order(boxes(spark, sf_dir), tie=("n", "h", "w"))
    own = regions.filter("order % 2 = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter("h >= (k + 1) * 20")
    lines = own.select("page_id", F.col("order").alias("region_order"), F.col("k").alias("line_order"), "x", (F.col("y") + F.col("k") * 20).alias("y"), "w", F.lit(20).alias("h"))
    found = layout.items(layout.nested(regions, lines))
    return found.select("page_id", "type", "region_order", "line_order", *(F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")))


@query("crop_names", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN printf('line_%03d_%03d.png', l_linenumber, l_linenumber + 1) ELSE printf('region_%03d.png', l_linenumber) END AS name FROM lineitem""")
def crop_names(spark, sf_dir):
    n = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.crop_name(n, F.when(n % 2 == 0, n + 1)).alias("name"))


# --- profiles -------------------------------------------------------------------------------------------------------

PROFILE_SQL = """
profile AS (
  SELECT doc_id, u.n - 1 AS y, length(replace(string_split(text, chr(10))[u.n], ' ', ''))::BIGINT AS ink
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n) u),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM profile)
"""
SMOOTH_SQL = f"""{PROFILE_SQL},
taps AS (SELECT unnest(range(-4, 5)) AS k),
idx AS (
  SELECT s.doc_id, s.y, s.ink, s.n, CASE WHEN n = 1 THEN 0 ELSE ((s.y + k) % (2 * (n - 1)) + 2 * (n - 1)) % (2 * (n - 1)) END AS m FROM sized s, taps),
refl AS (SELECT doc_id, y, ink, CASE WHEN n = 1 OR m < n THEN m ELSE 2 * (n - 1) - m END AS j FROM idx),
smooth AS (SELECT r.doc_id, r.y, r.ink, sum(p.ink) / 9.0::DOUBLE AS smooth FROM refl r JOIN profile p ON p.doc_id = r.doc_id AND p.y = r.j GROUP BY ALL),
bound AS (SELECT doc_id, greatest(5.0::DOUBLE, quantile_cont(smooth, 0.6)) AS threshold FROM smooth GROUP BY doc_id)
"""
RUNS_SQL = f"""{SMOOTH_SQL},
marked AS (SELECT doc_id, y, y - row_number() OVER (PARTITION BY doc_id ORDER BY y) AS island FROM smooth JOIN bound USING (doc_id) WHERE smooth >= threshold - 1e-9),
runs AS (SELECT doc_id, min(y) AS top, max(y) AS bottom FROM marked GROUP BY doc_id, island HAVING max(y) - min(y) + 1 >= 2)
"""
MERGE_SQL = f"""{RUNS_SQL},
steps AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY doc_id ORDER BY top) - 1 <= 1 THEN 0 ELSE 1 END AS fresh FROM runs),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY top) AS g FROM steps),
merged AS (SELECT doc_id, min(top) AS top, max(bottom) AS bottom FROM grouped GROUP BY doc_id, g)
"""


def profile(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("y", "line"))
    return lines.select("doc_id", "y", F.char_length(F.replace("line", F.lit(" "), F.lit(""))).cast("long").alias("ink"))


def raster(spark, sf_dir):
    """(doc_id, y, x, v): a pixel per character; spaces are white."""
    lines = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("y", "line"))
    pixels = lines.select("doc_id", "y", F.char_length("line").alias("w"), F.posexplode(F.split("line", "")).alias("x", "c")).filter("c <> ''")
    return pixels.select("doc_id", "y", "x", "w", F.when(F.col("c") == " ", 255).otherwise(0).alias("v"))


@query("row_projection", f"WITH {PROFILE_SQL}, chars AS (SELECT doc_id, u.n - 1 AS y, length(string_split(text, chr(10))[u.n]) AS w FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n) u) SELECT p.doc_id, p.y, p.ink FROM profile p JOIN chars c ON p.doc_id = c.doc_id AND p.y = c.y WHERE c.w > 0")
def row_projection(spark, sf_dir):
    return layout.row_projection(raster(spark, sf_dir), "doc_id")


@query("profile_smooth", f"WITH {SMOOTH_SQL} SELECT doc_id, y, ink, round(smooth, 9) AS smooth FROM smooth")
def profile_smooth(spark, sf_dir):
    return layout.smooth(profile(spark, sf_dir), "doc_id").withColumn("smooth", F.round("smooth", 9))


@query("line_threshold", f"WITH {SMOOTH_SQL} SELECT doc_id, round(threshold, 9) AS threshold FROM bound")
def line_threshold(spark, sf_dir):
    return layout.thresholds(profile(spark, sf_dir), "doc_id").withColumn("threshold", F.round("threshold", 9))


def _runs(spark, sf_dir):
    # rows here are lines of text, few to a page: runs of two rows or more, joined over gaps of one
    p = profile(spark, sf_dir)
    marked = layout.smooth(p, "doc_id").join(layout.thresholds(p, "doc_id"), "doc_id")
    return layout.runs(marked.select("doc_id", "y", (F.col("smooth") >= F.col("threshold") - 1e-9).alias("on")), "doc_id", least_rows=2)


@query("line_runs", f"WITH {RUNS_SQL} SELECT * FROM runs")
def line_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query("line_merge", f"WITH {MERGE_SQL} SELECT * FROM merged")
def line_merge(spark, sf_dir):
    return layout.merged(_runs(spark, sf_dir), "doc_id", gap=1)


@query("segment_lines", f"WITH {MERGE_SQL} SELECT doc_id, top AS y, bottom - top + 1 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY top) - 1 AS line_order FROM merged")
def segment_lines(spark, sf_dir):
    return layout.segment_lines(profile(spark, sf_dir), "doc_id", least_rows=2, gap=1)


PIXELS_SQL = """
lines AS (SELECT doc_id, u.n - 1 AS y, string_split(text, chr(10))[u.n] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n) u),
inked AS (SELECT doc_id, y, length(line) AS w, length(line) - length(ltrim(line, ' ')) AS first, length(rtrim(line, ' ')) - 1 AS last, length(replace(line, ' ', '')) AS columns FROM lines)
"""


@query("tight_crop", f"""WITH {PIXELS_SQL},
cut AS (SELECT doc_id, y, greatest(0, first - 4) AS "left", least(w, last + 5) AS "right" FROM inked WHERE w >= 10 AND columns >= 5)
SELECT * FROM cut WHERE "right" - "left" >= 10""")
def tight_crop(spark, sf_dir):
    """Every line of text is a crop of one row of pixels."""
    lines = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("y", "line"))
    row = F.transform(F.split("line", ""), lambda c: F.when(c == " ", 255).when(c != "", 0))
    return layout.tight_crops_whole(lines, "doc_id", "y", rows=F.array(row), width=F.char_length("line"), height=F.lit(20))


@query("bounding_boxes", f"""WITH {PIXELS_SQL}
SELECT doc_id, min(first) AS x, min(y) AS y, max(last) - min(first) + 1 AS w, max(y) - min(y) + 1 AS h FROM inked WHERE columns > 0 GROUP BY doc_id""")
def bounding_boxes(spark, sf_dir):
    return layout.bounding_boxes(raster(spark, sf_dir).filter("v < 255"), "doc_id")


# --- items and read lines -------------------------------------------------------------------------------------------

ALIGN_SQL = """
items AS (SELECT conv_id, turn AS pos FROM conversations WHERE role = 'user' OR turn < 3),
lines AS (SELECT conv_id, turn AS pos, CASE WHEN turn % 4 = 1 THEN ' ' ELSE text END AS text FROM conversations),
both_ AS (
  SELECT coalesce(i.conv_id, l.conv_id) AS conv_id, coalesce(i.pos, l.pos) AS pos, CASE WHEN i.conv_id IS NULL THEN 'vlm_extra' ELSE 'line' END AS type, l.text
  FROM items i FULL JOIN lines l ON i.conv_id = l.conv_id AND i.pos = l.pos),
aligned AS (SELECT conv_id, pos, type, coalesce(text, '') AS text FROM both_ WHERE type = 'line' OR trim(coalesce(text, '')) <> '')
"""


def _aligned(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "role", "text")
    lines = turns.select("conv_id", "pos", F.when(F.col("pos") % 4 == 1, " ").otherwise(F.col("text")).alias("text"))
    return layout.aligned(turns.filter("role = 'user' OR pos < 3").select("conv_id", "pos"), lines, "conv_id")


@query("align_items_lines", f"WITH {ALIGN_SQL} SELECT * FROM aligned")
def align_items_lines(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query("page_text", f"""WITH {ALIGN_SQL}
SELECT conv_id, regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (trim(text) <> ''), ''), '^[\\s]+|[\\s]+$', '', 'g') || chr(10) AS text FROM aligned GROUP BY conv_id""")
def page_text(spark, sf_dir):
    return layout.page_text(_aligned(spark, sf_dir), "conv_id")


@query("confidence_geomean", """
SELECT vec_id, round(greatest(0, least(1, exp(list_sum(list_transform(embedding, lambda x: -abs(x::DOUBLE))) / len(embedding)))), 9) AS confidence FROM embeddings""")
def confidence_geomean(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    logs = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    return vectors.select("vec_id", F.round(models.geometric_confidence(logs), 9).alias("confidence"))
