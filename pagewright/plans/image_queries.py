"""Queries of image operators over the test tables: embeddings scaled to grey values are the pixels of small images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pagewright.functions import pages as P
from pagewright.operators import histogram, image
from pagewright.plans.registry import query
from pagewright.plans.text_queries import read, spread

GRAY_SQL = "gray AS (SELECT vec_id, u.i - 1 AS i, greatest(0, least(255, floor((embedding[u.i]::DOUBLE + 0.5) * 255)))::INT AS v FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) u)"
OTSU_SQL = f"""{GRAY_SQL},
cells AS (SELECT vec_id, v, count(*) AS k FROM gray GROUP BY ALL),
sums AS (
  SELECT vec_id, v, sum(k) OVER u AS n0, sum(v * k) OVER u AS m0, sum(k) OVER (PARTITION BY vec_id) AS n, sum(v * k) OVER (PARTITION BY vec_id) AS m
  FROM cells WINDOW u AS (PARTITION BY vec_id ORDER BY v)),
scored AS (SELECT vec_id, v, CASE WHEN n > n0 THEN (m0 * n - m * n0)::DOUBLE * (m0 * n - m * n0)::DOUBLE / (n0::DOUBLE * (n - n0)) ELSE 0 END AS variance FROM sums),
ranked AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY variance DESC, v) AS r FROM scored),
otsu AS (SELECT vec_id, v AS threshold FROM ranked WHERE r = 1)
"""


def gray(spark, sf_dir):
    cells = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 0.5) * 255)))
    return cells.select("vec_id", "i", value.cast("int").alias("v"))


@query("gray_histogram", f"WITH {GRAY_SQL} SELECT vec_id, v, count(*) AS n FROM gray GROUP BY ALL")
def gray_histogram(spark, sf_dir):
    return histogram.histogram(gray(spark, sf_dir), "vec_id")


@query("gray_levels", f"WITH {GRAY_SQL} SELECT vec_id, count(DISTINCT v) AS levels FROM gray GROUP BY ALL")
def gray_levels(spark, sf_dir):
    return histogram.levels(gray(spark, sf_dir), "vec_id")


@query("otsu_threshold", f"WITH {OTSU_SQL} SELECT * FROM otsu")
def otsu_threshold(spark, sf_dir):
    return histogram.otsu(gray(spark, sf_dir), "vec_id")


@query("otsu_binarize", f"""WITH {OTSU_SQL}, levels AS (SELECT vec_id, count(DISTINCT v) AS levels FROM gray GROUP BY ALL)
SELECT g.vec_id, i, CASE WHEN levels <= 4 THEN v WHEN v > threshold THEN 255 ELSE 0 END AS v FROM gray g JOIN otsu USING (vec_id) JOIN levels USING (vec_id)""")
def otsu_binarize(spark, sf_dir):
    return histogram.binarized(gray(spark, sf_dir), "vec_id")


@query("median_1d", f"""WITH {GRAY_SQL},
last_ AS (SELECT vec_id, max(i) AS top FROM gray GROUP BY vec_id),
near AS (SELECT g.vec_id, g.i, n.v FROM gray g JOIN last_ USING (vec_id), LATERAL (SELECT unnest([-1, 0, 1]) AS k) t JOIN gray n ON n.vec_id = g.vec_id AND n.i = greatest(0, least(top, g.i + k)))
SELECT vec_id, i, quantile_disc(v, 0.5) AS v FROM near GROUP BY vec_id, i""")
def median_1d(spark, sf_dir):
    rows = gray(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select("vec_id", F.col("c.v").alias("v"))
    return histogram.median_row(rows, "v", "m", 3).select("vec_id", F.posexplode("m").alias("i", "v"))


@query("to_gray", f"""WITH {GRAY_SQL}
SELECT vec_id, i, floor((v * 299 + (v * 7 % 256) * 587 + (v * 13 % 256) * 114 + 500) / 1000)::INT AS v FROM gray""")
def to_gray(spark, sf_dir):
    v = F.col("v")
    return gray(spark, sf_dir).select("vec_id", "i", P.gray(v, v * 7 % 256, v * 13 % 256).alias("v"))


@query("resize_dims", """
WITH s AS (SELECT p_partkey, (p_partkey * 13 % 4000 + 1) AS w, (p_size * 97 % 3000 + 1) AS h FROM part),
f AS (SELECT *, least(1.0::DOUBLE, 1568 / w::DOUBLE, 1568 / h::DOUBLE) AS scale FROM s)
SELECT p_partkey, CASE WHEN w > 2000 THEN 2000 ELSE w END::INT AS wide_w, CASE WHEN w > 2000 THEN trunc(h * (2000 / w::DOUBLE)) ELSE h END::INT AS wide_h,
       trunc(w * scale)::INT AS box_w, trunc(h * scale)::INT AS box_h FROM f""")
def resize_dims(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 13 % 4000 + 1).alias("w"), (F.col("p_size") * 97 % 3000 + 1).alias("h"))
    wide, box = P.fit_width(F.col("w"), F.col("h")), P.fit_box(F.col("w"), F.col("h"))
    return part.select("p_partkey", wide["w"].alias("wide_w"), wide["h"].alias("wide_h"), box["w"].alias("box_w"), box["h"].alias("box_h"))


# --- kernels on small images: every embedding is 8 rows of 8 pixels ----------------------------------------------------

SMALL_SQL = f"{GRAY_SQL}, img AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM gray WHERE i < 64)"
NEAR_SQL = "(SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b"


def small_pages(spark, sf_dir, change=lambda v, i: v):
    """(page_id, h, w, data) of the first 64 values of each embedding; change: what becomes of a value at a place."""
    value = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.5) * 255))).cast("int")
    cells = F.transform(F.slice("embedding", 1, 64), lambda e, i: F.lpad(F.hex(change(value(e), i).cast("long")), 2, "0"))
    return read(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 64).select(F.col("vec_id").alias("page_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(cells, "")).alias("data"))


def pixels(pages):
    """(vec_id, y, x, v)."""
    byte = F.conv(F.hex(F.substring("data", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    rows = pages.select("page_id", "w", "data", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("i"))
    return rows.select(F.col("page_id").alias("vec_id"), F.floor(F.col("i") / F.col("w")).alias("y"), (F.col("i") % F.col("w")).cast("long").alias("x"), byte.alias("v"))


@query("median_8x8", f"""WITH {SMALL_SQL}
SELECT g.vec_id, g.y, g.x, quantile_disc(n.v, 0.5) AS v FROM img g, {NEAR_SQL}, img n
WHERE n.vec_id = g.vec_id AND n.y = greatest(0, least(7, g.y + dy)) AND n.x = greatest(0, least(7, g.x + dx)) GROUP BY ALL""")
def median_8x8(spark, sf_dir):
    return pixels(image.map_pages(small_pages(spark, sf_dir), image.median))


@query("median_5_8x8", f"""WITH {SMALL_SQL}, steps AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k)
SELECT g.vec_id, g.y, g.x, quantile_disc(n.v, 0.5) AS v FROM img g, steps a, steps b, img n
WHERE n.vec_id = g.vec_id AND n.y = greatest(0, least(7, g.y + a.k)) AND n.x = greatest(0, least(7, g.x + b.k)) GROUP BY ALL""")
def median_5_8x8(spark, sf_dir):
    return pixels(image.map_pages(small_pages(spark, sf_dir), lambda x: image.median(x, 5)))


@query("closing_8x8", f"""WITH {SMALL_SQL},
wide AS (SELECT g.vec_id, g.y, g.x, max(n.v) AS v FROM img g, {NEAR_SQL}, img n WHERE n.vec_id = g.vec_id AND n.y = g.y + dy AND n.x = g.x + dx GROUP BY ALL)
SELECT g.vec_id, g.y, g.x, min(n.v) AS v FROM wide g, {NEAR_SQL}, wide n WHERE n.vec_id = g.vec_id AND n.y = g.y + dy AND n.x = g.x + dx GROUP BY ALL""")
def closing_8x8(spark, sf_dir):
    """Spread and shrunk again, as regions are found."""
    return pixels(image.map_pages(small_pages(spark, sf_dir), lambda x: image.erode(image.dilate(x, 3, 3), 3, 3)))


@query("adaptive_threshold_8x8", f"""WITH {SMALL_SQL},
taps AS (SELECT k - 17 AS k, exp(-((k - 17) ** 2) / (2 * (0.3 * (34 * 0.5 - 1) + 0.8)::DOUBLE ** 2)) AS g FROM (SELECT unnest(range(0, 35)) AS k)),
weights AS (SELECT k, g / sum(g) OVER () AS g FROM taps),
down AS (SELECT i.vec_id, i.y, i.x, sum(w.g * n.v) AS m FROM img i, weights w, img n WHERE n.vec_id = i.vec_id AND n.x = i.x AND n.y = greatest(0, least(7, i.y + w.k)) GROUP BY ALL),
mean AS (SELECT i.vec_id, i.y, i.x, sum(w.g * n.m) AS m FROM img i, weights w, down n WHERE n.vec_id = i.vec_id AND n.y = i.y AND n.x = greatest(0, least(7, i.x + w.k)) GROUP BY ALL)
SELECT i.vec_id, i.y, i.x, CASE WHEN i.v > round_even(m.m, 0) - 11 THEN 255 ELSE 0 END::INT AS v FROM img i JOIN mean m USING (vec_id, y, x)""")
def adaptive_threshold_8x8(spark, sf_dir):
    return pixels(image.map_pages(small_pages(spark, sf_dir), image.adaptive_threshold))


@query("bilateral_8x8", f"""WITH {SMALL_SQL},
near AS (SELECT g.vec_id, g.y, g.x, g.v, n.v AS o, dy, dx FROM img g, {NEAR_SQL}, img n WHERE dy * dy + dx * dx <= 1 AND n.vec_id = g.vec_id AND n.y = (7 - abs(7 - abs(g.y + dy))) AND n.x = (7 - abs(7 - abs(g.x + dx)))),
weighed AS (SELECT *, exp(-(dy * dy + dx * dx) / (2 * 75.0::DOUBLE ** 2)) * exp(-((o - v) ** 2)::DOUBLE / (2 * 75.0::DOUBLE ** 2)) AS g FROM near)
SELECT vec_id, y, x, round_even(sum(g * o) / sum(g), 0)::INT AS v FROM weighed GROUP BY vec_id, y, x""")
def bilateral_8x8(spark, sf_dir):
    return pixels(image.map_pages(small_pages(spark, sf_dir), image.bilateral))


@query("components_8x8", f"""WITH RECURSIVE {SMALL_SQL},
ink AS (SELECT vec_id, y, x, y * 8 + x AS p FROM img WHERE v > 140),
reach AS (
  SELECT vec_id, p, p AS q FROM ink
  UNION SELECT r.vec_id, r.p, n.p FROM reach r, ink n WHERE n.vec_id = r.vec_id AND abs(n.y - r.q // 8) <= 1 AND abs(n.x - r.q % 8) <= 1),
label AS (SELECT vec_id, p, min(q) AS c FROM reach GROUP BY ALL)
SELECT vec_id, min(p % 8) AS x, min(p // 8) AS y, max(p % 8) - min(p % 8) + 1 AS w, max(p // 8) - min(p // 8) + 1 AS h FROM label GROUP BY vec_id, c""")
def components_8x8(spark, sf_dir):
    return image.map_boxes(small_pages(spark, sf_dir), lambda x: image.components(x > 140, outer_only=False)).withColumnRenamed("page_id", "vec_id")


# Two by two tiles of 16 pixels: a bin holds one at most, what is cut off goes to bins in even steps.
@query("clahe_8x8", f"""WITH {SMALL_SQL},
cells AS (SELECT vec_id, y // 4 AS ty, x // 4 AS tx, v, count(*) AS n FROM img GROUP BY ALL),
cut AS (SELECT vec_id, ty, tx, (sum(n - 1))::INT AS excess FROM cells GROUP BY ALL),
bins AS (SELECT vec_id, ty, tx, excess, b.v FROM cut, (SELECT unnest(range(0, 256)) AS v) b),
filled AS (
  SELECT b.vec_id, b.ty, b.tx, b.v, CASE WHEN c.n IS NULL THEN 0 ELSE 1 END + CASE WHEN excess > 0 AND b.v % (256 // excess) = 0 AND b.v // (256 // excess) < excess THEN 1 ELSE 0 END AS n
  FROM bins b LEFT JOIN cells c ON c.vec_id = b.vec_id AND c.ty = b.ty AND c.tx = b.tx AND c.v = b.v),
tables AS (SELECT vec_id, ty, tx, v, least(255, round_even((sum(n) OVER (PARTITION BY vec_id, ty, tx ORDER BY v))::DOUBLE * (255.0::DOUBLE / 16), 0)) AS t FROM filled),
places AS (SELECT k, greatest(0, least(1, floor((k + 0.5::DOUBLE) / 4 - 0.5)))::INT AS low, greatest(0, least(1, floor((k + 0.5::DOUBLE) / 4 - 0.5) + 1))::INT AS high, (k + 0.5::DOUBLE) / 4 - 0.5 - floor((k + 0.5::DOUBLE) / 4 - 0.5) AS f
  FROM (SELECT unnest(range(0, 8)) AS k))
SELECT i.vec_id, i.y, i.x, greatest(0, least(255, round_even((a.t * (1 - p.f) + b.t * p.f) * (1 - q.f) + (c.t * (1 - p.f) + d.t * p.f) * q.f, 0)))::INT AS v
FROM img i JOIN places p ON p.k = i.x JOIN places q ON q.k = i.y
JOIN tables a ON a.vec_id = i.vec_id AND a.v = i.v AND a.ty = q.low AND a.tx = p.low JOIN tables b ON b.vec_id = i.vec_id AND b.v = i.v AND b.ty = q.low AND b.tx = p.high
JOIN tables c ON c.vec_id = i.vec_id AND c.v = i.v AND c.ty = q.high AND c.tx = p.low JOIN tables d ON d.vec_id = i.vec_id AND d.v = i.v AND d.ty = q.high AND d.tx = p.high""")
def clahe_8x8(spark, sf_dir):
    return pixels(image.map_pages(small_pages(spark, sf_dir), lambda x: image.clahe(x, 2.0, (2, 2))))


# Of three images one has a frame with ground within, one such a frame with a gap in it, and one is as it is.
@query("contours_8x8", f"""WITH RECURSIVE {SMALL_SQL},
framed AS (
  SELECT vec_id, y, x, CASE WHEN vec_id % 3 = 2 THEN v > 140 WHEN y IN (0, 7) OR x IN (0, 7) THEN vec_id % 3 = 0 OR y <> 0 OR x <> 3 WHEN y IN (1, 6) OR x IN (1, 6) THEN false ELSE v > 140 END AS ink
  FROM img),
ink AS (SELECT vec_id, y, x, y * 8 + x AS p FROM framed WHERE ink),
reach AS (
  SELECT vec_id, p, p AS q FROM ink
  UNION SELECT r.vec_id, r.p, n.p FROM reach r, ink n WHERE n.vec_id = r.vec_id AND abs(n.y - r.q // 8) <= 1 AND abs(n.x - r.q % 8) <= 1),
label AS (SELECT vec_id, p, min(q) AS c FROM reach GROUP BY ALL),
ground AS (
  SELECT i.vec_id, a.y, b.x FROM (SELECT DISTINCT vec_id FROM img) i, (SELECT unnest(range(-1, 9)) AS y) a, (SELECT unnest(range(-1, 9)) AS x) b
  LEFT JOIN ink k ON k.vec_id = i.vec_id AND k.y = a.y AND k.x = b.x WHERE k.p IS NULL),
outside AS (
  SELECT DISTINCT vec_id, -1 AS y, -1 AS x FROM img
  UNION SELECT g.vec_id, g.y, g.x FROM outside o, ground g WHERE g.vec_id = o.vec_id AND abs(g.y - o.y) + abs(g.x - o.x) = 1),
outer_ AS (SELECT DISTINCT l.vec_id, l.c FROM label l, outside o WHERE o.vec_id = l.vec_id AND abs(l.p // 8 - o.y) + abs(l.p % 8 - o.x) = 1)
SELECT vec_id, min(p % 8) AS x, min(p // 8) AS y, max(p % 8) - min(p % 8) + 1 AS w, max(p // 8) - min(p // 8) + 1 AS h FROM label JOIN outer_ USING (vec_id, c) GROUP BY vec_id, c""")
def contours_8x8(spark, sf_dir):
    """Outermost components only."""
    y, x, of = (lambda i: F.floor(i / 8)), (lambda i: i % 8), F.col("vec_id") % 3

    def framed(v, i):
        edge, next_ = y(i).isin(0, 7) | x(i).isin(0, 7), y(i).isin(1, 6) | x(i).isin(1, 6)
        return F.when(of == 2, v).when(edge, F.when((of == 0) | (i != 3), 255).otherwise(0)).when(next_, 0).otherwise(v)

    return image.map_boxes(small_pages(spark, sf_dir, framed), lambda p: image.components(p > 140)).withColumnRenamed("page_id", "vec_id")


# --- page kernels: rows only --------------------------------------------------------------------------------------


#: The characters that are drawn as nothing.
SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)


def drawn(text: str) -> np.ndarray:
    """A text as a page."""
    cut = [line[i : i + 64].ljust(64) for line in text.split("\n") for i in range(0, max(1, len(line)), 64)]
    codes = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32)
    pixels = np.where(np.isin(codes, SPACES), 230, codes % 90).astype(np.uint8).reshape(-1, 1, 64, 1)
    page = np.full((12 * len(cut) + 16, 4 * 64 + 16), 230, np.uint8)
    page[8:-8, 8:-8].reshape(-1, 12, 64, 4)[:, :8, :, :3] = pixels
    return page


def texts(spark, sf_dir):
    """Texts to draw, in four parts a core at least: with few and long ones, cores wait for the last."""
    return spread(read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "doc_id", 4)


def text_pages(spark, sf_dir):
    """(page_id, h, w, data): every document drawn as a page, 4 x 6 dark pixels a visible character, 64 in a line."""

    def draw(parts):
        for part in parts:
            pages = ((doc_id, drawn(text.as_py())) for doc_id, text in zip(part.column("doc_id"), part.column("text"), strict=True))
            yield from image.in_batches(((doc_id, *page.shape, page.tobytes()) for doc_id, page in pages), part.schema.field("doc_id").type)

    return texts(spark, sf_dir).mapInArrow(draw, "page_id long, h int, w int, data binary")


def _digest(pages):
    return pages.select("page_id", "h", "w", F.md5("data").alias("digest"))


def _kernel(name, kernel):
    """Pages are drawn where the kernel takes them, as files are decoded, so that their pixels go from task to Spark once."""

    @query(name)
    def run(spark, sf_dir):
        none = {"h": F.lit(0), "w": F.lit(0), "data": F.lit(b"")}
        return _digest(image.map_pages(texts(spark, sf_dir).withColumnRenamed("doc_id", "page_id").withColumns(none), kernel, "text", drawn))


_kernel("median_2d", image.median)
_kernel("bilateral", image.bilateral)
_kernel("clahe", image.clahe)
_kernel("adaptive_threshold", image.adaptive_threshold)
_kernel("deskew", lambda x: image.deskew(image.rotate(x, 2.0)))
_kernel("preprocess", image.preprocess)


@query("components")
def components(spark, sf_dir):
    return image.map_boxes(text_pages(spark, sf_dir), lambda x: image.components(image.dilate(255 - image.ensure_binary(x), 15, 5) > 0))


@query("detect_regions")
def detect_regions(spark, sf_dir):
    from pagewright.operators import layout

    return layout.reading_order(image.map_boxes(text_pages(spark, sf_dir), image.regions))


@query("skew_angles")
def skew_angles(spark, sf_dir):
    return image.map_numbers(text_pages(spark, sf_dir), lambda x: image.skew(image.ensure_binary(x)), "angle")
