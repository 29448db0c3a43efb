"""Page names, paths, boxes and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEM = r"([^/]+?)(\.[^./]*)?$"


def stem(path: Column) -> Column:
    """The last component of a path without its last suffix."""
    return F.regexp_extract(posix(path), STEM, 1)


def page_id(of_stem: Column, number: Column) -> Column:
    """The document's stem and the page number, padded to four digits (wider from 10000 on)."""
    return F.format_string("%s_p%04d", of_stem, number)


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def area(box: Column) -> Column:
    return box["w"] * box["h"]


def box_tuple(box: Column) -> Column:
    return F.array(box["x"], box["y"], box["w"], box["h"])


def crop_name(region: Column, line: Column) -> Column:
    """A line's crop, or the region's where there is no line."""
    return F.when(line.isNotNull(), F.format_string("line_%03d_%03d.png", region, line)).otherwise(F.format_string("region_%03d.png", region))


def fit_width(w: Column, h: Column, most: int = 2000) -> Column:
    """(w, h) at a width of ``most`` where it is wider, cut off to whole pixels."""
    wide = w > most
    return F.struct(F.when(wide, most).otherwise(w).cast("int").alias("w"), F.when(wide, (h * (most / w.cast("double"))).cast("int")).otherwise(h).cast("int").alias("h"))


def fit_box(w: Column, h: Column, most: int = 1568) -> Column:
    """(w, h) within a square of side ``most``, cut off to whole pixels; smaller ones as they are."""
    scale = F.least(F.lit(1.0), most / w.cast("double"), most / h.cast("double"))
    return F.struct((w * scale).cast("int").alias("w"), (h * scale).cast("int").alias("h"))


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luminance of an 8-bit pixel, rounded (weights 0.299, 0.587, 0.114)."""
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")
