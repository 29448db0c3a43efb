"""Bounds on the batches of rows that go to Python. Rows that hold a page image are large, and a batch is held whole."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch (with one row more at most), and of a row group of a table of images: a reader holds a group's column.
BATCH_BYTES, GROUP_BYTES = 16 << 20, 32 << 20
#: Pixels of the pages that one task should get, and shares into which ids are hashed to weigh them, for each part.
TASK_PIXELS, SHARES = 256_000_000, 8
#: Writer options: a group ends by its bytes, counted from its first rows on.
IMAGE_TABLE = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def bounded(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs within the block send batches of so many bytes; the session's own bound is there again after it."""
    before = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)


def dealt(pages: DataFrame, task_pixels: int = TASK_PIXELS) -> DataFrame:
    """pages (with page_id, h, w) in tasks of about as many pixels each.

    A table of pages that pack well is few splits, however much work their pixels are. Its sizes are summed by shares of hashed
    ids, and shares in a row make a part; pages go where they are if the scan has as many parts as that already."""
    pixels = F.col("h").cast("long") * F.col("w")
    total = pages.agg(F.sum(pixels)).first()[0] or 0
    parts = min(-(-total // task_pixels), 1 << 12)
    if parts <= 1 or parts <= pages.select("page_id").rdd.getNumPartitions():
        return pages
    shares = parts * SHARES
    share = F.pmod(F.xxhash64("page_id"), F.lit(shares)).cast("int")
    sizes = dict(pages.groupBy(share.alias("share")).agg(F.sum(pixels)).collect())
    before, at = 0, []
    for i in range(shares):
        at.append(min(parts - 1, before * parts // total))
        before += sizes.get(i, 0)
    return pages.repartitionById(parts, F.element_at(F.array(*map(F.lit, at)), share + 1))
