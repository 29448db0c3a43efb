"""Grey values as tables (image, v): histograms, Otsu's threshold, binarisation; rows of samples: the running median."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, *image: str) -> DataFrame:
    return pixels.groupBy(*image, "v").agg(F.count("*").alias("n"))


def levels(pixels: DataFrame, *image: str) -> DataFrame:
    """(image, levels): how many grey values occur."""
    return pixels.groupBy(*image).agg(F.count_distinct("v").alias("levels"))


def otsu(pixels: DataFrame, *image: str) -> DataFrame:
    """(image, threshold): the grey value t for which v <= t and v > t differ most (between-class variance), the smallest
    such. An image of one value has that value. From sums of whole numbers: n0 * n1 * (mean0 - mean1)^2, compared as a
    quotient. A histogram has 256 rows at most, whatever the size of the image."""
    own = Window.partitionBy(*image)
    upto = own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cells = histogram(pixels, *image).withColumn("mass", (F.col("v") * F.col("n")).cast("long"))
    cells = cells.select(*image, "v", F.sum("n").over(upto).alias("n0"), F.sum("mass").over(upto).alias("m0"), F.sum("n").over(own).alias("n"), F.sum("mass").over(own).alias("m"))
    spread = (F.col("m0") * F.col("n") - F.col("m") * F.col("n0")).cast("double")
    rest = F.col("n") - F.col("n0")
    variance = F.when(rest > 0, spread * spread / (F.col("n0").cast("double") * rest)).otherwise(F.lit(0.0))
    best = cells.withColumn("variance", variance).groupBy(*image).agg(F.max(F.struct("variance", (-F.col("v")).alias("least"))).alias("best"))
    return best.select(*image, (-F.col("best.least")).cast("int").alias("threshold"))


def binarized(pixels: DataFrame, *image: str, few: int = 4) -> DataFrame:
    """pixels with v as 0 or 255 by Otsu's threshold; an image of at most ``few`` grey values stays as it is."""
    bounds = otsu(pixels, *image).join(levels(pixels, *image), list(image))
    value = F.when(F.col("levels") <= few, F.col("v")).when(F.col("v") > F.col("threshold"), 255).otherwise(0)
    return pixels.join(bounds, list(image)).withColumn("v", value.cast("int")).drop("levels", "threshold")


def odd(size: int) -> int:
    """The size of a median's window: at least 1, and odd."""
    size = max(1, size)
    return size + 1 - size % 2


def median_row(samples: DataFrame, array: str, out: str, size: int = 3) -> DataFrame:
    """samples with the running median of an array; beyond its ends the end samples go on."""
    reach, n = odd(size) // 2, F.size(array)
    middle = lambda i: F.get(
        F.array_sort(F.transform(F.sequence(i - reach, i + reach), lambda k: F.get(F.col(array), F.greatest(F.lit(0), F.least(k, n - 1))))), F.lit(reach)
    )
    return samples.withColumn(out, F.transform(F.sequence(F.lit(0), n - 1), middle))
