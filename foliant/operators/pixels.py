"""Statistics and neighbourhoods over pixels in long form (img_id, y, x, lum)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_LIGHT = 60
DARK = 128
GAMMA = 0.75
NO_THRESHOLD = 127  # of an image with one level


def histogram(pixels: DataFrame) -> DataFrame:
    """img_id, lum, n. Map-side counts leave at most 256 rows of an image to shuffle."""
    return pixels.groupBy("img_id", "lum").agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """img_id, threshold: the lowest level of the largest variance between classes.

    Running sums over the levels of an image; levels without pixels before or after them take no part.
    """
    upto = Window.partitionBy("img_id").orderBy("lum").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img_id")
    h = histogram(pixels).select(
        "img_id", "lum",
        F.sum("n").over(upto).alias("wb"), F.sum(F.col("lum") * F.col("n")).over(upto).alias("sb"),
        F.sum("n").over(whole).alias("total"), F.sum(F.col("lum") * F.col("n")).over(whole).alias("all"),
    )
    wb, wf = F.col("wb").cast("double"), (F.col("total") - F.col("wb")).cast("double")
    gap = F.col("sb") / wb - (F.col("all") - F.col("sb")) / wf
    h = h.withColumn("var", F.when(wf > 0, wb * wf * gap * gap))
    best = F.max_by("lum", F.struct(F.col("var"), -F.col("lum")))
    # a single level has no variance at all: its only row has var null
    return h.groupBy("img_id").agg(F.coalesce(F.when(F.max("var") > 0, best), F.lit(NO_THRESHOLD)).cast("int").alias("threshold"))


def binarize(pixels: DataFrame) -> DataFrame:
    """img_id, y, x, bit: black at or under the image's threshold, else white."""
    return pixels.join(otsu(pixels), "img_id").select("img_id", "y", "x", F.when(F.col("lum") <= F.col("threshold"), 0).otherwise(255).alias("bit"))


def mean_intensity(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id").agg((F.sum("lum") / F.count("*")).alias("mean"))


def low_light(pixels: DataFrame) -> DataFrame:
    """img_id, median_level, low_light: the smallest level with half of the pixels at or under it, and if it is dark."""
    upto = Window.partitionBy("img_id").orderBy("lum").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(pixels).withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy("img_id")))
    least = h.where(F.col("cum") >= F.expr("total div 2")).groupBy("img_id").agg(F.min("lum").alias("median_level"))
    return least.withColumn("low_light", F.col("median_level") < LOW_LIGHT)


def invert_if_dark(pixels: DataFrame) -> DataFrame:
    mean = F.avg("lum").over(Window.partitionBy("img_id"))
    return pixels.withColumn("lum", F.when(mean < DARK, 255 - F.col("lum")).otherwise(F.col("lum")))


def gamma(pixels: DataFrame, by: float = GAMMA) -> DataFrame:
    """Levels raised in [0, 1], rounded to the nearest level."""
    return pixels.withColumn("lum", F.floor(F.round(F.pow(F.col("lum") / 255.0, F.lit(by)) * 255.0, 6) + 0.5).cast("int"))


def _by_image(pixels: DataFrame) -> DataFrame:
    """Pixels of an image together: then windows over its rows and over its columns need no further shuffle."""
    return pixels.repartition("img_id")


def sharpen(pixels: DataFrame, channels=("lum",)) -> DataFrame:
    """9 times the pixel less its four neighbours, clamped; the border stays. (The weights add up to 5.)"""
    row, col = Window.partitionBy("img_id", "y").orderBy("x"), Window.partitionBy("img_id", "x").orderBy("y")
    all_ = F.struct(*channels)  # one window along rows and one along columns, however many channels
    near = _by_image(pixels).withColumns({"_left": F.lag(all_).over(row), "_right": F.lead(all_).over(row)})
    near = near.withColumns({"_up": F.lag(all_).over(col), "_down": F.lead(all_).over(col)})
    out = {}
    for c in channels:
        four = F.col(f"_left.{c}") + F.col(f"_right.{c}") + F.col(f"_up.{c}") + F.col(f"_down.{c}")  # null at the border
        out[c] = F.when(four.isNotNull(), F.least(F.lit(255), F.greatest(F.lit(0), 9 * F.col(c) - four))).otherwise(F.col(c))
    return near.withColumns(out).drop("_left", "_right", "_up", "_down")


def _square(pixels: DataFrame, radius: int) -> DataFrame:
    """img_id, y, x, around: levels within `radius` in both directions, those beyond the border left out.

    One shuffle, by image; then each pixel gathers its row's neighbours, and the rows above and below these.
    """
    row = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(-radius, radius)
    col = Window.partitionBy("img_id", "x").orderBy("y").rowsBetween(-radius, radius)
    near = _by_image(pixels).withColumn("_row", F.collect_list("lum").over(row))
    return near.select("img_id", "y", "x", F.sort_array(F.flatten(F.collect_list("_row").over(col))).alias("around"))


def dilate(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """The greatest level around each pixel, by a horizontal and a vertical pass."""
    row = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(-radius, radius)
    col = Window.partitionBy("img_id", "x").orderBy("y").rowsBetween(-radius, radius)
    return _by_image(pixels).withColumn("lum", F.max("lum").over(row)).withColumn("lum", F.max("lum").over(col))


def erode(pixels: DataFrame, radius: int = 1) -> DataFrame:
    row = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(-radius, radius)
    col = Window.partitionBy("img_id", "x").orderBy("y").rowsBetween(-radius, radius)
    return _by_image(pixels).withColumn("lum", F.min("lum").over(row)).withColumn("lum", F.min("lum").over(col))


def close_kernel(width: int, height: int) -> int:
    """The odd side of the kernel that closes gaps in an image of that size."""
    side = max(5, min(width, height) // 50)
    return side + 1 - side % 2


def close(pixels: DataFrame, radius: int = 1) -> DataFrame:
    return erode(dilate(pixels, radius), radius)


def median_3x3(pixels: DataFrame) -> DataFrame:
    """The middle level of the 3 x 3 around a pixel; at the border, the upper middle of those there are."""
    return _square(pixels, 1).select("img_id", "y", "x", F.expr("element_at(around, cast(size(around) div 2 as int) + 1)").alias("lum"))


def union_edges(pixels: DataFrame, a: str, b: str) -> DataFrame:
    """The elementwise greater of two edge maps."""
    return pixels.withColumn("edge", F.greatest(a, b))


def edge_thresholds(pixels: DataFrame) -> DataFrame:
    """img_id, lower, upper of the adaptive edge detector: a third under and over the mean, clamped."""
    m = mean_intensity(pixels)
    return m.select("img_id", F.greatest(F.lit(0.0), F.lit(0.67) * F.col("mean")).alias("lower"), F.least(F.lit(255.0), F.lit(1.33) * F.col("mean")).alias("upper"))
