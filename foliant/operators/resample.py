"""Sizes and positions under resampling. Sizes follow 32-bit float arithmetic and truncate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_max(rows: DataFrame, most: int, w="w", h="h") -> DataFrame:
    """fit_w, fit_h: the longer side at most `most`; no floor at 1."""
    longest = F.greatest(w, h)
    scale = F.lit(float(most)).cast("float") / longest.cast("float")
    side = lambda c: F.when(longest <= most, F.col(c)).otherwise((F.col(c).cast("float") * scale.cast("float")).cast("float").cast("int"))
    return rows.withColumns({"fit_w": side(w), "fit_h": side(h)})


def fit_box(rows: DataFrame, most_w: Column, most_h: Column, w="w", h="h") -> DataFrame:
    """box_w, box_h: within a box, never larger than before, at least 1."""
    inside = (F.col(w) <= most_w) & (F.col(h) <= most_h)
    ratio = F.least((most_w.cast("float") / F.col(w).cast("float")).cast("float"), (most_h.cast("float") / F.col(h).cast("float")).cast("float"))
    side = lambda c: F.when(inside, F.col(c)).otherwise(F.greatest(F.lit(1), (F.col(c).cast("float") * ratio).cast("float").cast("int")))
    return rows.withColumns({"box_w": side(w), "box_h": side(h)})


def sample_factor(rows: DataFrame, most: int, w="w", h="h") -> DataFrame:
    """sample: the power of two that brings both sides, divided in integers, to `most`; null for sizes not over 0."""
    longest = F.greatest(w, h)
    powers = F.array(*[F.lit(1 << k) for k in range(31)])
    first = F.element_at(F.filter(powers, lambda s: F.floor(longest / s) <= most), 1)
    return rows.withColumn("sample", F.when((F.col(w) > 0) & (F.col(h) > 0), first).cast("int"))


def rotate(pixels: DataFrame, degrees: int, w: int, h: int) -> DataFrame:
    """Pixels turned clockwise by a multiple of 90 degrees, in an image of w x h."""
    turns = degrees // 90 % 4
    if not turns:
        return pixels
    x, y = F.col("x"), F.col("y")
    to = {1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[turns]
    return pixels.withColumns({"x": to[0].cast("int"), "y": to[1].cast("int")})


def crop(pixels: DataFrame, left: int, top: int, right: int, bottom: int, w: int, h: int) -> DataFrame:
    """Pixels within a rectangle, from its corner; the rectangle is cut to the image, and one without area changes nothing."""
    x0, y0 = min(max(left, 0), w - 1), min(max(top, 0), h - 1)
    cw, ch = min(right - left, w - x0), min(bottom - top, h - y0)
    if cw <= 0 or ch <= 0:
        return pixels
    inside = F.col("x").between(x0, x0 + cw - 1) & F.col("y").between(y0, y0 + ch - 1)
    return pixels.where(inside).withColumns({"x": (F.col("x") - x0).cast("int"), "y": (F.col("y") - y0).cast("int")})


def bounding_rect(quads: DataFrame) -> DataFrame:
    """left, top, right, bottom of a quad in its image, truncated, at least one pixel wide and high."""
    xs, ys = [f"x{k}" for k in range(4)], [f"y{k}" for k in range(4)]
    cut = lambda v, low, high: F.least(F.greatest(v.cast("int"), low), high)
    w, h = F.col("src_w"), F.col("src_h")
    out = quads.withColumns({"left": cut(F.least(*xs), F.lit(0), w - 1), "top": cut(F.least(*ys), F.lit(0), h - 1)})
    return out.withColumns({"right": cut(F.greatest(F.lit(0.0), *xs), F.col("left") + 1, w), "bottom": cut(F.greatest(F.lit(0.0), *ys), F.col("top") + 1, h)})


def letterbox(rows: DataFrame, box_w: int, box_h: int, w="w", h="h") -> DataFrame:
    """left, top, right, bottom of an image centred in a box, in doubles."""
    s = F.least(F.lit(float(box_w)) / F.col(w), F.lit(float(box_h)) / F.col(h))
    iw, ih = F.col(w) * s, F.col(h) * s
    return rows.withColumns({"left": (box_w - iw) / 2, "top": (box_h - ih) / 2, "right": (box_w + iw) / 2, "bottom": (box_h + ih) / 2})


def pdf_render_size(rows: DataFrame, w="w", h="h", longest: int = 2200) -> DataFrame:
    """render_w, render_h in pixels of a page of w x h points, scaled by 0.1 to 8."""
    scale = F.least(F.lit(8.0), F.greatest(F.lit(0.1), F.lit(float(longest)) / F.greatest(w, h)))
    return rows.withColumns({"render_w": F.greatest(F.lit(1), (F.col(w) * scale).cast("int")), "render_h": F.greatest(F.lit(1), (F.col(h) * scale).cast("int"))})


def min_text_size(rows: DataFrame, longest: int = 1800, most: float = 2.0, w="w", h="h") -> DataFrame:
    """text_w, text_h: enlarged to a longer side of `longest`, by `most` times at most; large images stay."""
    side = F.greatest(w, h)
    scale = F.least(F.lit(most), F.lit(float(longest)) / side)
    to = lambda c: F.when(side >= longest, F.col(c)).otherwise(F.greatest(F.lit(1), (F.col(c) * scale).cast("int")))
    return rows.withColumns({"text_w": to(w), "text_h": to(h)})


def homography(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> list[float] | None:
    """Nine numbers that take four points to four others, or None if none do."""
    import numpy as np

    rows, out = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        out += [u, v]
    try:
        return [*np.linalg.solve(np.array(rows, float), np.array(out, float)).tolist(), 1.0]
    except np.linalg.LinAlgError:
        return None


def warp_nearest(pixels: DataFrame, quad: list[tuple[float, float]], out_w: int, out_h: int) -> DataFrame:
    """Each output pixel takes the nearest source pixel under the inverse map; white where there is none.

    An equi-join on pixel coordinates: output cells are generated for each image, on the executors.
    """
    back = homography([(0, 0), (out_w, 0), (out_w, out_h), (0, out_h)], quad)
    if back is None:  # no map takes such corners to a rectangle: what they bound is cut out as it is
        xs, ys = [p[0] for p in quad], [p[1] for p in quad]
        left, top = max(int(min(xs)), 0), max(int(min(ys)), 0)
        right, bottom = max(int(max(xs)), left + 1), max(int(max(ys)), top + 1)
        inside = F.col("x").between(left, right - 1) & F.col("y").between(top, bottom - 1)
        return pixels.where(inside).select("img_id", (F.col("y") - top).cast("int").alias("y"), (F.col("x") - left).cast("int").alias("x"), "lum")
    a, b, c, d, e, f, g, h, i = (F.lit(v) for v in back)
    cells = pixels.select("img_id").distinct()
    cells = cells.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(out_h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(out_w - 1))))
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    z = g * cx + h * cy + i
    cells = cells.withColumns({"_x": F.floor((a * cx + b * cy + c) / z).cast("int"), "_y": F.floor((d * cx + e * cy + f) / z).cast("int")})
    source = pixels.select("img_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "lum")
    return cells.join(source, ["img_id", "_x", "_y"], "left").select("img_id", "y", "x", F.coalesce("lum", F.lit(255)).alias("lum"))
