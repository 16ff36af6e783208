"""Colour algebra: 4 x 5 affine matrices folded before the plan is built, applied in one projection.

A chain of matrices is one matrix, so a filter with its adjustments is one expression for each channel and one
clamp; an identity leaves the pixels as they are. Channels are rounded as floor(v + 0.5) within 0..255.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Matrix = tuple[tuple[float, float, float, float], ...]  # three rows of r, g, b and offset; alpha is left alone

IDENTITY: Matrix = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0))
# The platform's luma weights for saturation.
LUMA = (0.213, 0.715, 0.072)

# The catalogue of filters, each as the steps of its recipe.
RECIPES: dict[str, list[tuple]] = {
    "original": [],
    "magic": [("saturation", 1.22), ("contrast", 1.12), ("offset", 4)],
    "gray": [("saturation", 0)],
    "sepia": [("matrix", ((0.393, 0.769, 0.189, 0), (0.349, 0.686, 0.168, 0), (0.272, 0.534, 0.131, 0)))],
    "polaroid": [("saturation", 0.82), ("contrast", 0.94), ("offset", 14)],
    "vintage": [("saturation", 0.65), ("matrix", ((1.05, 0.06, 0, 6), (0, 0.95, 0, 0), (0, 0, 0.8, 0))), ("contrast", 0.9), ("offset", 10)],
    "soft": [("saturation", 1.05), ("contrast", 0.82), ("offset", 12)],
    "warm": [("matrix", ((1.15, 0, 0, 10), (0, 1.05, 0, 0), (0, 0, 0.88, 0)))],
    "cool": [("matrix", ((0.88, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.15, 12)))],
    "ocean": [("saturation", 0.85), ("matrix", ((0.85, 0.15, 0, 0), (0.05, 0.95, 0, 4), (0.1, 0.25, 0.95, 10)))],
    "rose": [("saturation", 1.05), ("matrix", ((1.12, 0.12, 0, 6), (0.04, 0.92, 0.1, 0), (0.05, 0.12, 0.85, 0)))],
    "blue": [("saturation", 0), ("matrix", ((0.15, 0.15, 0.15, 0), (0.45, 0.45, 0.45, 0), (0.95, 0.95, 0.95, 12)))],
    "invert": [("matrix", ((-1, 0, 0, 255), (0, -1, 0, 255), (0, 0, -1, 255)))],
    "vivid": [("saturation", 1.6)],
    "faded": [("saturation", 0.65), ("contrast", 0.92), ("offset", 18)],
    "crisp": [("saturation", 1.12), ("contrast", 1.28)],
    "night": [("saturation", 0.9), ("contrast", 1.15), ("offset", -34)],
}
#: Filters that are no matrix: thresholding, the sharpening kernel, and the three cleanup presets.
SPECIAL = ("bw", "sharpen", "natural", "enhanced", "cleantext")
BRIGHTNESS_STEP = 25.0


def saturation(s: float) -> Matrix:
    return tuple(tuple((1 - s) * LUMA[j] + (s if i == j else 0) for j in range(3)) + (0,) for i in range(3))


def contrast(k: float) -> Matrix:
    return tuple(tuple(k if i == j else 0 for j in range(3)) + (127.5 * (1 - k),) for i in range(3))


def offset(t: float) -> Matrix:
    return tuple(tuple(1 if i == j else 0 for j in range(3)) + (t,) for i in range(3))


def compose(after: Matrix, before: Matrix) -> Matrix:
    """The matrix that applies `before`, then `after`."""
    return tuple(tuple(sum(row[k] * before[k][j] for k in range(3)) + (row[3] if j == 3 else 0) for j in range(4)) for row in after)


_STEPS = {"saturation": saturation, "contrast": contrast, "offset": offset, "matrix": lambda m: m}


def fold(filter_id: str, brightness: float = 0.0, contrast_by: float = 1.0) -> Matrix:
    """One matrix for a filter and its adjustments. An unknown filter is the identity, as is `original`."""
    out = IDENTITY
    for kind, value in RECIPES.get(filter_id, []):
        out = compose(_STEPS[kind](value), out)
    if contrast_by != 1:
        out = compose(contrast(contrast_by), out)
    if brightness != 0:
        out = compose(offset(BRIGHTNESS_STEP * brightness), out)
    return out


def clamp(v):
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(v + 0.5))).cast("int")


def apply_matrix(pixels: DataFrame, m: Matrix) -> DataFrame:
    """r, g, b replaced by the clamped products; the identity returns the same DataFrame."""
    if m == IDENTITY:
        return pixels
    row = lambda k: m[k][0] * F.col("r") + m[k][1] * F.col("g") + m[k][2] * F.col("b") + F.lit(float(m[k][3]))
    return pixels.withColumns({c: clamp(row(k)) for k, c in enumerate("rgb")})


def luminance(r="r", g="g", b="b"):
    """Integer luma of 0..255 channels."""
    return F.expr(f"(299 * {r} + 587 * {g} + 114 * {b} + 500) div 1000").cast("int")


def grayscale(pixels: DataFrame) -> DataFrame:
    """All channels at the pixel's luma, with the weights of video."""
    v = clamp(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    return pixels.select("img_id", "y", "x", *[v.alias(c) for c in "rgb"])


def for_jpg(pixels: DataFrame, in_color: bool) -> DataFrame:
    """Pages as they go into JPGs: thresholded, after their own filter, unless they are to keep their colours."""
    return pixels if in_color else apply_filter(pixels, "bw")


def apply_filter(pixels: DataFrame, filter_id: str, brightness: float = 0.0, contrast_by: float = 1.0) -> DataFrame:
    """Pixels (img_id, y, x, r, g, b) under a filter. `bw` adjusts in gray and then thresholds; `sharpen` sharpens and
    then adjusts. The cleanup presets ignore adjustments and work on whole images, in operators.cleanup."""
    from . import pixels as px

    if filter_id == "bw":
        gray = apply_matrix(pixels, fold("gray", brightness, contrast_by))
        black = px.binarize(gray.withColumn("lum", luminance()))
        return black.select("img_id", "y", "x", *[F.col("bit").alias(c) for c in "rgb"])
    if filter_id == "sharpen":
        sharp = px.sharpen(pixels, ("r", "g", "b"))
        return apply_matrix(sharp, fold("original", brightness, contrast_by))
    if filter_id in SPECIAL:
        raise ValueError(f"{filter_id} works on whole images: see operators.cleanup")
    return apply_matrix(pixels, fold(filter_id, brightness, contrast_by))
