"""The output size of a perspective warp. Quads carry corners x0, y0 .. x3, y3 and their image's src_w, src_h."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parse_ratio, round_half_up
from .geometry import large_enough, x, y

# Short over long side of the paper presets.
PRESETS = {"A3": 1 / math.sqrt(2.0), "A4": 1 / math.sqrt(2.0), "A5": 1 / math.sqrt(2.0), "US_LETTER": 8.5 / 11.0, "LEGAL": 8.5 / 14.0}
RATIO_RANGE = (0.01, 100.0)


def distance(i: int, j: int) -> Column:
    return F.sqrt((x(j) - x(i)) * (x(j) - x(i)) + (y(j) - y(i)) * (y(j) - y(i)))


def _measures(quads: DataFrame) -> DataFrame:
    out = quads.withColumns({"_top": distance(0, 1), "_bottom": distance(2, 3), "_left": distance(0, 3), "_right": distance(1, 2)})
    return out.withColumns({
        "_long": F.greatest("_top", "_bottom", "_left", "_right"),
        "_landscape": F.lit(0.5) * (F.col("_top") + F.col("_bottom")) >= F.lit(0.5) * (F.col("_left") + F.col("_right")),
    })


def _heuristic() -> tuple[Column, Column]:
    """From the longer of each pair of opposite edges."""
    side = lambda a, b: F.greatest(F.lit(1), round_half_up(F.greatest(a, b)) + 1)
    return side("_top", "_bottom"), side("_left", "_right")


def _anchored(wide: Column, high: Column) -> tuple[Column, Column]:
    """The longest edge is kept; wide and high are the other side if the quad is landscape, or portrait."""
    long = round_half_up(F.col("_long"))
    w = F.when(F.col("_landscape"), long).otherwise(round_half_up(high))
    h = F.when(F.col("_landscape"), round_half_up(wide)).otherwise(long)
    return F.greatest(F.lit(1), w) + 1, F.greatest(F.lit(1), h) + 1


def _det(a, b, c, d, e, f) -> Column:
    """Of rows (a, b, 1), (c, d, 1), (e, f, 1)."""
    return a * (d - f) - b * (c - e) + (c * f - d * e)


def projective_ratio(quads: DataFrame) -> DataFrame:
    """ratio: width over height of the rectangle that the quad is a perspective image of (Zhang and He, 2006), or null.

    The focal length follows from the quad; where it doesn't, it is taken as the image's longer side.
    """
    half_w, half_h = F.col("src_w") * F.lit(0.5), F.col("src_h") * F.lit(0.5)
    out = quads.withColumns({f"_p{k}": x(k) - half_w for k in range(4)} | {f"_q{k}": y(k) - half_h for k in range(4)})
    p, q = [F.col(f"_p{k}") for k in range(4)], [F.col(f"_q{k}") for k in range(4)]
    out = out.withColumns({
        "_d2": _det(p[1], q[1], p[3], q[3], p[2], q[2]), "_d3": _det(p[3], q[3], p[1], q[1], p[2], q[2]),
        "_n2": _det(p[0], q[0], p[3], q[3], p[2], q[2]), "_n3": _det(p[0], q[0], p[1], q[1], p[2], q[2]),
    })
    good = (F.abs("_d2") >= 1e-9) & (F.abs("_d3") >= 1e-9)
    out = out.withColumns({"_k2": F.when(good, F.col("_n2") / F.col("_d2")), "_k3": F.when(good, F.col("_n3") / F.col("_d3"))})
    k2, k3 = F.col("_k2"), F.col("_k3")
    out = out.withColumns({"_ax": k2 * p[1] - p[0], "_ay": k2 * q[1] - q[0], "_az": k2 - 1, "_bx": k3 * p[3] - p[0], "_by": k3 * q[3] - q[0], "_bz": k3 - 1})
    ax, ay, az, bx, by, bz = (F.col(c) for c in ("_ax", "_ay", "_az", "_bx", "_by", "_bz"))
    flat = (F.abs(az) < 1e-6) | (F.abs(bz) < 1e-6)
    out = out.withColumn("_f", F.when(~flat, -(ax * bx + ay * by) / (az * bz)))
    side = F.greatest("src_w", "src_h").cast("double")
    out = out.withColumn("_f", F.when(flat | k2.isNull(), None).when((F.col("_f") > 0) & (F.col("_f") < float("inf")), F.col("_f")).otherwise(side * side))
    out = out.withColumns({"_num": ax * ax + ay * ay + az * az * F.col("_f"), "_den": bx * bx + by * by + bz * bz * F.col("_f")})
    square = F.when(F.col("_den") >= 1e-12, F.col("_num") / F.col("_den"))
    ratio = F.when((square > 0) & (square < float("inf")), F.sqrt(square))
    gone = [f"_{c}{k}" for c in "pq" for k in range(4)] + ["_d2", "_d3", "_n2", "_n3", "_k2", "_k3", "_ax", "_ay", "_az", "_bx", "_by", "_bz", "_f", "_num", "_den"]
    return out.withColumn("ratio", ratio).drop(*gone)


def _sized(out: DataFrame, w: Column, h: Column) -> DataFrame:
    return out.withColumns({"out_w": w.cast("int"), "out_h": h.cast("int")}).drop("_top", "_bottom", "_left", "_right", "_long", "_landscape")


def heuristic_size(quads: DataFrame) -> DataFrame:
    return _sized(_measures(quads), *_heuristic())


def _fixed(ratio: Column) -> tuple[Column, Column]:
    w, h = _anchored(F.col("_long") * ratio, F.col("_long") * ratio)
    good = F.coalesce((ratio > 0) & (ratio <= 1), F.lit(False)) & (F.col("_long") >= 1)
    return F.when(good, w).otherwise(1), F.when(good, h).otherwise(1)


def fixed_size(quads: DataFrame, short_over_long: float) -> DataFrame:
    """The longest edge with a ratio of sides; 1 x 1 for a ratio that isn't in (0, 1]."""
    return _sized(_measures(quads), *_fixed(F.lit(float(short_over_long))))


def _projective() -> tuple[Column, Column]:
    ratio, long = F.col("ratio"), F.col("_long")
    w, h = _anchored(long / ratio, long * ratio)
    old_w, old_h = _heuristic()
    good = F.coalesce(ratio.between(*RATIO_RANGE), F.lit(False))
    return F.when(long < 1, 1).when(good, w).otherwise(old_w), F.when(long < 1, 1).when(good, h).otherwise(old_h)


def projective_size(quads: DataFrame) -> DataFrame:
    return _sized(_measures(projective_ratio(quads)), *_projective()).drop("ratio")


def size_by_choice(quads: DataFrame, choice: str = "choice", custom: str = "custom") -> DataFrame:
    """Sizes by each row's choice: AUTO by projection, ORIGINAL by edges, CUSTOM by a text, else a preset."""
    ratio = F.when(F.col(choice) == "CUSTOM", parse_ratio(F.col(custom)).cast("float").cast("double"))
    for name, value in PRESETS.items():
        ratio = ratio.when(F.col(choice) == name, value)
    fw, fh = _fixed(ratio)
    (pw, ph), (hw, hh) = _projective(), _heuristic()
    pick = lambda auto, original, fixed: F.when(F.col(choice) == "AUTO", auto).when(F.col(choice) == "ORIGINAL", original).otherwise(fixed)
    return _sized(_measures(projective_ratio(quads)), pick(pw, hw, fw), pick(ph, hh, fh)).drop("ratio")


OUTSIDE, INSET = (-0.05, 1.05), 0.02  # how far corners go beyond their image, and where they start from


def to_unit(quads: DataFrame, left: float, top: float, width: float, height: float) -> DataFrame:
    """Corners on a view, where the image fills a rectangle, as parts of the image, held a little outside of it."""
    part = lambda c, low, size: F.least(F.greatest((F.col(c) - low) / size, F.lit(OUTSIDE[0])), F.lit(OUTSIDE[1]))
    return quads.withColumns({f"{c}{k}": part(f"{c}{k}", *((left, width) if c == "x" else (top, height))) for c in "xy" for k in range(4)})


def to_pixels(quads: DataFrame, w: str = "src_w", h: str = "src_h") -> DataFrame:
    """Corners as parts of their image in its pixels."""
    return quads.withColumns({f"{c}{k}": F.col(f"{c}{k}") * F.col(w if c == "x" else h) for c in "xy" for k in range(4)})


def turned_in_crop(quads: DataFrame, w: str = "src_w", h: str = "src_h") -> DataFrame:
    """After a turn by 90 degrees within the crop: the image's sides change places and the corners start anew."""
    xs, ys = (INSET, 1 - INSET, 1 - INSET, INSET), (INSET, INSET, 1 - INSET, 1 - INSET)
    return quads.withColumns({w: F.col(h), h: F.col(w)} | {f"x{k}": F.lit(xs[k]) for k in range(4)} | {f"y{k}": F.lit(ys[k]) for k in range(4)})


def apply_crop(quads: DataFrame, choice: str = "choice", custom: str = "custom") -> DataFrame:
    """Crops that are made: quads (in pixels) that cover enough of their image, with their output sizes."""
    return size_by_choice(quads.where(large_enough("src_w", "src_h")), choice, custom)
