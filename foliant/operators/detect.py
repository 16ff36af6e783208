"""Corner detection, the relational half: ordering and scoring of candidate quads, and a quad from line segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import computed
from . import geometry
from .geometry import x, y

LEAST_AREA, LEAST_LINES_AREA = 0.08, 0.05
ASPECT = (0.5, 2.5)
AREA_WEIGHT, RECT_WEIGHT, RECT_BEST = 0.6, 0.4, 120.0
RIGHT_RANGE, ANY_RANGE = (60.0, 120.0), (28.0, 152.0)


def order_corners(quads: DataFrame) -> DataFrame:
    """Corners by their angle around the centre, from the one of the least x + y; of equal sums the first by angle.

    Angles are rounded to 9 decimals, so that engines agree on their order; equal ones keep the given order.
    """
    cx, cy = (x(0) + x(1) + x(2) + x(3)) / 4, (y(0) + y(1) + y(2) + y(3)) / 4
    corner = lambda k: F.struct(F.round(F.atan2(y(k) - cy, x(k) - cx), 9).alias("a"), F.lit(k).alias("k"), x(k).alias("x"), y(k).alias("y"))
    ring = F.array_sort(F.array(*[corner(k) for k in range(4)]))
    out = quads.withColumn("_ring", ring)
    sums = F.transform("_ring", lambda p, i: F.struct((p.x + p.y).alias("s"), i.alias("i")))
    out = out.withColumn("_start", F.array_min(sums).i)
    at = lambda k, c: F.element_at("_ring", ((F.col("_start") + k) % 4 + 1).cast("int")).getField(c)
    return out.withColumns({f"{c}{k}": at(k, c) for k in range(4) for c in "xy"}).drop("_ring", "_start")


def vertex_angle(k: int) -> Column:
    """Degrees at corner k between its edges, rounded to 9 decimals."""
    ax, ay, bx, by = x(k + 3) - x(k), y(k + 3) - y(k), x(k + 1) - x(k), y(k + 1) - y(k)
    cosine = (ax * bx + ay * by) / (F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by) + 1e-9)
    return F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))), 9)


def _angles_within(low: float, high: float) -> Column:
    return F.forall(F.array(*[vertex_angle(k) for k in range(4)]), lambda a: a.between(low, high) & ~F.isnan(a))


def rect_score() -> Column:
    """0 to 120: how near the angles are to right ones; -1 if one is off by more than 30 degrees."""
    total = F.lit(0.0)
    for k in range(4):
        total = total + F.greatest(F.lit(0.0), F.lit(30.0) - F.abs(vertex_angle(k) - 90.0))
    return F.when(_angles_within(*RIGHT_RANGE), F.round(total, 6)).otherwise(-1.0)


def has_bad_angle() -> Column:
    return ~_angles_within(*ANY_RANGE)


def area() -> Column:
    total = F.lit(0.0)
    for k in range(4):
        total = total + (x(k) * y(k + 1) - x(k + 1) * y(k))
    return F.abs(total) / 2


def best_quad(candidates: DataFrame, group: str = "img_id", order: str = "ord") -> DataFrame:
    """The convex candidate of each image with the best score of area and angles; of equal ones the first.

    Cheap tests come first; max_by needs no sort.
    """
    image = F.col("src_w") * F.col("src_h").cast("double")
    out = candidates.withColumn("area", area()).where(F.col("area") >= image * LEAST_AREA).where(geometry.is_convex())
    out = computed(computed(order_corners(out)).withColumn("rect", rect_score())).where("rect >= 0")
    length = lambda a, b: F.sqrt((x(a) - x(b)) * (x(a) - x(b)) + (y(a) - y(b)) * (y(a) - y(b)))
    aspect = ((length(1, 2) + length(3, 0)) / 2) / ((length(0, 1) + length(2, 3)) / 2 + 1e-9)
    out = out.where((aspect > ASPECT[0]) & (aspect < ASPECT[1]))
    out = out.withColumn("score", F.round(AREA_WEIGHT * F.col("area") / image + RECT_WEIGHT * F.col("rect") / RECT_BEST, 9))
    kept = F.struct(order, "score", *[f"{c}{k}" for k in range(4) for c in "xy"])
    return out.groupBy(group).agg(F.max_by(kept, F.struct("score", -F.col(order))).alias("b")).select(group, "b.*")


def line_angle() -> Column:
    """Degrees of a segment's line within 0..180, rounded to 9 decimals."""
    return F.round(F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(180.0)), 9)


def intersection(a: Column, b: Column) -> Column:
    """struct(x, y) where two lines meet, or null for (nearly) parallel ones."""
    den = (a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2)
    t = ((a.x1 - b.x1) * (b.y1 - b.y2) - (a.y1 - b.y1) * (b.x1 - b.x2)) / den
    return F.when(F.abs(den) >= 1e-10, F.struct((a.x1 + t * (a.x2 - a.x1)).alias("x"), (a.y1 + t * (a.y2 - a.y1)).alias("y")))


def quad_from_lines(segments: DataFrame, w, h) -> DataFrame:
    """w, h: of all images, or columns of the segments. img_id and corners where the outermost two level and two upright lines of an image meet.

    Images with fewer lines, parallel ones, a small quad or a bad angle give none. One aggregation by image.
    """
    angle = line_angle()
    kind = F.when((angle < 30) | (angle > 150), "level").when((angle > 60) & (angle < 120), "upright")
    line = F.struct("x1", "y1", "x2", "y2")
    mid_y, mid_x = (F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (w, h))
    s = segments.withColumns({"_w": w.cast("double"), "_h": h.cast("double")}).withColumn("kind", kind).withColumn("at", F.when(F.col("kind") == "level", mid_y).otherwise(mid_x))
    first, last = F.struct("at", "ord"), F.struct("at", "ord")
    of = lambda k, f, o: f(F.when(F.col("kind") == k, line), F.when(F.col("kind") == k, o))
    g = s.groupBy("img_id").agg(
        of("level", F.min_by, first).alias("t"), of("level", F.max_by, last).alias("b"), of("upright", F.min_by, first).alias("l"), of("upright", F.max_by, last).alias("r"),
        F.count(F.when(F.col("kind") == "level", 1)).alias("n_level"), F.count(F.when(F.col("kind") == "upright", 1)).alias("n_upright"), F.first("_w").alias("_w"), F.first("_h").alias("_h"),
    )
    g = g.where("n_level >= 2 AND n_upright >= 2")
    for k, (a, b) in enumerate((("t", "l"), ("t", "r"), ("b", "r"), ("b", "l"))):
        g = g.withColumn(f"c{k}", intersection(F.col(a), F.col(b)))
    g = g.where("c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL AND c3 IS NOT NULL")
    g = computed(g)
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    g = g.select("img_id", "_w", "_h", *[inside(F.col(f"c{k}").x, F.col("_w")).alias(f"x{k}") for k in range(4)], *[inside(F.col(f"c{k}").y, F.col("_h")).alias(f"y{k}") for k in range(4)])
    g = computed(order_corners(g)).where(area() >= F.lit(LEAST_LINES_AREA) * F.col("_w") * F.col("_h"))
    return g.where(~has_bad_angle()).drop("_w", "_h")


