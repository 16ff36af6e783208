"""Crop quadrilaterals: corners 0..3 are top left, top right, bottom right, bottom left; edge k goes from corner k to k + 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_RADIUS, EDGE_ENDS, CORNER_RADIUS = 24.0, 0.15, 70.0
SNAP_ENTER, SNAP_EXIT = 1.5, 3.0
LEAST_AREA = 0.02


def x(k: int) -> Column:
    return F.col(f"x{k % 4}")


def y(k: int) -> Column:
    return F.col(f"y{k % 4}")


def signed_area(xs=None, ys=None) -> Column:
    xs, ys = xs or [x(k) for k in range(4)], ys or [y(k) for k in range(4)]
    total = F.lit(0.0)
    for k in range(4):
        j = (k + 1) % 4
        total = total + (xs[k] * ys[j] - xs[j] * ys[k])
    return F.lit(0.5) * total


def crosses(xs=None, ys=None) -> list[Column]:
    """Cross product of each edge and the next."""
    xs, ys = xs or [x(k) for k in range(4)], ys or [y(k) for k in range(4)]
    out = []
    for k in range(4):
        j, m = (k + 1) % 4, (k + 2) % 4
        out.append((xs[j] - xs[k]) * (ys[m] - ys[j]) - (ys[j] - ys[k]) * (xs[m] - xs[j]))
    return out


def _all(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def is_convex(xs=None, ys=None) -> Column:
    c = crosses(xs, ys)
    return _all([v > 0 for v in c]) | _all([v < 0 for v in c])


def is_valid(xs=None, ys=None) -> Column:
    """Convex, with no edge under one pixel."""
    px, py = xs or [x(k) for k in range(4)], ys or [y(k) for k in range(4)]
    long = [(px[(k + 1) % 4] - px[k]) * (px[(k + 1) % 4] - px[k]) + (py[(k + 1) % 4] - py[k]) * (py[(k + 1) % 4] - py[k]) >= 1 for k in range(4)]
    return _all(long) & is_convex(xs, ys)


def large_enough(w, h) -> Column:
    """Whether a crop covers enough of its w x h image to be made."""
    return F.abs(signed_area()) / (F.col(w) * F.col(h)) >= LEAST_AREA


def project(px: Column, py: Column, k: int) -> tuple[Column, Column]:
    """Where a point projects onto edge k (0..1), and how far it is from there."""
    dx, dy = x(k + 1) - x(k), y(k + 1) - y(k)
    size = dx * dx + dy * dy
    t = F.when(size <= 1e-6, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x(k)) * dx + (py - y(k)) * dy) / size)))
    qx, qy = px - (x(k) + t * dx), py - (y(k) + t * dy)
    return t, F.sqrt(qx * qx + qy * qy)


def _nearest(distances: list[Column], limit: float) -> Column:
    """The lowest index of the smallest distance under a limit, or -1. A null distance is no candidate."""
    best = F.least(*distances)
    hit = F.when(F.lit(False), -1)
    for k, d in enumerate(distances):
        hit = hit.when((d == best) & (d < limit), k)
    return hit.otherwise(-1)


def edge_hit(px: Column, py: Column) -> Column:
    """The edge that a touch is on: near it and not near its ends."""
    found = []
    for k in range(4):
        t, d = project(px, py, k)
        found.append(F.when((t > EDGE_ENDS) & (t < 1 - EDGE_ENDS), d))
    return _nearest([F.coalesce(d, F.lit(1e300)) for d in found], EDGE_RADIUS)


def corner_hit(px: Column, py: Column) -> Column:
    return _nearest([F.sqrt((px - x(k)) * (px - x(k)) + (py - y(k)) * (py - y(k))) for k in range(4)], CORNER_RADIUS)


def outward_normal(k: int) -> tuple[Column, Column]:
    """The unit normal of edge k that points away from the opposite edge; (0, 0) for an edge without length."""
    ex, ey = x(k + 1) - x(k), y(k + 1) - y(k)
    size = F.sqrt(ex * ex + ey * ey)
    nx, ny = -ey / size, ex / size
    ox = F.lit(0.5) * (x(k) + x(k + 1)) - F.lit(0.5) * (x(k + 2) + x(k + 3))
    oy = F.lit(0.5) * (y(k) + y(k + 1)) - F.lit(0.5) * (y(k + 2) + y(k + 3))
    sign = F.when(nx * ox + ny * oy >= 0, 1.0).otherwise(-1.0)
    return F.when(size < 1e-6, 0.0).otherwise(sign * nx), F.when(size < 1e-6, 0.0).otherwise(sign * ny)


def translate_edge(quads: DataFrame, k: int, px: Column, py: Column) -> DataFrame:
    """The quad with edge k moved along its normal to where the pointer is; as before, and applied false, if that
    makes it invalid or turns it over."""
    nx, ny = outward_normal(k)
    j = (k + 1) % 4
    out = quads.withColumns({"_nx": nx, "_ny": ny, "_mx": (x(k) + x(j)) / 2, "_my": (y(k) + y(j)) / 2})
    out = out.withColumn("_d", (px - F.col("_mx")) * F.col("_nx") + (py - F.col("_my")) * F.col("_ny"))
    xs = [x(i) + (F.col("_d") * F.col("_nx") if i in (k, j) else 0.0) for i in range(4)]
    ys = [y(i) + (F.col("_d") * F.col("_ny") if i in (k, j) else 0.0) for i in range(4)]
    out = out.withColumns({f"_x{i}": xs[i] for i in range(4)} | {f"_y{i}": ys[i] for i in range(4)})
    new_x, new_y = [F.col(f"_x{i}") for i in range(4)], [F.col(f"_y{i}") for i in range(4)]
    out = out.withColumn("applied", is_valid(new_x, new_y) & (signed_area(new_x, new_y) * signed_area() > 0))
    out = out.withColumns({f"{c}{i}": F.when(F.col("applied"), F.col(f"_{c}{i}")).otherwise(F.col(f"{c}{i}")) for c in "xy" for i in range(4)})
    return out.drop("_nx", "_ny", "_mx", "_my", "_d", *[f"_{c}{i}" for c in "xy" for i in range(4)])


def axis_delta(fx: Column, fy: Column, mx: Column, my: Column) -> Column:
    """Degrees between the line of two points and the nearer axis; null where they coincide."""
    dx, dy = F.abs(mx - fx), F.abs(my - fy)
    angle = F.degrees(F.atan2(dy, dx))
    return F.when((dx == 0) & (dy == 0), None).otherwise(F.least(angle, F.lit(90.0) - angle))


def nearer_horizontal(fx: Column, fy: Column, mx: Column, my: Column) -> Column:
    return F.abs(mx - fx) >= F.abs(my - fy)


def snap_flags(moves: DataFrame, fx: float, fy: float) -> DataFrame:
    """snapped for each move of a gesture: on from 1.5 degrees, off over 3, and between them as it was.

    Between the limits the last decisive move holds, so a carry-forward window replaces a loop.
    """
    from pyspark.sql import Window

    delta = F.round(axis_delta(F.lit(fx), F.lit(fy), F.col("x"), F.col("y")), 9)
    decisive = F.when(delta.isNull() | (delta > SNAP_EXIT), False).when(delta <= SNAP_ENTER, True)
    upto = Window.partitionBy("gesture_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("snapped", F.coalesce(F.last(decisive, ignorenulls=True).over(upto), F.lit(False)))
