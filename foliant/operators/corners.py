"""Corner detection on pictures: edge maps, outer contours and straight segments, in numpy, and one plan over all images.

The sheet in a picture is the best of the quads that its contours simplify to; where no contour gives one, the
outermost level and upright segments do. Kernels give candidates and segments; choosing among them is relational
(operators.detect). Contours are followed pixel by pixel around each connected part of the edges, and segments are
read off the strongest lines of a Hough accumulator; the rules are ours, no parity with an image library is claimed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detect
from .cleanup import ANALYSIS_SIDE, adaptive_edges, blur, canny, gray, low_light, otsu_level, resize, simplify, to_levels
from .pixels import LOW_LIGHT, close_kernel

LEAST_PART, TOLERANCE = 0.08, 0.015  # of the picture, that a contour encloses; of a contour's length
MOST_GAP, MOST_SEGMENTS = 10, 64
AT_ONCE = 256  # pictures whose edges are sent on together
_RING = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))  # clockwise from the east, as (dy, dx)


def _slide(a: np.ndarray, side: int, pick) -> np.ndarray:
    """The least or greatest of a square around each pixel, row-wise and then column-wise; what is outside takes no part.
    Two windows side by side, or overlapping, make the next wider one."""
    fill = 0 if pick is np.maximum else 255
    for axis in (0, 1):
        pad = [(side // 2, side // 2) if k == axis else (0, 0) for k in (0, 1)]
        a, n = np.pad(a, pad, constant_values=fill), 1
        while n < side:
            by = min(n, side - n)
            a, n = pick(a[:-by], a[by:]) if axis == 0 else pick(a[:, :-by], a[:, by:]), n + by
    return a


def dilate(a: np.ndarray, side: int = 3) -> np.ndarray:
    return _slide(a, side, np.maximum)


def close(a: np.ndarray, side: int) -> np.ndarray:
    return _slide(_slide(a, side, np.maximum), side, np.minimum)


def edge_map(rgb: np.ndarray) -> np.ndarray:
    """Edges of the closed threshold, of the picture itself, and of a dark picture brightened, together."""
    g = to_levels(blur(gray(rgb), 0, 5))
    h, w = g.shape
    mean = float(g.mean())
    closed = close(np.where(g > otsu_level(g), 255, 0).astype(np.uint8), close_kernel(w, h))
    edges = canny(closed, max(0.0, 0.66 * mean), min(255.0, 1.33 * mean)) | adaptive_edges(g)
    if is_low_light(rgb):
        edges |= dilate(adaptive_edges(low_light(rgb)).astype(np.uint8)) > 0
    return edges


def is_low_light(rgb: np.ndarray) -> bool:
    """Whether half of the pixels are darker than a fixed level."""
    seen = np.cumsum(np.bincount(gray(rgb).ravel(), minlength=256))
    return int(np.argmax(seen >= seen[-1] // 2)) < LOW_LIGHT


def parts(mask: np.ndarray) -> list[np.ndarray]:
    """The pixels (y, x) of each part that hangs together, corners included: runs of rows, joined."""
    h, w = mask.shape
    ends = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, first = np.nonzero(ends == 1)
    last = np.nonzero(ends == -1)[1] - 1
    up = list(range(len(y)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    starts = np.searchsorted(y, np.arange(h + 1)).tolist()
    a, b = first.tolist(), last.tolist()
    for row in range(1, h):
        i, j = starts[row - 1], starts[row]
        while i < starts[row] and j < starts[row + 1]:
            if a[i] <= b[j] + 1 and a[j] <= b[i] + 1:
                up[root(j)] = root(i)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(up))], int)
    out, order = [], np.argsort(roots, kind="stable")
    for runs in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1) if len(order) else []:
        sizes = last[runs] - first[runs] + 1
        x = np.repeat(first[runs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out.append(np.stack([np.repeat(y[runs], sizes), x], 1))
    return out


def outline(part: np.ndarray) -> np.ndarray:
    """The outer border (x, y) of a part, clockwise, from its uppermost left pixel: Moore's neighbour tracing."""
    y0, x0 = part.min(0) - 1
    inside = np.zeros(part.max(0) - (y0, x0) + 2, bool)
    inside[part[:, 0] - y0, part[:, 1] - x0] = True
    wide, inside = inside.shape[1], inside.tobytes()
    steps = [dy * wide + dx for dy, dx in _RING]
    start = inside.index(1)
    at, came, first, out = start, 5, -1, []  # came: where to look next, the direction back to the last pixel seen outside
    while True:
        for k in range(came, came + 8):
            if inside[at + steps[k % 8]]:
                break
        else:
            return np.array([[start % wide + x0, start // wide + y0]], float)
        d = k % 8
        if at == start and d == first:  # about to leave the start as the first time
            return np.stack([np.array(out) % wide + x0, np.array(out) // wide + y0], 1).astype(float)
        first = first if out else d
        out.append(at)
        at, came = at + steps[d], (d + 6) % 8 if d % 2 == 0 else (d + 5) % 8


def enclosed(ring: np.ndarray) -> float:
    """The area of a closed line, by its signed trapezoids."""
    x, y = ring.T
    return abs(float(x @ np.roll(y, -1) - np.roll(x, -1) @ y)) / 2


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed line, simplified between two of its points that lie far from each other."""
    ring = np.roll(ring, -int(np.hypot(*(ring - ring[0]).T).argmax()), 0)
    half = int(np.hypot(*(ring - ring[0]).T).argmax())
    return np.concatenate([simplify(ring[: half + 1], tolerance)[:-1], simplify(np.concatenate([ring[half:], ring[:1]]), tolerance)[:-1]])


def quads_of(edges: np.ndarray) -> list[np.ndarray]:
    """The four corners of each outer contour that encloses enough and simplifies to four points, in reading order."""
    found, least = [], LEAST_PART * edges.size
    for part in parts(edges):
        if len(part) < 8 or np.prod(np.ptp(part, axis=0) + 1.0) < least:
            continue
        ring = outline(part)
        if len(ring) < 8 or enclosed(ring) < least:
            continue
        corners = simplify_ring(ring, TOLERANCE * float(np.hypot(*(ring - np.roll(ring, 1, 0)).T).sum()))
        if len(corners) == 4:
            found.append(corners)
    return found


def segments_of(edges: np.ndarray) -> np.ndarray:
    """Straight segments x1, y1, x2, y2, strongest lines first: of the lines with enough votes, each local best, the
    runs of edge pixels along it, with gaps of up to MOST_GAP, that are long enough. A pixel is used once."""
    h, w = edges.shape
    least = max(30, min(w, h) // 10)
    votes = max(50, least // 2)
    y, x = np.nonzero(edges)
    if not len(x):
        return np.zeros((0, 4))
    theta = np.radians(np.arange(180))
    reach = int(np.hypot(h, w)) + 1
    rho = np.rint(np.outer(x, np.cos(theta)) + np.outer(y, np.sin(theta))).astype(int) + reach
    grid = np.bincount((rho * 180 + np.arange(180)).ravel(), minlength=(2 * reach + 1) * 180).reshape(-1, 180)
    peaks = np.argwhere(grid >= votes)
    peaks = peaks[grid[peaks[:, 0], peaks[:, 1]] == _around(grid, peaks)]
    peaks = peaks[np.argsort(-grid[peaks[:, 0], peaks[:, 1]], kind="stable")]
    free, out, rho = np.ones(len(x), bool), [], np.ascontiguousarray(rho.T)
    for r, k in peaks.tolist():
        on = np.flatnonzero(free & (np.abs(rho[k] - r) <= 1))
        if len(on) < least // 2:
            continue
        along = y[on] * np.cos(theta[k]) - x[on] * np.sin(theta[k])
        on, along = on[np.argsort(along, kind="stable")], np.sort(along)
        cuts = np.flatnonzero(np.diff(along) > MOST_GAP) + 1
        for run in np.split(np.arange(len(on)), cuts):
            if along[run[-1]] - along[run[0]] >= least:
                a, b = on[run[0]], on[run[-1]]
                out.append((x[a], y[a], x[b], y[b]))
                free[on[run]] = False
        if len(out) >= MOST_SEGMENTS:
            break
    return np.array(out, float).reshape(-1, 4)


def _around(grid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The greatest votes within two steps of each place; angles go round."""
    wide = np.pad(np.concatenate([grid[::-1, -2:], grid, grid[::-1, :2]], 1), ((2, 2), (0, 0)))
    out = wide[at[:, 0], at[:, 1]]
    for dy in range(5):
        for dx in range(5):
            out = np.maximum(out, wide[at[:, 0] + dy, at[:, 1] + dx])
    return out


def find(images: DataFrame) -> DataFrame:
    """img_id, src_w, src_h, quads, lines: what a picture's edges show, in its own pixels. A picture whose bytes aren't
    w * h * 3 shows nothing."""

    def seen(i: int, w: int | None, h: int | None, body: bytes | None) -> dict:
        quads, lines = [], []
        if body is not None and w and h and len(body) == w * h * 3:
            rgb = np.frombuffer(body, np.uint8).reshape(h, w, 3)
            scale = min(1.0, ANALYSIS_SIDE / max(w, h))
            sw, sh = max(1, int(w * scale)), max(1, int(h * scale))
            edges = edge_map(rgb if scale == 1 else np.stack([resize(rgb[..., c], sw, sh) for c in range(3)], -1))
            back = np.array([w / sw, h / sh])
            quads, lines = [(q * back).ravel().tolist() for q in quads_of(edges)], (segments_of(edges) * np.tile(back, 2)).tolist()
        return {"img_id": i, "src_w": w, "src_h": h, "quads": quads, "lines": lines}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                rows = zip(*(batch.column(c).slice(k, AT_ONCE) for c in ("img_id", "w", "h", "body")), strict=True)
                yield pa.RecordBatch.from_pylist([seen(*(v.as_py() for v in r)) for r in rows], schema)

    lists = pa.list_(pa.list_(pa.float64()))
    schema = pa.schema([("img_id", pa.int64()), ("src_w", pa.int32()), ("src_h", pa.int32()), ("quads", lists), ("lines", lists)])
    rows = images.selectExpr("cast(img_id as bigint) img_id", "cast(w as int) w", "cast(h as int) h", "body")
    return rows.mapInArrow(run, "img_id long, src_w int, src_h int, quads array<array<double>>, lines array<array<double>>")


def candidates(found: DataFrame) -> DataFrame:
    """img_id, ord, src_w, src_h, x0 .. y3 of the quads of contours."""
    rows = found.select("img_id", "src_w", "src_h", F.posexplode("quads").alias("ord", "q"))
    return rows.select("img_id", F.col("ord").cast("long").alias("ord"), "src_w", "src_h", *[F.col("q")[2 * k + i].alias(f"{c}{k}") for k in range(4) for i, c in enumerate("xy")])


def locate(images: DataFrame) -> DataFrame:
    """img_id, x0 .. y3: the corners of the sheet in each picture, from the top left on; pictures without one are left out.

    The best contour quad, else the quad of the outermost lines. Pictures are read once, here: what is found in them is
    small, and is kept before the parts of the plan ask for it side by side, as each would read pictures that no other has finished.
    """
    corners = [f"{c}{k}" for k in range(4) for c in "xy"]
    found = find(images).persist()
    found.count()
    best = detect.best_quad(candidates(found)).select("img_id", *corners)
    rest = found.join(best.select("img_id"), "img_id", "left_anti").where("size(lines) >= 4")
    rows = rest.select("img_id", "src_w", "src_h", F.posexplode("lines").alias("ord", "l"))
    rows = rows.select("img_id", "src_w", "src_h", "ord", *[F.col("l")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])
    return best.unionByName(detect.quad_from_lines(rows, F.col("src_w"), F.col("src_h")).select("img_id", *corners))
