"""The queries in DuckDB's SQL, written apart from the operators: each from the tables as they are."""

from __future__ import annotations

import math

# The catalogue of filters, stated here for a second time, so that a slip in the operators shows.
RECIPES = {
    "original": [],
    "magic": [("saturation", 1.22), ("contrast", 1.12), ("offset", 4)],
    "gray": [("saturation", 0)],
    "sepia": [("rows", [[0.393, 0.769, 0.189, 0], [0.349, 0.686, 0.168, 0], [0.272, 0.534, 0.131, 0]])],
    "polaroid": [("saturation", 0.82), ("contrast", 0.94), ("offset", 14)],
    "vintage": [("saturation", 0.65), ("rows", [[1.05, 0.06, 0, 6], [0, 0.95, 0, 0], [0, 0, 0.8, 0]]), ("contrast", 0.9), ("offset", 10)],
    "soft": [("saturation", 1.05), ("contrast", 0.82), ("offset", 12)],
    "warm": [("rows", [[1.15, 0, 0, 10], [0, 1.05, 0, 0], [0, 0, 0.88, 0]])],
    "cool": [("rows", [[0.88, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1.15, 12]])],
    "ocean": [("saturation", 0.85), ("rows", [[0.85, 0.15, 0, 0], [0.05, 0.95, 0, 4], [0.1, 0.25, 0.95, 10]])],
    "rose": [("saturation", 1.05), ("rows", [[1.12, 0.12, 0, 6], [0.04, 0.92, 0.1, 0], [0.05, 0.12, 0.85, 0]])],
    "blue": [("saturation", 0), ("rows", [[0.15, 0.15, 0.15, 0], [0.45, 0.45, 0.45, 0], [0.95, 0.95, 0.95, 12]])],
    "invert": [("rows", [[-1, 0, 0, 255], [0, -1, 0, 255], [0, 0, -1, 255]])],
    "vivid": [("saturation", 1.6)],
    "faded": [("saturation", 0.65), ("contrast", 0.92), ("offset", 18)],
    "crisp": [("saturation", 1.12), ("contrast", 1.28)],
    "night": [("saturation", 0.9), ("contrast", 1.15), ("offset", -34)],
}

# an image's pixels come from its own row, never from a join of pixels: an optimizer may cross such a join before it filters
_LEVEL = "least(255, greatest(0, floor(({}::DOUBLE + 1) * 127.5)))::INTEGER"
GRAY = f"""gray AS MATERIALIZED (
  SELECT img_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, {_LEVEL.format("v")} AS lum
  FROM (SELECT vec_id AS img_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"""
RGB = f"""triples AS (
  SELECT vec_id // 3 AS img_id, {", ".join(f"max(embedding) FILTER (vec_id % 3 = {k}) AS e{k}" for k in range(3))} FROM embeddings GROUP BY ALL HAVING count(*) = 3),
rgb AS MATERIALIZED (
  SELECT img_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, {", ".join(f"{_LEVEL.format(f'v{k}')} AS {c}" for k, c in enumerate("rgb"))}
  FROM (SELECT img_id, unnest(range(64)) AS i, unnest(e0) AS v0, unnest(e1) AS v1, unnest(e2) AS v2 FROM triples))"""
LUMA = "(((299 * r + 587 * g + 114 * b + 500) // 1000)::INTEGER)"
REGISTRY = """reg AS (
  SELECT doc_id AS id, 'doc_' || doc_id AS title, 1704067200000 + doc_id * 3600000 AS timestamp, (doc_id % 5 + 1)::INTEGER AS pageCount,
         CASE doc_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'pdf' ELSE 'jpg' END AS format, text AS searchText,
         CASE WHEN doc_id % 3 <> 2 THEN 'pdf:' || doc_id END AS pdfUri,
         CASE WHEN doc_id % 3 = 1 THEN []::VARCHAR[] ELSE list_transform(range(1, doc_id % 5 + 2), lambda i: 'u:' || doc_id || ':' || i) END AS jpgUris
  FROM documents)"""
PAGES = "pages AS (SELECT conv_id AS doc_id, turn::INTEGER AS pos, 'original' AS filter_id, 0::DOUBLE AS brightness, 1::DOUBLE AS contrast FROM conversations)"
RASTER = """raster AS (
  SELECT l_orderkey, l_linenumber, l_partkey, (1 + trunc(l_extendedprice / 50))::INTEGER AS w, (1 + trunc(l_quantity * 80))::INTEGER AS h FROM lineitem)"""
KEYS = "l_orderkey, l_linenumber, l_partkey, w, h"
_CORNERS = ((100, 100), (700, 100), (700, 900), (100, 900))
QUADS = (
    "quads AS (SELECT vec_id AS quad_id, "
    + ", ".join(f"{float(v)} ::DOUBLE + 600.0::DOUBLE * embedding[{2 * k + i + 1}]::DOUBLE AS {'xy'[i]}{k}" for k, p in enumerate(_CORNERS) for i, v in enumerate(p))
    + ", 800 AS src_w, 1000 AS src_h FROM embeddings)"
)
SEGMENTS = """segs AS (
  SELECT vec_id AS img_id, o::INTEGER AS ord, 400.0::DOUBLE + 800.0::DOUBLE * embedding[4*o+1]::DOUBLE AS x1, 500.0::DOUBLE + 1000.0::DOUBLE * embedding[4*o+2]::DOUBLE AS y1,
         400.0::DOUBLE + 800.0::DOUBLE * embedding[4*o+3]::DOUBLE AS x2, 500.0::DOUBLE + 1000.0::DOUBLE * embedding[4*o+4]::DOUBLE AS y2
  FROM embeddings, (SELECT unnest(range(16)) AS o))"""
MOVES = "moves AS (SELECT user_id AS gesture_id, event_id AS seq, value AS x, (props::JSON ->> 'k')::DOUBLE * 5 AS y FROM events)"


def _otsu(source: str) -> str:
    return f"""hist AS (SELECT img_id, lum, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
  cum AS (SELECT img_id, lum, sum(n) OVER u AS wb, sum(lum * n) OVER u AS sb, sum(n) OVER t AS total, sum(lum * n) OVER t AS every FROM hist
          WINDOW u AS (PARTITION BY img_id ORDER BY lum), t AS (PARTITION BY img_id)),
  var AS MATERIALIZED (SELECT *, CASE WHEN total > wb THEN wb * (total - wb) * (sb / wb - (every - sb) / (total - wb)) * (sb / wb - (every - sb) / (total - wb)) END AS v FROM cum),
  best AS (SELECT img_id, lum, v, row_number() OVER (PARTITION BY img_id ORDER BY v DESC NULLS LAST, lum) AS k FROM var),
  otsu AS (SELECT img_id, CASE WHEN v > 0 THEN lum ELSE 127 END::INTEGER AS threshold FROM best WHERE k = 1)"""


def _times(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """b, then a, as 4 x 4 matrices."""
    return [[sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def _matrix(steps: list[tuple]) -> list[list[float]]:
    out = [[float(i == j) for j in range(4)] for i in range(4)]
    for kind, v in steps:
        m = [[float(i == j) for j in range(4)] for i in range(4)]
        for i in range(3):
            if kind == "saturation":
                for j, w in enumerate((0.213, 0.715, 0.072)):
                    m[i][j] = (1 - v) * w + (v if i == j else 0)
            elif kind == "contrast":
                m[i][i], m[i][3] = v, 127.5 * (1 - v)
            elif kind == "offset":
                m[i][3] = v
            else:
                m[i] = [float(x) for x in v[i]]
        out = _times(m, out)
    return out


def _colours(steps: list[tuple], source: str = "rgb") -> str:
    m = _matrix(steps)
    if not steps:
        return f"SELECT img_id, y, x, r, g, b FROM {source}"
    cols = ", ".join(f"least(255, greatest(0, floor({row[0]!r}::DOUBLE * r + {row[1]!r}::DOUBLE * g + {row[2]!r}::DOUBLE * b + {row[3]!r}::DOUBLE + 0.5::DOUBLE)))::INTEGER AS {c}" for row, c in zip(m, "rgb", strict=False))
    return f"SELECT img_id, y, x, {cols} FROM {source}"


def _sharp(c: str, source: str) -> str:
    return f"""SELECT img_id, y, x, CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN {c}
      ELSE least(255, greatest(0, 9 * {c} - lag({c}) OVER line - lead({c}) OVER line - lag({c}) OVER file - lead({c}) OVER file)) END::INTEGER AS {c}
    FROM {source} WINDOW line AS (PARTITION BY img_id, y ORDER BY x), file AS (PARTITION BY img_id, x ORDER BY y)"""


def _around(agg: str, source: str) -> str:
    return f"SELECT p.img_id, p.y, p.x, {agg} AS lum FROM {source} p JOIN {source} q ON q.img_id = p.img_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL"


# geometry in terms of x0, y0 .. x3, y3


def _dist(i: int, j: int) -> str:
    return f"sqrt((x{j} - x{i}) * (x{j} - x{i}) + (y{j} - y{i}) * (y{j} - y{i}))"


def _area2(x: str = "x", y: str = "y") -> str:
    return "(0.0::DOUBLE + " + " + ".join(f"({x}{k} * {y}{(k + 1) % 4} - {x}{(k + 1) % 4} * {y}{k})" for k in range(4)) + ")"


def _convex(x: str = "x", y: str = "y") -> str:
    c = [f"({x}{(k + 1) % 4} - {x}{k}) * ({y}{(k + 2) % 4} - {y}{(k + 1) % 4}) - ({y}{(k + 1) % 4} - {y}{k}) * ({x}{(k + 2) % 4} - {x}{(k + 1) % 4})" for k in range(4)]
    return "((" + " AND ".join(f"{v} > 0" for v in c) + ") OR (" + " AND ".join(f"{v} < 0" for v in c) + "))"


def _valid(x: str = "x", y: str = "y") -> str:
    long = " AND ".join(f"({x}{(k + 1) % 4} - {x}{k}) * ({x}{(k + 1) % 4} - {x}{k}) + ({y}{(k + 1) % 4} - {y}{k}) * ({y}{(k + 1) % 4} - {y}{k}) >= 1" for k in range(4))
    return f"({long} AND {_convex(x, y)})"


def _round(v: str) -> str:
    return f"floor({v} + 0.5)::INTEGER"


MEASURED = f"""measured AS MATERIALIZED (
  SELECT *, greatest({_dist(0, 1)}, {_dist(2, 3)}, {_dist(0, 3)}, {_dist(1, 2)}) AS longest,
         0.5::DOUBLE * ({_dist(0, 1)} + {_dist(2, 3)}) >= 0.5::DOUBLE * ({_dist(0, 3)} + {_dist(1, 2)}) AS wide,
         greatest(1, {_round(f"greatest({_dist(0, 1)}, {_dist(2, 3)})")} + 1) AS old_w, greatest(1, {_round(f"greatest({_dist(0, 3)}, {_dist(1, 2)})")} + 1) AS old_h FROM quads)"""


def _det(a: str, b: str, c: str) -> str:
    return f"(p{a} * (q{b} - q{c}) - q{a} * (p{b} - p{c}) + (p{b} * q{c} - p{c} * q{b}))"


RATIO = f"""centred AS MATERIALIZED (SELECT *, {", ".join(f"x{k} - src_w * 0.5::DOUBLE AS p{k}, y{k} - src_h * 0.5::DOUBLE AS q{k}" for k in range(4))} FROM measured),
  dets AS MATERIALIZED (SELECT *, {_det("1", "3", "2")} AS d2, {_det("3", "1", "2")} AS d3, {_det("0", "3", "2")} AS n2, {_det("0", "1", "2")} AS n3 FROM centred),
  ks AS MATERIALIZED (SELECT *, CASE WHEN abs(d2) >= 1e-9 AND abs(d3) >= 1e-9 THEN n2 / d2 END AS k2, CASE WHEN abs(d2) >= 1e-9 AND abs(d3) >= 1e-9 THEN n3 / d3 END AS k3 FROM dets),
  ns AS MATERIALIZED (SELECT *, k2 * p1 - p0 AS ax, k2 * q1 - q0 AS ay, k2 - 1 AS az, k3 * p3 - p0 AS bx, k3 * q3 - q0 AS bye, k3 - 1 AS bz FROM ks),
  fs AS MATERIALIZED (SELECT *, CASE WHEN abs(az) >= 1e-6 AND abs(bz) >= 1e-6 THEN -(ax * bx + ay * bye) / (az * bz) END AS f0 FROM ns),
  ff AS MATERIALIZED (SELECT *, CASE WHEN k2 IS NULL OR abs(az) < 1e-6 OR abs(bz) < 1e-6 THEN NULL WHEN f0 > 0 AND isfinite(f0) THEN f0 ELSE greatest(src_w, src_h)::DOUBLE * greatest(src_w, src_h)::DOUBLE END AS f FROM fs),
  sq AS MATERIALIZED (SELECT *, CASE WHEN bx * bx + bye * bye + bz * bz * f >= 1e-12 THEN (ax * ax + ay * ay + az * az * f) / (bx * bx + bye * bye + bz * bz * f) END AS s FROM ff),
  ratios AS MATERIALIZED (SELECT *, CASE WHEN s > 0 AND isfinite(s) THEN sqrt(s) END AS ratio FROM sq)"""
_PROJ = [
    f"CASE WHEN longest < 1 THEN 1 WHEN ratio BETWEEN 0.01 AND 100 THEN greatest(1, CASE WHEN wide THEN {_round('longest')} ELSE {_round('longest * ratio')} END) + 1 ELSE old_w END::INTEGER",
    f"CASE WHEN longest < 1 THEN 1 WHEN ratio BETWEEN 0.01 AND 100 THEN greatest(1, CASE WHEN wide THEN {_round('longest / ratio')} ELSE {_round('longest')} END) + 1 ELSE old_h END::INTEGER",
]


def _fixed(ratio: str) -> list[str]:
    good = f"coalesce({ratio} > 0 AND {ratio} <= 1, false) AND longest >= 1"
    return [
        f"CASE WHEN {good} THEN greatest(1, CASE WHEN wide THEN {_round('longest')} ELSE {_round(f'longest * {ratio}')} END) + 1 ELSE 1 END::INTEGER",
        f"CASE WHEN {good} THEN greatest(1, CASE WHEN wide THEN {_round(f'longest * {ratio}')} ELSE {_round('longest')} END) + 1 ELSE 1 END::INTEGER",
    ]


def _ordered(source: str, key: str) -> str:
    """CTE `ord4`: corners by angle from the least sum."""
    corners = " UNION ALL ".join(f"SELECT *, {k} AS k, x{k} AS px, y{k} AS py FROM {source}" for k in range(4))
    return f"""pts AS ({corners}),
  around AS MATERIALIZED (SELECT *, round(atan2(py - (y0 + y1 + y2 + y3) / 4, px - (x0 + x1 + x2 + x3) / 4), 9) AS a FROM pts),
  num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY a, k, px, py) - 1 AS i FROM around),
  st AS MATERIALIZED (SELECT *, first_value(i) OVER (PARTITION BY {key} ORDER BY px + py, i) AS s FROM num),
  ord4 AS (SELECT {key}, {", ".join(f"max(CASE WHEN (i - s + 4) % 4 = {k} THEN p{c} END) AS {c}{k}" for k in range(4) for c in "xy")} FROM st GROUP BY {key})"""


def _angle(k: int) -> str:
    i, j = (k + 3) % 4, (k + 1) % 4
    dot = f"((x{i} - x{k}) * (x{j} - x{k}) + (y{i} - y{k}) * (y{j} - y{k}))"
    size = f"(sqrt((x{i} - x{k}) * (x{i} - x{k}) + (y{i} - y{k}) * (y{i} - y{k})) * sqrt((x{j} - x{k}) * (x{j} - x{k}) + (y{j} - y{k}) * (y{j} - y{k})) + 1e-9::DOUBLE)"
    return f"round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {dot} / {size})))), 9)"


def _angles(low: float, high: float) -> str:
    return "(" + " AND ".join(f"{_angle(k)} BETWEEN {low} AND {high}" for k in range(4)) + ")"


RECT = f"CASE WHEN {_angles(60.0, 120.0)} THEN round(0.0::DOUBLE + " + " + ".join(f"greatest(0.0::DOUBLE, 30.0::DOUBLE - abs({_angle(k)} - 90.0::DOUBLE))" for k in range(4)) + ", 6) ELSE -1.0::DOUBLE END"
COLS = ", ".join(f"{c}{k}" for k in range(4) for c in "xy")


def _project(px: str, py: str, k: int) -> tuple[str, str]:
    j = (k + 1) % 4
    dx, dy = f"(x{j} - x{k})", f"(y{j} - y{k})"
    size = f"({dx} * {dx} + {dy} * {dy})"
    t = f"CASE WHEN {size} <= 1e-6 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({px} - x{k}) * {dx} + ({py} - y{k}) * {dy}) / {size})) END"
    qx, qy = f"({px} - (x{k} + ({t}) * {dx}))", f"({py} - (y{k} + ({t}) * {dy}))"
    return t, f"sqrt({qx} * {qx} + {qy} * {qy})"


def _edge_hit() -> str:
    px, py = "(400.0::DOUBLE + quad_id % 300)", "(90.0::DOUBLE + quad_id % 37)"
    rows = []
    for k in range(4):
        t, dist = _project(px, py, k)
        rows.append(f"SELECT quad_id, {k} AS k, CASE WHEN ({t}) > 0.15 AND ({t}) < 1 - 0.15::DOUBLE THEN {dist} END AS d FROM quads")
    corners = " UNION ALL ".join(f"SELECT quad_id, {k} AS k, sqrt(({px} - 300 - x{k}) * ({px} - 300 - x{k}) + ({py} - y{k}) * ({py} - y{k})) AS d FROM quads" for k in range(4))
    return f"""WITH {QUADS}, e AS ({" UNION ALL ".join(rows)}), c AS ({corners}),
  be AS (SELECT quad_id, k FROM (SELECT *, row_number() OVER (PARTITION BY quad_id ORDER BY d, k) AS n FROM e WHERE d < 24) WHERE n = 1),
  bc AS (SELECT quad_id, k FROM (SELECT *, row_number() OVER (PARTITION BY quad_id ORDER BY d, k) AS n FROM c WHERE d < 70) WHERE n = 1)
SELECT quad_id, coalesce(be.k, -1)::INTEGER AS edge, coalesce(bc.k, -1)::INTEGER AS corner FROM quads LEFT JOIN be USING (quad_id) LEFT JOIN bc USING (quad_id)"""


def _normal(k: int) -> tuple[str, str, str]:
    """nx, ny and length of edge k."""
    j, c, d = (k + 1) % 4, (k + 2) % 4, (k + 3) % 4
    size = f"sqrt((x{j} - x{k}) * (x{j} - x{k}) + (y{j} - y{k}) * (y{j} - y{k}))"
    nx, ny = f"(-(y{j} - y{k}) / {size})", f"((x{j} - x{k}) / {size})"
    ox, oy = (f"(0.5::DOUBLE * ({v}{k} + {v}{j}) - 0.5::DOUBLE * ({v}{c} + {v}{d}))" for v in "xy")
    sign = f"(CASE WHEN {nx} * {ox} + {ny} * {oy} >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
    return tuple(f"CASE WHEN {size} < 1e-6 THEN 0.0::DOUBLE ELSE {sign} * {v} END" for v in (nx, ny)) + (size,)


def _edge_translate() -> str:
    nx, ny, _ = _normal(1)
    moved = ", ".join(f"{c}{k} + {f'd * n{c}' if k in (1, 2) else '0.0::DOUBLE'} AS m{c}{k}" for k in range(4) for c in "xy")
    out = ", ".join(f"CASE WHEN applied THEN m{c}{k} ELSE {c}{k} END AS {c}{k}" for k in range(4) for c in "xy")
    return f"""WITH {QUADS}, n AS MATERIALIZED (SELECT *, {nx} AS nx, {ny} AS ny FROM quads),
  ds AS MATERIALIZED (SELECT *, (760.0::DOUBLE - (x1 + x2) / 2) * nx + (480.0::DOUBLE - (y1 + y2) / 2) * ny AS d FROM n),
  m AS MATERIALIZED (SELECT *, {moved} FROM ds),
  a AS MATERIALIZED (SELECT *, {_valid("mx", "my")} AND (0.5::DOUBLE * {_area2("mx", "my")}) * (0.5::DOUBLE * {_area2()}) > 0 AS applied FROM m)
SELECT quad_id, applied, {out} FROM a"""


def _edge_drag() -> str:
    """Every move against the box; the last one that is applied."""
    box = ((0.0, 0.0), (490.0, 0.0), (490.0, 500.0), (0.0, 500.0))
    at = ", ".join(f"{p[i]}::DOUBLE AS {'xy'[i]}{k}" for k, p in enumerate(box) for i in range(2))
    nx, ny, _ = _normal(1)
    moved = ", ".join(f"{c}{k} + {f'd * n{c}' if k in (1, 2) else '0.0::DOUBLE'} AS m{c}{k}" for k in range(4) for c in "xy")
    names = [f"{c}{k}" for k in range(4) for c in "xy"]
    return f"""WITH {MOVES}, q AS MATERIALIZED (SELECT gesture_id, seq, x AS px, y AS py, {at} FROM moves), n AS MATERIALIZED (SELECT *, {nx} AS nx, {ny} AS ny FROM q),
  ds AS MATERIALIZED (SELECT *, (px - (x1 + x2) / 2) * nx + (py - (y1 + y2) / 2) * ny AS d FROM n), m AS MATERIALIZED (SELECT *, {moved} FROM ds),
  a AS MATERIALIZED (SELECT *, {_valid("mx", "my")} AND (0.5::DOUBLE * {_area2("mx", "my")}) * (0.5::DOUBLE * {_area2()}) > 0 AS applied FROM m),
  l AS (SELECT gesture_id, bool_or(applied) AS moved, {", ".join(f"arg_max(m{c}, seq) FILTER (applied) AS e{c}" for c in names)}, {", ".join(f"any_value({c}) AS {c}" for c in names)} FROM a GROUP BY gesture_id)
SELECT gesture_id, moved, {", ".join(f"coalesce(e{c}, {c}) AS {c}" for c in names)} FROM l"""


def _delta(fx: float, fy: float, x: str, y: str, same: str) -> str:
    angle = f"degrees(atan2(abs({y} - {fy}::DOUBLE), abs({x} - {fx}::DOUBLE)))"
    return f"CASE WHEN {x} = {fx} AND {y} = {fy} THEN {same} ELSE round(least({angle}, 90.0::DOUBLE - {angle}), 9) END"


def _snap_fold() -> str:
    """Rows of a gesture one after another, all gestures at once, by recursion over the move's number."""
    mx, my = "least(greatest(m.x, 0.0::DOUBLE), 490.0::DOUBLE)", "least(greatest(m.y, 0.0::DOUBLE), 500.0::DOUBLE)"
    turns = lambda x, y: [f"(490.0::DOUBLE * ({y}))", f"(({x} - 490) * (500.0::DOUBLE - {y}) - ({y}) * (0.0::DOUBLE - {x}))", f"((0.0::DOUBLE - {x}) * (-500.0::DOUBLE) - (500.0::DOUBLE - {y}) * 0)", "(0 * 0 + 500.0::DOUBLE * 490)"]
    # corners: 0 (0, 0), 1 (490, 0), 2 the moving one, 3 (0, 500); the cross products at edges 0-1-2, 1-2-3, 2-3-0, 3-0-1
    up = " AND ".join(f"{t} > 0" for t in turns("x2", "y2"))
    down = " AND ".join(f"{t} < 0" for t in turns("x2", "y2"))
    return f"""WITH RECURSIVE {MOVES}, seqs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gesture_id ORDER BY seq) AS n FROM moves),
  m AS (SELECT gesture_id, n, {mx} AS mx, {my} AS my, {_delta(490.0, 0.0, mx, my, "90.0::DOUBLE")} AS dp, {_delta(0.0, 500.0, mx, my, "90.0::DOUBLE")} AS dn,
        abs({mx} - 490) >= abs({my} - 0) AS lp, abs({mx} - 0) >= abs({my} - 500) AS ln FROM seqs m),
  fold AS (
    SELECT gesture_id, 0::BIGINT AS n, 490.0::DOUBLE AS x, 500.0::DOUBLE AS y, false AS prev_on, false AS next_on, 0::BIGINT AS n_prev, 0::BIGINT AS n_next FROM (SELECT DISTINCT gesture_id FROM m)
    UNION ALL
    SELECT gesture_id, n, CASE WHEN good THEN x2 ELSE mx END, CASE WHEN good THEN y2 ELSE my END, p AND good, q AND good, n_prev + (p AND good)::BIGINT, n_next + (q AND good)::BIGINT FROM (
      SELECT *, NOT (p OR q) OR ({up}) OR ({down}) AS good FROM (
        SELECT *, CASE WHEN q AND NOT (abs(x1 - 0) >= abs(y1 - 500)) THEN 0.0::DOUBLE ELSE x1 END AS x2, CASE WHEN q AND abs(x1 - 0) >= abs(y1 - 500) THEN 500.0::DOUBLE ELSE y1 END AS y2 FROM (
          SELECT *, CASE WHEN p AND NOT lp THEN 490.0::DOUBLE ELSE mx END AS x1, CASE WHEN p AND lp THEN 0.0::DOUBLE ELSE my END AS y1 FROM (
            SELECT *, p0 AND NOT (p0 AND q0 AND lp = ln AND dp > dn) AS p, q0 AND NOT (p0 AND q0 AND lp = ln AND dp <= dn) AS q FROM (
              SELECT m.gesture_id, m.n, m.mx, m.my, m.dp, m.dn, m.lp, m.ln, f.n_prev, f.n_next,
                     m.dp <= CASE WHEN f.prev_on THEN 3.0 ELSE 1.5 END AS p0, m.dn <= CASE WHEN f.next_on THEN 3.0 ELSE 1.5 END AS q0
              FROM fold f JOIN m ON m.gesture_id = f.gesture_id AND m.n = f.n + 1))))))
SELECT gesture_id, x, y, prev_on, next_on, n_prev, n_next FROM fold QUALIFY n = max(n) OVER (PARTITION BY gesture_id)"""


LINE_ANGLE = "round(((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180, 9)"
KIND = "CASE WHEN a < 30 OR a > 150 THEN 'level' WHEN a > 60 AND a < 120 THEN 'upright' ELSE 'other' END"


def _meet(a: str, b: str) -> tuple[str, str, str]:
    den = f"(({a}.x1 - {a}.x2) * ({b}.y1 - {b}.y2) - ({a}.y1 - {a}.y2) * ({b}.x1 - {b}.x2))"
    t = f"((({a}.x1 - {b}.x1) * ({b}.y1 - {b}.y2) - ({a}.y1 - {b}.y1) * ({b}.x1 - {b}.x2)) / {den})"
    return den, f"({a}.x1 + {t} * ({a}.x2 - {a}.x1))", f"({a}.y1 + {t} * ({a}.y2 - {a}.y1))"


def _hough() -> str:
    cols, dens = [], []
    for k, (a, b) in enumerate((("t", "l"), ("t", "r"), ("b", "r"), ("b", "l"))):
        den, x, y = _meet(a, b)
        dens.append(f"abs({den}) >= 1e-10")
        cols += [f"least(greatest({x}, 0.0::DOUBLE), 800.0::DOUBLE) AS x{k}", f"least(greatest({y}, 0.0::DOUBLE), 1000.0::DOUBLE) AS y{k}"]
    return f"""WITH {SEGMENTS}, ang AS MATERIALIZED (SELECT *, {LINE_ANGLE} AS a FROM segs), kinds AS MATERIALIZED (SELECT *, {KIND} AS kind FROM ang),
  mid AS MATERIALIZED (SELECT *, CASE kind WHEN 'level' THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END AS pos FROM kinds),
  rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY img_id, kind ORDER BY pos, ord) AS lo, row_number() OVER (PARTITION BY img_id, kind ORDER BY pos DESC, ord DESC) AS hi FROM mid),
  four AS (SELECT t.img_id, {", ".join(cols)} FROM rk t JOIN rk b ON b.img_id = t.img_id AND t.kind = 'level' AND t.lo = 1 AND b.kind = 'level' AND b.hi = 1 AND b.ord <> t.ord
    JOIN rk l ON l.img_id = t.img_id AND l.kind = 'upright' AND l.lo = 1 JOIN rk r ON r.img_id = t.img_id AND r.kind = 'upright' AND r.hi = 1 AND r.ord <> l.ord WHERE {" AND ".join(dens)}),
  {_ordered("four", "img_id")}
SELECT img_id, {", ".join(f"round({c}{k}, 6) AS {c}{k}" for k in range(4) for c in "xy")} FROM ord4 WHERE abs({_area2()}) / 2 >= 0.05 * 800 * 1000 AND {_angles(28.0, 152.0)}"""


def _best_quad() -> str:
    aspect = f"((({_dist(2, 1)} + {_dist(0, 3)}) / 2) / (({_dist(1, 0)} + {_dist(3, 2)}) / 2 + 1e-9::DOUBLE))"
    return f"""WITH {QUADS}, big AS MATERIALIZED (SELECT *, abs({_area2()}) / 2 AS area FROM quads WHERE abs({_area2()}) / 2 >= 800000::DOUBLE * 0.08::DOUBLE AND {_convex()}),
  {_ordered("big", "quad_id")},
  sc AS (SELECT o.*, b.area, {RECT} AS rect FROM (SELECT * FROM ord4) o JOIN (SELECT quad_id, area FROM big) b USING (quad_id)),
  ok AS MATERIALIZED (SELECT *, round(0.6::DOUBLE * area / 800000::DOUBLE + 0.4::DOUBLE * rect / 120.0::DOUBLE, 9) AS score FROM sc WHERE rect >= 0 AND {aspect} > 0.5 AND {aspect} < 2.5)
SELECT quad_id // 8 AS img_id, quad_id % 8 AS ord, score, {COLS} FROM ok QUALIFY row_number() OVER (PARTITION BY quad_id // 8 ORDER BY score DESC, quad_id % 8) = 1"""


DAY = "strftime(make_timestamp(timestamp * 1000), '%b %-d, %Y')"
EXPORTS = f"""{PAGES}, ex AS (
  SELECT doc_id, pos, CASE doc_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'pdf' ELSE 'jpg' END AS format, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n,
         count(*) OVER (PARTITION BY doc_id) AS pages, 'scan_' || strftime(make_timestamp((1704067200000 + doc_id * 1000) * 1000), '%Y%m%d_%H%M%S') AS base FROM pages),
  named AS MATERIALIZED (SELECT *, CASE WHEN pages = 1 THEN base || '.jpg' ELSE base || '_p' || n || '.jpg' END AS name FROM ex),
  files AS (SELECT DISTINCT doc_id, 0 AS seq, base || '.pdf' AS name, 'pdf' AS kind FROM named WHERE format <> 'jpg'
    UNION ALL SELECT doc_id, n::INTEGER, name, 'jpg' FROM named WHERE format <> 'pdf')"""
_FMT = "CASE l_partkey % 4 WHEN 0 THEN 'FIT_TO_IMAGE' WHEN 1 THEN 'A4' WHEN 2 THEN 'US_LETTER' ELSE 'LEGAL' END"
_DPI = "CASE l_orderkey % 4 WHEN 0 THEN 300 WHEN 1 THEN 200 WHEN 2 THEN 150 ELSE 110 END"


def _budget(side: str) -> str:
    inches = {"A4": (8.27, 11.69), "US_LETTER": (8.5, 11.0), "LEGAL": (8.5, 14.0)}
    cases = " ".join(f"WHEN '{k}' THEN greatest(1, trunc({v[side == 'h']}::FLOAT * dpi::FLOAT))" for k, v in inches.items())
    return f"(CASE page_format {cases} ELSE trunc((842::FLOAT / 72::FLOAT) * dpi::FLOAT) END)::INTEGER"


def _layout() -> str:
    s = "least((budget_w::FLOAT / w::FLOAT)::FLOAT, (budget_h::FLOAT / h::FLOAT)::FLOAT)"
    side = lambda c: f"CASE WHEN w <= budget_w AND h <= budget_h THEN {c} ELSE greatest(1, trunc({c}::FLOAT * {s})) END::INTEGER"
    aspect = "(box_w::FLOAT / box_h::FLOAT)"
    return f"""WITH {RASTER}, f AS MATERIALIZED (SELECT *, {_FMT} AS page_format, {_DPI} AS dpi FROM raster), b AS MATERIALIZED (SELECT *, {_budget("w")} AS budget_w, {_budget("h")} AS budget_h FROM f),
  x AS MATERIALIZED (SELECT *, {side("w")} AS box_w, {side("h")} AS box_h FROM b),
  p AS MATERIALIZED (SELECT *, CASE page_format WHEN 'A4' THEN 595 WHEN 'US_LETTER' THEN 612 WHEN 'LEGAL' THEN 612 ELSE CASE WHEN {aspect} >= 1 THEN 842::FLOAT ELSE 842::FLOAT * {aspect} END END::FLOAT::DOUBLE AS pw,
        CASE page_format WHEN 'A4' THEN 842 WHEN 'US_LETTER' THEN 792 WHEN 'LEGAL' THEN 1008 ELSE CASE WHEN {aspect} >= 1 THEN 842::FLOAT / {aspect} ELSE 842::FLOAT END END::FLOAT::DOUBLE AS ph FROM x),
  q AS MATERIALIZED (SELECT *, CASE WHEN page_format <> 'FIT_TO_IMAGE' AND box_w > box_h THEN ph ELSE pw END AS page_w, CASE WHEN page_format <> 'FIT_TO_IMAGE' AND box_w > box_h THEN pw ELSE ph END AS page_h FROM p),
  z AS MATERIALIZED (SELECT *, least(page_w / box_w, page_h / box_h) * CASE WHEN page_format <> 'FIT_TO_IMAGE' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS s FROM q)
SELECT {KEYS}, box_w, box_h, floor(page_w)::INTEGER AS page_w, floor(page_h)::INTEGER AS page_h, round((page_w - box_w * s) / 2, 6) AS left, round((page_h - box_h * s) / 2, 6) AS top,
       round((page_w + box_w * s) / 2, 6) AS right, round((page_h + box_h * s) / 2, 6) AS bottom FROM z"""


def sql() -> dict[str, str]:
    din = repr(1 / math.sqrt(2.0))
    mode_ratio = f"CASE choice WHEN 'CUSTOM' THEN try_cast(replace(custom, ',', '.') AS FLOAT)::DOUBLE WHEN 'A4' THEN {din}::DOUBLE WHEN 'US_LETTER' THEN {8.5 / 11.0!r}::DOUBLE WHEN 'LEGAL' THEN {8.5 / 14.0!r}::DOUBLE END"
    fw, fh = _fixed("fr")
    k1, k2 = _fixed("0.7071::DOUBLE")
    out = {
        "otsu_threshold": f"WITH {GRAY}, {_otsu('gray')} SELECT * FROM otsu",
        "luma_histogram": f"WITH {GRAY} SELECT img_id, lum, count(*) AS n FROM gray GROUP BY ALL",
        "binarize_bw": f"WITH {RGB}, l AS (SELECT img_id, y, x, {LUMA} AS lum FROM rgb), {_otsu('l')} SELECT img_id, y, x, CASE WHEN lum <= threshold THEN 0 ELSE 255 END AS bit FROM l JOIN otsu USING (img_id)",
        "mean_intensity": f"WITH {GRAY} SELECT img_id, sum(lum)::DOUBLE / count(*) AS mean FROM gray GROUP BY ALL",
        "low_light_flag": f"""WITH {GRAY}, c AS (SELECT img_id, lum, (SELECT count(*) FROM gray q WHERE q.img_id = g.img_id AND q.lum <= g.lum) AS cum FROM (SELECT DISTINCT img_id, lum FROM gray) g),
          m AS (SELECT img_id, min(lum) AS median_level FROM c WHERE cum >= 32 GROUP BY ALL) SELECT img_id, median_level, median_level < 60 AS low_light FROM m""",
        "invert_if_dark": f"WITH {GRAY} SELECT img_id, y, x, CASE WHEN avg(lum) OVER (PARTITION BY img_id) < 128 THEN 255 - lum ELSE lum END AS lum FROM gray",
        "gamma_lowlight": f"WITH {GRAY} SELECT img_id, y, x, floor(round(pow(lum / 255.0::DOUBLE, 0.75::DOUBLE) * 255.0::DOUBLE, 6) + 0.5::DOUBLE)::INTEGER AS lum FROM gray",
        "sharpen_3x3": f"WITH {GRAY} {_sharp('lum', 'gray')}",
        "dilate_3x3": f"WITH {GRAY} {_around('max(q.lum)', 'gray')}",
        "close_3x3": f"WITH {GRAY}, d AS ({_around('max(q.lum)', 'gray')}) {_around('min(q.lum)', 'd')}",
        "median_3x3": f"WITH {GRAY} {_around('list_sort(list(q.lum))[len(list(q.lum)) // 2 + 1]', 'gray')}",
        "edge_union": f"WITH {RGB} SELECT img_id, y, x, CASE WHEN r > 140 OR g > 140 THEN 255 ELSE 0 END AS edge FROM rgb",
        "edge_thresholds": f"WITH {GRAY}, m AS (SELECT img_id, sum(lum)::DOUBLE / count(*) AS mean FROM gray GROUP BY ALL) SELECT img_id, greatest(0.0::DOUBLE, 0.67::DOUBLE * mean) AS lower, least(255.0::DOUBLE, 1.33::DOUBLE * mean) AS upper FROM m",
        "luminance_rgb": f"WITH {RGB} SELECT img_id, y, x, {LUMA} AS lum FROM rgb",
        "pack_argb": f"WITH {RGB} SELECT img_id, y, x, (r * 65536 + g * 256 + b - 16777216)::INTEGER AS argb, r, g, b FROM rgb",
        "filter_bw": f"""WITH {RGB}, c AS ({_colours([("saturation", 0), ("contrast", 1.1), ("offset", 5.0)])}), l AS (SELECT img_id, y, x, {LUMA} AS lum FROM c), {_otsu("l")},
          o AS (SELECT img_id, y, x, CASE WHEN lum <= threshold THEN 0 ELSE 255 END AS v FROM l JOIN otsu USING (img_id)) SELECT img_id, y, x, v AS r, v AS g, v AS b FROM o""",
        "filter_sharpen": f"""WITH {RGB}, sr AS ({_sharp("r", "rgb")}), sg AS ({_sharp("g", "rgb")}), sb AS ({_sharp("b", "rgb")}),
          s AS (SELECT * FROM sr JOIN sg USING (img_id, y, x) JOIN sb USING (img_id, y, x)) {_colours([("contrast", 0.9), ("offset", 2.5)], "s")}""",
        "filter_adjusted": f"WITH {RGB} {_colours([*RECIPES['magic'], ('contrast', 1.25), ('offset', 10.0)])}",
        "registry_search": f"WITH {REGISTRY} SELECT id, title FROM reg WHERE contains(lower(title), 'the') OR contains(lower(searchText), 'the')",
        "registry_recent6": f"WITH {REGISTRY} SELECT id, title, format FROM reg ORDER BY id DESC LIMIT 6",
        "registry_newest": f"WITH {REGISTRY} SELECT id, title FROM reg ORDER BY id DESC",
        "registry_delete": f"WITH {REGISTRY} SELECT id, title FROM reg WHERE id <> 7",
        "registry_delete_many": f"WITH {REGISTRY} SELECT id, format FROM reg WHERE id % 3 <> 0",
        "registry_insert": f"WITH {REGISTRY} SELECT id, title, pageCount FROM reg UNION ALL SELECT (SELECT max(id) FROM reg) + row_number() OVER (ORDER BY id), 'new ' || title, pageCount FROM reg WHERE id < 3",
        "registry_lookup": f"WITH {REGISTRY} SELECT id, title, timestamp FROM reg WHERE id = 11",
        "registry_cascade_uris": f"WITH {REGISTRY}, u AS (SELECT id, unnest(list_filter(list_concat([pdfUri], jpgUris), lambda u: u IS NOT NULL)) AS uri, generate_subscripts(list_filter(list_concat([pdfUri], jpgUris), lambda u: u IS NOT NULL), 1) AS k FROM reg WHERE id = 9) SELECT id, (k - 1)::INTEGER AS seq, uri FROM u",
        "registry_share_target": f"WITH {REGISTRY} SELECT id, coalesce(pdfUri, jpgUris[1]) AS uri, CASE WHEN pdfUri IS NOT NULL THEN 'application/pdf' WHEN jpgUris[1] IS NOT NULL THEN 'image/jpeg' END AS mime FROM reg",
        "registry_cover": f"WITH {REGISTRY} SELECT id, jpgUris[1] AS cover FROM reg",
        "registry_display": f"""WITH {REGISTRY} SELECT id, {DAY} || ' • ' || pageCount || ' page' || CASE WHEN pageCount > 1 THEN 's' ELSE '' END || ' • ' || CASE format WHEN 'pdf' THEN 'PDF' WHEN 'jpg' THEN 'JPG' ELSE 'PDF + JPG' END AS line,
          strftime(make_timestamp(timestamp * 1000), '%b %-d') || ' • ' || pageCount || 'p' AS short_line FROM reg""",
        "registry_images": f"WITH {REGISTRY}, u AS (SELECT id, unnest(jpgUris) AS uri, generate_subscripts(jpgUris, 1) AS k FROM reg) SELECT id, (k - 1)::INTEGER AS seq, uri FROM u",
        "registry_empty": f"WITH {REGISTRY} SELECT count(*) = 0 AS empty FROM reg WHERE contains(lower(title), 'no such text 100%_') OR contains(lower(searchText), 'no such text 100%_')",
        "registry_roundtrip": f"WITH {REGISTRY} SELECT id, title, timestamp, pageCount, format, pdfUri, len(jpgUris)::INTEGER AS n_jpg FROM reg",
        "settings_defaults": """SELECT * FROM (VALUES ('defaultFilter', 'original'), ('format', 'pdf'), ('theme', 'system'), ('inboxEnabled', 'false'), ('inboxUri', ''), ('accessibilityEnabled', 'false'),
          ('jpegQuality', '80'), ('jpegColor', 'true'), ('pageFormat', 'FIT_TO_IMAGE'), ('pdfQuality', 'STANDARD')) t(key, value)""",
        "page_move": f"WITH {PAGES} SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 2 THEN CASE pos WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE pos END ELSE pos END::INTEGER AS pos FROM pages",
        "page_remove": f"WITH {PAGES}, n AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pages) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS pos, pos AS was FROM n WHERE pos <> 0 OR n = 1",
        "page_append": f"""WITH {PAGES}, l AS (SELECT doc_id, max(pos) + 1 AS n FROM pages GROUP BY ALL) SELECT doc_id, pos FROM pages
          UNION ALL SELECT doc_id, (n + row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER FROM pages JOIN l USING (doc_id) WHERE pos < 2""",
        "page_labels": f"WITH {PAGES} SELECT doc_id, pos, 'Page ' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) || ' of ' || count(*) OVER (PARTITION BY doc_id) AS label FROM pages",
        "page_filter_update": f"WITH {PAGES} SELECT doc_id, pos, CASE WHEN pos = 2 THEN 'sepia' ELSE filter_id END AS filter_id, CASE WHEN pos = 2 THEN 0.25::DOUBLE ELSE brightness END AS brightness, CASE WHEN pos = 2 THEN 1.5::DOUBLE ELSE contrast END AS contrast FROM pages",
        "page_reset": f"WITH {PAGES} SELECT doc_id, pos, CASE WHEN pos = 1 THEN 'gray' ELSE filter_id END AS filter_id, brightness, contrast FROM pages",
        "page_selection": f"WITH {PAGES} SELECT doc_id, least(4, greatest(0, CASE WHEN count(*) > 1 THEN count(*) - 2 ELSE 0 END))::INTEGER AS selected FROM pages GROUP BY ALL",
        "page_clear": f"WITH {PAGES} SELECT doc_id, pos FROM pages WHERE false",
        "fit_max": f"WITH {RASTER} SELECT {KEYS}, CASE WHEN greatest(w, h) <= 2400 THEN w ELSE trunc(w::FLOAT * (2400::FLOAT / greatest(w, h)::FLOAT)) END::INTEGER AS fit_w, CASE WHEN greatest(w, h) <= 2400 THEN h ELSE trunc(h::FLOAT * (2400::FLOAT / greatest(w, h)::FLOAT)) END::INTEGER AS fit_h FROM raster",
        "fit_box": f"""WITH {RASTER}, s AS MATERIALIZED (SELECT *, least(1240::FLOAT / w::FLOAT, 1753::FLOAT / h::FLOAT) AS s, w <= 1240 AND h <= 1753 AS inside FROM raster)
          SELECT {KEYS}, CASE WHEN inside THEN w ELSE greatest(1, trunc(w::FLOAT * s)) END::INTEGER AS box_w, CASE WHEN inside THEN h ELSE greatest(1, trunc(h::FLOAT * s)) END::INTEGER AS box_h FROM s""",
        "sample_factor": f"WITH {RASTER} SELECT {KEYS}, (CASE " + " ".join(f"WHEN greatest(w, h) // {1 << k} <= 600 THEN {1 << k}" for k in range(24)) + " END)::INTEGER AS sample FROM raster",
        "pdf_render_size": f"WITH {RASTER}, s AS MATERIALIZED (SELECT *, least(8.0::DOUBLE, greatest(0.1::DOUBLE, 2200.0::DOUBLE / greatest(w, h))) AS s FROM raster) SELECT {KEYS}, greatest(1, trunc(w * s))::INTEGER AS render_w, greatest(1, trunc(h * s))::INTEGER AS render_h FROM s",
        "letterbox": f"""WITH {RASTER}, s AS MATERIALIZED (SELECT *, least(1080.0::DOUBLE / w, 1920.0::DOUBLE / h) AS s FROM raster)
          SELECT {KEYS}, (1080 - w * s) / 2 AS left, (1920 - h * s) / 2 AS top, (1080 + w * s) / 2 AS right, (1920 + h * s) / 2 AS bottom FROM s""",
        "rotate_90": f"WITH {GRAY} SELECT img_id, x AS y, (7 - y)::INTEGER AS x, lum FROM gray",
        "crop_rect": f"WITH {GRAY} SELECT img_id, (y - 3)::INTEGER AS y, (x - 2)::INTEGER AS x, lum FROM gray WHERE x >= 2 AND y BETWEEN 3 AND 6",
        "bounding_rect": f"""WITH {QUADS}, a AS MATERIALIZED (SELECT *, least(greatest(trunc(least(x0, x1, x2, x3))::INTEGER, 0), src_w - 1) AS l, least(greatest(trunc(least(y0, y1, y2, y3))::INTEGER, 0), src_h - 1) AS t FROM quads)
          SELECT quad_id, l AS left, t AS top, least(greatest(trunc(greatest(0, x0, x1, x2, x3))::INTEGER, l + 1), src_w) AS right, least(greatest(trunc(greatest(0, y0, y1, y2, y3))::INTEGER, t + 1), src_h) AS bottom FROM a""",
        "warp_nearest": f"WITH {GRAY} SELECT img_id, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, lum FROM gray WHERE y % 2 = 1 AND x % 2 = 1",
        "quad_area": f"WITH {QUADS} SELECT quad_id, 0.5::DOUBLE * {_area2()} AS area, abs(0.5::DOUBLE * {_area2()}) / (src_w * src_h) >= 0.02 AS large_enough FROM quads",
        "quad_valid": f"WITH {QUADS} SELECT quad_id, {_valid()} AS valid, {_convex()} AS convex FROM quads",
        "quad_normals": f"WITH {QUADS} SELECT quad_id, " + ", ".join(f"{_normal(k)[i]} AS n{'xy'[i]}{k}" for k in range(4) for i in range(2)) + " FROM quads",
        "edge_translate": _edge_translate(),
        "edge_hit": _edge_hit(),
        "axis_snap_flags": f"""WITH {MOVES}, d AS MATERIALIZED (SELECT *, {_delta(0.0, 500.0, "x", "y", "NULL")} AS a FROM moves),
          f AS MATERIALIZED (SELECT *, CASE WHEN a IS NULL OR a > 3 THEN false WHEN a <= 1.5 THEN true END AS s FROM d)
          SELECT gesture_id, seq, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY gesture_id ORDER BY seq), false) AS snapped FROM f""",
        "snap_fold": _snap_fold(),
        "warp_projective": f"WITH {QUADS}, {MEASURED}, {RATIO} SELECT quad_id, {_PROJ[0]} AS out_w, {_PROJ[1]} AS out_h FROM ratios",
        "warp_ratio": f"WITH {QUADS}, {MEASURED}, {RATIO} SELECT quad_id, round(ratio, 9) AS ratio FROM ratios",
        "warp_heuristic": f"WITH {QUADS}, {MEASURED} SELECT quad_id, old_w AS out_w, old_h AS out_h FROM measured",
        "warp_fixed": f"WITH {QUADS}, {MEASURED} SELECT quad_id, {k1} AS out_w, {k2} AS out_h FROM measured",
        "warp_mode": f"""WITH {QUADS}, {MEASURED}, {RATIO}, c AS MATERIALIZED (SELECT *, CASE quad_id % 7 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'ORIGINAL' WHEN 2 THEN 'CUSTOM' WHEN 3 THEN 'A4' WHEN 4 THEN 'US_LETTER' WHEN 5 THEN 'LEGAL' ELSE 'NONE' END AS choice,
            CASE WHEN quad_id % 2 = 0 THEN '0,5' ELSE 'x' END AS custom FROM ratios), f AS MATERIALIZED (SELECT *, {mode_ratio} AS fr FROM c)
          SELECT quad_id, choice, CASE choice WHEN 'AUTO' THEN {_PROJ[0]} WHEN 'ORIGINAL' THEN old_w ELSE {fw} END AS out_w, CASE choice WHEN 'AUTO' THEN {_PROJ[1]} WHEN 'ORIGINAL' THEN old_h ELSE {fh} END AS out_h FROM f""",
        "corner_order": f"WITH {QUADS}, sw AS (SELECT quad_id, x2 AS x0, y2 AS y0, x1, y1, x0 AS x2, y0 AS y2, x3, y3 FROM quads), {_ordered('sw', 'quad_id')} SELECT quad_id, {COLS} FROM ord4",
        "rect_score": f"WITH {QUADS}, {_ordered('quads', 'quad_id')} SELECT quad_id, {RECT} AS rect, NOT {_angles(28.0, 152.0)} AS bad_angle, abs({_area2()}) / 2 AS area FROM ord4",
        "best_quad": _best_quad(),
        "hough_quad": _hough(),
        "line_intersection": f"""WITH {SEGMENTS}, p AS (SELECT a.img_id, a.ord // 2 AS pair, CASE WHEN abs({_meet("a", "b")[0]}) >= 1e-10 THEN {_meet("a", "b")[1]} END AS x, CASE WHEN abs({_meet("a", "b")[0]}) >= 1e-10 THEN {_meet("a", "b")[2]} END AS y
          FROM segs a JOIN segs b ON a.img_id = b.img_id AND a.ord % 2 = 0 AND b.ord = a.ord + 1) SELECT img_id, pair::INTEGER AS pair, round(x, 6) AS x, round(y, 6) AS y FROM p""",
        "line_kinds": f"WITH {SEGMENTS}, ang AS MATERIALIZED (SELECT *, {LINE_ANGLE} AS a FROM segs) SELECT img_id, ord, {KIND} AS kind FROM ang",
        "pdf_pixel_budget": f"WITH f AS (SELECT DISTINCT {_FMT} AS page_format, {_DPI} AS dpi FROM lineitem) SELECT page_format, dpi, {_budget('w')} AS budget_w, {_budget('h')} AS budget_h FROM f",
        "pdf_page_layout": _layout(),
        "export_names": f"WITH {EXPORTS} SELECT doc_id, pos, name FROM named",
        "export_manifest": f"WITH {EXPORTS} SELECT doc_id, seq, name, kind FROM files",
        "export_written": f"WITH {EXPORTS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1)::INTEGER AS seq, 'content://' || name AS uri FROM files WHERE doc_id % 5 <> seq",
        "inbox_upsert": f"""WITH {EXPORTS}, inbox AS (SELECT name, 'old:' || name AS uri FROM files WHERE doc_id % 2 = 0), new AS (SELECT name, 'new:' || name AS uri FROM files WHERE kind = 'jpg')
          SELECT * FROM inbox WHERE name NOT IN (SELECT name FROM new) UNION ALL SELECT * FROM new""",
        "inbox_mirror": f"WITH {REGISTRY} SELECT id, CASE WHEN id % 4 = 0 THEN 'inbox:' || id ELSE pdfUri END AS pdf_uri FROM reg",
        "scalar_functions": f"""WITH {REGISTRY} SELECT id, title AS base_name, '1,' || id AS kept, ('1.' || id)::DOUBLE AS ratio, true AS blank, strftime(make_timestamp(timestamp * 1000), '%Y%m%d_%H%M%S') AS stamp,
          (((id * -7.5::DOUBLE) % 180) + 180) % 180 AS angle, least(greatest(id, 5), 90) AS clamped, (1 - id)::INTEGER AS rounded, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE id % 2 = 0 END AS dark FROM reg""",
    }
    out["grayscale_copy"] = f"WITH {RGB}, g AS MATERIALIZED (SELECT *, least(255, greatest(0, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)))::INTEGER AS v FROM rgb) SELECT img_id, y, x, v AS r, v AS g, v AS b FROM g"
    out["export_bw"] = f"""WITH {RGB}, c AS ({_colours(RECIPES["sepia"])}), d AS ({_colours(RECIPES["gray"], "c")}), l AS (SELECT img_id, y, x, {LUMA} AS lum FROM d), {_otsu("l")},
          o AS (SELECT img_id, y, x, CASE WHEN lum <= threshold THEN 0 ELSE 255 END AS v FROM l JOIN otsu USING (img_id)) SELECT img_id, y, x, v AS r, v AS g, v AS b FROM o"""
    out["edge_drag"] = _edge_drag()
    unit = lambda c, k: f"least(greatest(({c}{k} - {40.0 if c == 'x' else 30.0}::DOUBLE) / {640.0 if c == 'x' else 800.0}::DOUBLE, -0.05::DOUBLE), 1.05::DOUBLE) * {800 if c == 'x' else 1000}"
    out["crop_from_view"] = f"""WITH {QUADS.replace("quads AS", "viewed AS", 1)}, quads AS MATERIALIZED (SELECT quad_id, src_w, src_h, {", ".join(f"{unit(c, k)} AS {c}{k}" for k in range(4) for c in "xy")} FROM viewed), {MEASURED}
      SELECT quad_id, {COLS}, old_w AS out_w, old_h AS out_h FROM measured WHERE abs(0.5::DOUBLE * {_area2()}) / (src_w * src_h) >= 0.02"""
    inset = {"x": (0.02, 0.98, 0.98, 0.02), "y": (0.02, 0.02, 0.98, 0.98)}
    out["crop_turned"] = f"WITH {QUADS} SELECT quad_id, src_h AS src_w, src_w AS src_h, {', '.join(f'{inset[c][k]}::DOUBLE AS {c}{k}' for k in range(4) for c in 'xy')} FROM quads"
    out["page_replace"] = f"WITH {PAGES} SELECT doc_id, pos, CASE WHEN pos = 1 THEN 33 ELSE doc_id % 7 + 1 END::INTEGER AS w, CASE WHEN pos = 1 THEN 44 ELSE pos + 20 END::INTEGER AS h FROM pages"
    out["page_rotate"] = f"WITH {PAGES}, s AS (SELECT doc_id, pos, (doc_id % 7 + 1)::INTEGER AS w, (pos + 20)::INTEGER AS h FROM pages) SELECT doc_id, pos, CASE WHEN pos = 1 THEN h ELSE w END AS w, CASE WHEN pos = 1 THEN w ELSE h END AS h FROM s"
    out["page_select"] = f"WITH {PAGES} SELECT doc_id, CASE WHEN max(pos) >= 3 THEN 3 ELSE 0 END::INTEGER AS selected FROM pages GROUP BY ALL"
    out["min_text_size"] = f"""WITH {RASTER}, s AS MATERIALIZED (SELECT *, least(2.0::DOUBLE, 1800.0::DOUBLE / greatest(w, h)) AS s FROM raster)
          SELECT {KEYS}, CASE WHEN greatest(w, h) >= 1800 THEN w ELSE greatest(1, trunc(w * s)) END::INTEGER AS text_w, CASE WHEN greatest(w, h) >= 1800 THEN h ELSE greatest(1, trunc(h * s)) END::INTEGER AS text_h FROM s"""
    out["apply_crop"] = out["warp_mode"] + f" WHERE abs(0.5::DOUBLE * {_area2()}) / (src_w * src_h) >= 0.02"
    return out | {f"filter_{k}": f"WITH {RGB} {_colours(v)}" for k, v in RECIPES.items()}
