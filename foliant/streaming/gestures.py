"""Corner drags with right-angle snapping: a state that each move updates, as a fold and as a streaming operator.

The snap flags after a move decide how the next one is judged, and are cleared when the snapped quad would
not be convex, so no window frame expresses them: moves of a gesture are folded in order. A gesture is one drag
of a pointer; only that is held together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import let
from ..operators.geometry import SNAP_ENTER, SNAP_EXIT, translate_edge

BOX = ((0.0, 0.0), (490.0, 0.0), (490.0, 500.0), (0.0, 500.0))  # of the fixture: corners as a gesture finds them
DIGITS = 9  # to which angles are rounded, so that engines agree
STATE = "x double, y double, prev_on boolean, next_on boolean, n_prev bigint, n_next bigint"


def _delta(fixed: tuple[float, float], mx: Column, my: Column) -> Column:
    dx, dy = F.abs(mx - fixed[0]), F.abs(my - fixed[1])
    angle = F.degrees(F.atan2(dy, dx))
    return F.when((dx == 0) & (dy == 0), 90.0).otherwise(F.round(F.least(angle, F.lit(90.0) - angle), DIGITS))


def _level(fixed: tuple[float, float], mx: Column, my: Column) -> Column:
    return F.abs(mx - fixed[0]) >= F.abs(my - fixed[1])


def _convex(corners: list[tuple[Column, Column]]) -> Column:
    signs = []
    for k in range(4):
        (ax, ay), (bx, by), (cx, cy) = (corners[(k + i) % 4] for i in range(3))
        signs.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    up, down = F.lit(True), F.lit(True)
    for s in signs:
        up, down = up & (s > 0), down & (s < 0)
    return up | down


def step(state: Column, move: Column, corner: int, box=BOX) -> Column:
    """The state after a move of `corner`."""
    before, after = box[(corner + 3) % 4], box[(corner + 1) % 4]
    xs, ys = [p[0] for p in box], [p[1] for p in box]

    def judge(m: Column) -> Column:
        on = lambda d, was: d <= F.when(was, SNAP_EXIT).otherwise(SNAP_ENTER)
        return let(F.struct(_delta(before, m.x, m.y).alias("dp"), _delta(after, m.x, m.y).alias("dn")), lambda d: let(
            F.struct(on(d.dp, state.prev_on).alias("p"), on(d.dn, state.next_on).alias("n"), (d.dp <= d.dn).alias("prev_nearer"), (_level(before, m.x, m.y) == _level(after, m.x, m.y)).alias("same_axis")),
            lambda j: F.struct((j.p & ~(j.n & j.same_axis & ~j.prev_nearer)).alias("p"), (j.n & ~(j.p & j.same_axis & j.prev_nearer)).alias("n")),
        ))

    def onto(fixed: tuple[float, float], on: Column, at: Column) -> Column:
        level = _level(fixed, at.x, at.y)
        return F.struct(F.when(on & ~level, fixed[0]).otherwise(at.x).alias("x"), F.when(on & level, fixed[1]).otherwise(at.y).alias("y"))

    def settled(m: Column, j: Column, at: Column) -> Column:
        moved = [(at.x, at.y) if k == corner else (F.lit(a), F.lit(b)) for k, (a, b) in enumerate(box)]
        return let(~(j.p | j.n) | _convex(moved), lambda good: F.struct(
            F.when(good, at.x).otherwise(m.x).alias("x"), F.when(good, at.y).otherwise(m.y).alias("y"), (j.p & good).alias("prev_on"), (j.n & good).alias("next_on"),
            (state.n_prev + (j.p & good).cast("bigint")).alias("n_prev"), (state.n_next + (j.n & good).cast("bigint")).alias("n_next"),
        ))

    clamp = lambda v, all_: F.least(F.greatest(v, F.lit(min(all_))), F.lit(max(all_)))
    here = F.struct(clamp(move.x, xs).alias("x"), clamp(move.y, ys).alias("y"))
    return let(here, lambda m: let(judge(m), lambda j: let(onto(before, j.p, m), lambda a: let(onto(after, j.n, a), lambda b: settled(m, j, b)))))


def fold(moves: DataFrame, corner: int = 2, box=BOX) -> DataFrame:
    """gesture_id and the state after its last move: position, flags, and how many moves were snapped to either edge."""
    ordered = moves.groupBy("gesture_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("moves"))
    start = F.struct(F.lit(box[corner][0]).alias("x"), F.lit(box[corner][1]).alias("y"), F.lit(False).alias("prev_on"), F.lit(False).alias("next_on"), F.lit(0).cast("bigint").alias("n_prev"), F.lit(0).cast("bigint").alias("n_next"))
    return ordered.select("gesture_id", F.aggregate("moves", start, lambda s, m: step(s, m, corner, box)).alias("s")).select("gesture_id", "s.*")


def drag_edge(moves: DataFrame, edge: int, box=BOX) -> DataFrame:
    """gesture_id, x0 .. y3 and moved: the corners after an edge was dragged.

    Every move is judged against the corners at the start, so a drag ends where its last move that was allowed
    left it: an aggregate, without a fold.
    """
    corners = [f"{c}{k}" for k in range(4) for c in "xy"]
    at = {f"{c}{k}": F.lit(p[i]) for k, p in enumerate(box) for i, c in enumerate("xy")}
    rows = moves.select("gesture_id", "seq", F.col("x").alias("_px"), F.col("y").alias("_py")).withColumns(at)
    rows = translate_edge(rows, edge, F.col("_px"), F.col("_py"))
    last = rows.groupBy("gesture_id").agg(F.max_by(F.when(F.col("applied"), F.struct(*corners)), F.when(F.col("applied"), F.col("seq"))).alias("q"), F.max("applied").alias("moved"))
    return last.select("gesture_id", *[F.coalesce(F.col(f"q.{c}"), at[c]).alias(c) for c in corners], "moved")


@dataclass
class Snap:
    """The same for one move at a time, in plain Python: for the streaming operator, and to test the fold by."""

    corner: int = 2
    box: tuple = BOX
    x: float = 0.0
    y: float = 0.0
    prev_on: bool = False
    next_on: bool = False
    n_prev: int = 0
    n_next: int = 0

    def move(self, px: float, py: float) -> None:
        before, after = self.box[(self.corner + 3) % 4], self.box[(self.corner + 1) % 4]
        xs, ys = [c[0] for c in self.box], [c[1] for c in self.box]
        mx, my = min(max(px, min(xs)), max(xs)), min(max(py, min(ys)), max(ys))

        def delta(f: tuple[float, float]) -> float:
            a, b = abs(mx - f[0]), abs(my - f[1])
            if a == b == 0:
                return 90.0
            angle = math.degrees(math.atan2(b, a))
            return round(min(angle, 90 - angle), DIGITS)

        def level(f: tuple[float, float], u: float, v: float) -> bool:
            return abs(u - f[0]) >= abs(v - f[1])

        dp, dn = delta(before), delta(after)
        p = dp <= (SNAP_EXIT if self.prev_on else SNAP_ENTER)
        n = dn <= (SNAP_EXIT if self.next_on else SNAP_ENTER)
        if p and n and level(before, mx, my) == level(after, mx, my):
            p, n = (True, False) if dp <= dn else (False, True)
        cx, cy = mx, my
        for on, f in ((p, before), (n, after)):
            if on:
                cx, cy = (cx, f[1]) if level(f, cx, cy) else (f[0], cy)
        if p or n:
            q = [(cx, cy) if k == self.corner else c for k, c in enumerate(self.box)]
            turns = [(q[(k + 1) % 4][0] - q[k][0]) * (q[(k + 2) % 4][1] - q[(k + 1) % 4][1]) - (q[(k + 1) % 4][1] - q[k][1]) * (q[(k + 2) % 4][0] - q[(k + 1) % 4][0]) for k in range(4)]
            if not (all(t > 0 for t in turns) or all(t < 0 for t in turns)):
                p, n, cx, cy = False, False, mx, my
        self.x, self.y, self.prev_on, self.next_on = cx, cy, p, n
        self.n_prev += p
        self.n_next += n


def snap_stream(moves: DataFrame, corner: int = 2) -> DataFrame:
    """For a stream of moves (gesture_id, seq, x, y): each gesture's state after each micro-batch that brought moves of it.

    State is six numbers a gesture; within a batch moves are taken by seq. A move older than the last one taken
    comes too late and is dropped, as a pointer's past can't change what was already shown.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *values = state.get if state.exists else (-(1 << 62), BOX[corner][0], BOX[corner][1], False, False, 0, 0)
        snap = Snap(corner, BOX, *values)
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows[rows.seq > last].itertuples():
            snap.move(r.x, r.y)
            last = int(r.seq)
        values = (float(snap.x), float(snap.y), bool(snap.prev_on), bool(snap.next_on), int(snap.n_prev), int(snap.n_next))
        state.update((last, *values))
        yield pd.DataFrame([(key[0], *values)], columns=["gesture_id", "x", "y", "prev_on", "next_on", "n_prev", "n_next"])

    return moves.groupBy("gesture_id").applyInPandasWithState(update, f"gesture_id bigint, {STATE}", f"last bigint, {STATE}", "update", GroupStateTimeout.NoTimeout)
