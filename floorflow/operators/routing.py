"""Obstacle grids of floor plans, edits of them, and walking distances.

A grid cell is (r, c); its centre lies at ((c + 0.5) * cell, (r + 0.5) * cell).
Walls and shapes are tables: each row is spread over the cells of its bounding
box alone, so nothing is joined with every cell.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).selectExpr(f"CAST(id div {cols} AS INT) AS r", f"CAST(id % {cols} AS INT) AS c")


def _span(low: str, high: str, cell: float, n: int) -> str:
    at = lambda v: f"CAST(least({n - 1}, greatest(0, floor(({v}) / {cell!r}D))) AS INT)"
    return f"sequence({at(low)}, {at(high)})"


def _spread(boxes: DataFrame, rows: int, cols: int, cell: float) -> DataFrame:
    """Rows with x1, y1, x2, y2, repeated for the cells that their box meets."""
    near = boxes.where(f"x2 >= 0D AND y2 >= 0D AND x1 <= {cols * cell!r}D AND y1 <= {rows * cell!r}D")
    near = near.withColumn("r", F.explode(F.expr(_span("y1", "y2", cell, rows))))
    near = near.withColumn("c", F.explode(F.expr(_span("x1", "x2", cell, cols))))
    return near.withColumns({"cx": F.expr(f"(c + 5e-1D) * {cell!r}D"), "cy": F.expr(f"(r + 5e-1D) * {cell!r}D")})


def obstacle_grid(walls: DataFrame, exits: DataFrame, rows: int, cols: int, cell: float, clearance: float) -> DataFrame:
    """r, c and blocked of every cell: its centre is nearer than ``clearance``
    to a wall (ax, ay, bx, by).  The cells of ``exits`` (x, y) stay free."""
    k = f"{clearance!r}D"
    boxes = walls.selectExpr(
        "ax", "ay", "bx - ax AS dx", "by - ay AS dy", f"least(ax, bx) - {k} AS x1", f"greatest(ax, bx) + {k} AS x2",
        f"least(ay, by) - {k} AS y1", f"greatest(ay, by) + {k} AS y2",
    )
    met = _spread(boxes, rows, cols, cell)
    t = "least(1e0D, greatest(0e0D, coalesce(((cx - ax) * dx + (cy - ay) * dy) / nullif(dx * dx + dy * dy, 0e0D), 0e0D)))"
    met = met.withColumn("t", F.expr(t)).where(
        f"(cx - ax - t * dx) * (cx - ax - t * dx) + (cy - ay - t * dy) * (cy - ay - t * dy) < {clearance * clearance!r}D"
    )
    free = exits.selectExpr(f"CAST(floor(y / {cell!r}D) AS INT) AS r", f"CAST(floor(x / {cell!r}D) AS INT) AS c").distinct()
    hit = met.select("r", "c").distinct().join(free, ["r", "c"], "left_anti").withColumn("hit", F.lit(True))
    return grid(walls.sparkSession, rows, cols).join(hit, ["r", "c"], "left").select("r", "c", F.col("hit").isNotNull().alias("blocked"))


def shapes_of(openings: DataFrame, width: float) -> DataFrame:
    """Openings given as bare lines (x1, y1, x2, y2), as shapes."""
    pts = F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))
    return openings.select(F.lit("open").alias("op"), F.lit("line").alias("kind"), pts.alias("pts"), F.lit(float(width)).alias("w"))


def apply_shapes(cells: DataFrame, shapes: DataFrame, rows: int, cols: int, cell: float, exits: DataFrame | None = None) -> DataFrame:
    """Edit a grid: all openings first, then all blocks; exit cells stay free.

    ``shapes``: op (open or block), kind, pts (x and y in turn) and w.  A line
    takes the cells whose centres are nearer than w / 2, a rectangle (two
    corners) every cell it meets, a polygon the cells whose centres are inside
    by the even-odd rule.  Shapes of other kinds or with too few points do
    nothing."""
    least = "CASE kind WHEN 'line' THEN 4 WHEN 'rect' THEN 4 WHEN 'poly' THEN 6 END"
    good = shapes.where(f"size(pts) >= {least}").withColumns(
        {
            "xs": F.expr("filter(pts, (v, i) -> i % 2 = 0)"), "ys": F.expr("filter(pts, (v, i) -> i % 2 = 1)"),
            "pad": F.expr("CASE WHEN kind = 'line' THEN w / 2 ELSE 0D END"),
        }
    )
    first = "CASE WHEN kind = 'poly' THEN {0} ELSE slice({0}, 1, 2) END"
    boxes = good.withColumns({"xs": F.expr(first.format("xs")), "ys": F.expr(first.format("ys"))}).withColumns(
        {
            "x1": F.expr("array_min(xs) - pad"), "x2": F.expr("array_max(xs) + pad"),
            "y1": F.expr("array_min(ys) - pad"), "y2": F.expr("array_max(ys) + pad"),
        }
    )
    dx, dy = "(xs[1] - xs[0])", "(ys[1] - ys[0])"
    t = f"least(1D, greatest(0D, coalesce(((cx - xs[0]) * {dx} + (cy - ys[0]) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0D), 0D)))"
    off = f"(cx - xs[0] - {t} * {dx}) * (cx - xs[0] - {t} * {dx}) + (cy - ys[0] - {t} * {dy}) * (cy - ys[0] - {t} * {dy})"
    before = "element_at(xs, if(i = 0, -1, i))", "element_at(ys, if(i = 0, -1, i))"
    hit = f"(ys[i] > cy) <> ({before[1]} > cy) AND cx < ({before[0]} - xs[i]) * (cy - ys[i]) / ({before[1]} - ys[i]) + xs[i]"
    odd = f"aggregate(sequence(0, size(xs) - 1), 0, (n, i) -> n + CASE WHEN {hit} THEN 1 ELSE 0 END) % 2 = 1"
    met = _spread(boxes, rows, cols, cell).where(f"CASE kind WHEN 'rect' THEN true WHEN 'line' THEN {off} < pad * pad ELSE {odd} END")
    edit = met.groupBy("r", "c").agg(F.bool_or(F.expr("op = 'open'")).alias("o"), F.bool_or(F.expr("op = 'block'")).alias("b"))
    out = cells.join(edit, ["r", "c"], "left").selectExpr("r", "c", "(blocked AND NOT coalesce(o, false)) OR coalesce(b, false) AS blocked")
    if exits is None:
        return out
    free = exits.selectExpr(f"CAST(floor(y / {cell!r}D) AS INT) AS r", f"CAST(floor(x / {cell!r}D) AS INT) AS c").distinct()
    kept = out.join(free.withColumn("free", F.lit(True)), ["r", "c"], "left")
    return kept.select("r", "c", (F.col("blocked") & F.col("free").isNull()).alias("blocked"))


_MOVES = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
_STEPS = np.array([np.hypot(i, j) for i, j in _MOVES])


def walking_distance(blocked: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Cells walked from the nearest start to each free cell, over eight
    neighbours (corners may be cut); infinite where there is no way.  Only
    cells that came nearer in one round are looked at in the next."""
    rows, cols = blocked.shape
    closed = np.ones((rows + 2, cols + 2), bool)
    closed[1:-1, 1:-1] = blocked
    closed, width = closed.ravel(), cols + 2
    dist = np.full(closed.size, np.inf)
    begin = np.zeros((rows + 2, cols + 2), bool)
    begin[1:-1, 1:-1] = start & ~blocked
    active = np.flatnonzero(begin.ravel())
    dist[active] = 0
    while len(active):
        nearer = []
        for (i, j), step in zip(_MOVES, _STEPS):
            to = active + i * width + j
            far = dist[active] + step
            good = ~closed[to] & (far < dist[to] - 1e-12)
            np.minimum.at(dist, to[good], far[good])
            nearer.append(to[good])
        active = np.unique(np.concatenate(nearer))
    return dist.reshape(rows + 2, cols + 2)[1:-1, 1:-1]


def way_out(dist: np.ndarray, cell: tuple[int, int]) -> list[tuple[int, int]]:
    """The cells from ``cell`` to the nearest start: each step goes to the
    first neighbour that the distance comes from."""
    out = [cell]
    while dist[cell] > 0:
        for (i, j), step in zip(_MOVES, _STEPS):
            q = (cell[0] + i, cell[1] + j)
            if 0 <= q[0] < dist.shape[0] and 0 <= q[1] < dist.shape[1] and abs(dist[q] + step - dist[cell]) < 1e-6:
                cell = q
                break
        else:
            break
        out.append(cell)
    return out


def visible(blocked: np.ndarray, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether the straight row of cells from a to b is free; between two cells
    that touch at a corner it passes unless both others at it are walls."""
    (r, c), (r1, c1) = a, b
    far_r, far_c = abs(r1 - r), abs(c1 - c)
    go_r, go_c = (1 if r1 > r else -1), (1 if c1 > c else -1)
    lead = far_c - far_r
    while not blocked[r, c]:
        if (r, c) == (r1, c1):
            return True
        if r != r1 and c != c1 and blocked[r + go_r, c] and blocked[r, c + go_c]:
            return False
        twice = 2 * lead
        if twice > -far_r:
            lead -= far_r
            c += go_c
        if twice < far_c:
            lead += far_c
            r += go_r
    return False


def pulled(blocked: np.ndarray, path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The path's corners: from each, the farthest cell before the first one
    that it does not see."""
    out, at = path[:1], 0
    while at < len(path) - 1:
        to = at + 1
        while to + 1 < len(path) and visible(blocked, path[at], path[to + 1]):
            to += 1
        out.append(path[to])
        at = to
    return out


def nearest_open(blocked: np.ndarray, dist: np.ndarray, cell: tuple[int, int], reach: int) -> tuple[int, int] | None:
    """The first free cell with a way out that a search over eight neighbours
    meets, through walls too, no farther than ``reach`` cells."""
    rows, cols = blocked.shape
    first = (min(max(cell[0], 0), rows - 1), min(max(cell[1], 0), cols - 1))
    queue, seen = deque([first]), {first}
    while queue:
        r, c = queue.popleft()
        if max(abs(r - first[0]), abs(c - first[1])) > reach:
            continue
        if not blocked[r, c] and np.isfinite(dist[r, c]):
            return r, c
        for i, j in _SEARCH:
            q = (r + i, c + j)
            if 0 <= q[0] < rows and 0 <= q[1] < cols and q not in seen:
                seen.add(q)
                queue.append(q)
    return None


#: Order in which a search looks around: straight ways first.
_SEARCH = [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, 1), (1, -1), (-1, -1)]


def worst_cells(blocked: np.ndarray, dist: np.ndarray, n: int, apart: float, least: float) -> list[tuple[int, int]]:
    """Up to n cells of the longest ways out, at least ``apart`` cells from
    each other; with too few, all are picked anew at 0.7 of that, down to ``least``."""
    free = np.argwhere(np.isfinite(dist) & ~blocked)
    order = free[np.argsort(-dist[free[:, 0], free[:, 1]], kind="stable")] if len(free) else free
    picked: list[tuple[int, int]] = []
    while len(order) and len(picked) < n and apart > least:
        picked, left = [], order
        while len(left) and len(picked) < n:
            picked.append((int(left[0, 0]), int(left[0, 1])))
            left = left[np.hypot(*(left - left[0]).T) >= apart]
        apart *= 0.7
    return picked


def regions(blocked: np.ndarray) -> np.ndarray:
    """The number of each free cell's region over four neighbours, 0 in walls."""
    rows, cols = blocked.shape
    out = np.zeros((rows + 2, cols + 2), np.int64)
    open_ = np.zeros((rows + 2, cols + 2), bool)
    open_[1:-1, 1:-1] = ~blocked
    out, open_, width, number = out.ravel(), open_.ravel(), cols + 2, 0
    for seed in np.flatnonzero(open_).tolist():
        if out[seed]:
            continue
        number += 1
        out[seed] = number
        active = np.array([seed])
        while len(active):
            near = np.unique(np.concatenate([active + k for k in (1, -1, width, -width)]))
            active = near[open_[near] & (out[near] == 0)]
            out[active] = number
    return out.reshape(rows + 2, cols + 2)[1:-1, 1:-1]


def _grids(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    shape = (int(part.r.max()) + 1, int(part.c.max()) + 1)
    blocked, start = np.ones(shape, bool), np.zeros(shape, bool)
    blocked[part.r, part.c], start[part.r, part.c] = part.blocked, part.start
    return blocked, start


def evacuation_field(cells: DataFrame, cell: float) -> DataFrame:
    """floor_id, r, c and metres to the nearest start of free cells that reach
    one.  ``cells`` has floor_id, r, c, blocked and start.  A floor is one
    task, whose memory is bounded by its plan and not by observations."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        far = walking_distance(*_grids(part))[part.r, part.c] * cell
        return part.assign(distance=far)[np.isfinite(far)][["floor_id", "r", "c", "distance"]]

    return cells.groupBy("floor_id").applyInPandas(run, "floor_id string, r int, c int, distance double")


PATHS = "floor_id string, start_id long, status string, distance double, n_points int, points array<struct<x:double,y:double>>"


def evacuation_paths(cells: DataFrame, starts: DataFrame, cell: float, clearance: float, most: float) -> DataFrame:
    """The way out of each start (floor_id, start_id, x, y): pass or fail by
    its length against ``most``, with its corners; unreachable, or at_exit.
    Lengths are in the unit of ``cell``."""

    def run(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(part):
            blocked, start = _grids(part)
            dist = walking_distance(blocked, start)
            for s in asked.sort_values("start_id").itertuples():
                at = nearest_open(blocked, dist, (int(s.y // cell), int(s.x // cell)), math.ceil(3 * clearance / cell))
                path = way_out(dist, at) if at is not None else []
                if len(path) < 2:
                    out.append((s.floor_id, s.start_id, "unreachable" if at is None else "at_exit", None, 0, []))
                    continue
                corners = pulled(blocked, path)
                far = float(dist[at]) * cell
                points = [{"x": (c + 0.5) * cell, "y": (r + 0.5) * cell} for r, c in corners]
                out.append((s.floor_id, s.start_id, "pass" if far <= most else "fail", far, len(points), points))
        return pd.DataFrame(out, columns=["floor_id", "start_id", "status", "distance", "n_points", "points"])

    return cells.groupBy("floor_id").cogroup(starts.groupBy("floor_id")).applyInPandas(run, PATHS)


def worst_starts(cells: DataFrame, cell: float, n: int, apart: float, least: float) -> DataFrame:
    """Starts (floor_id, start_id, x, y) of the longest ways out, spread over
    the floor."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        blocked, start = _grids(part)
        found = worst_cells(blocked, walking_distance(blocked, start), n, apart / cell, least / cell)
        rows = [(part.floor_id.iloc[0], k, (c + 0.5) * cell, (r + 0.5) * cell) for k, (r, c) in enumerate(found)]
        return pd.DataFrame(rows, columns=["floor_id", "start_id", "x", "y"])

    return cells.groupBy("floor_id").applyInPandas(run, "floor_id string, start_id long, x double, y double")


def connectivity(cells: DataFrame) -> DataFrame:
    """Of each floor: regions of free cells and the largest one's share."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sizes = np.bincount(regions(_grids(part)[0]).ravel())[1:]
        share = float(sizes.max() / sizes.sum()) if len(sizes) else None
        return pd.DataFrame({"floor_id": [part.floor_id.iloc[0]], "regions": [len(sizes)], "largest": [share]})

    return cells.groupBy("floor_id").applyInPandas(run, "floor_id string, regions long, largest double")


def map_routes(paths: DataFrame, width: float, height: float, w_px: float, h_px: float, most: int = 60) -> DataFrame:
    """Routes on the map: about ``most`` evenly taken points and the last, in
    pixels with y downward, rounded to a tenth."""
    step = f"greatest(1, size(points) div {most})"
    thin = f"filter(points, (p, i) -> i % ({step}) = 0 OR i = size(points) - 1)"
    px = f"transform({thin}, p -> struct(round(p.x / {width!r}D * {w_px!r}D, 1) AS x, round(({height!r}D - p.y) / {height!r}D * {h_px!r}D, 1) AS y))"
    return paths.where("n_points >= 2").select(
        "floor_id", F.concat(F.lit("auto-evac-"), "start_id").alias("route_id"), F.expr(px).alias("points")
    )


def exit_lines(exits: DataFrame, width: float, height: float, least: float = 1500.0) -> DataFrame:
    """Exits (x1, y1, x2, y2) with a point inside: from the middle toward the
    plan's centre by ``least`` or a twentieth of its diagonal, or square to the
    line where the middle is the centre."""
    diag = (width**2 + height**2) ** 0.5
    mid = exits.withColumns({"mx": F.expr("(x1 + x2) / 2"), "my": F.expr("(y1 + y2) / 2")}).withColumns(
        {"dx": F.expr(f"{width / 2!r}D - mx"), "dy": F.expr(f"{height / 2!r}D - my")}
    )
    turned = mid.withColumn("centre", F.expr("sqrt(dx * dx + dy * dy) < 1e-6D")).withColumns(
        {"vx": F.expr("CASE WHEN centre THEN -(y2 - y1) ELSE dx END"), "vy": F.expr("CASE WHEN centre THEN x2 - x1 ELSE dy END")}
    )
    off = max(least, 0.05 * diag)
    norm = "coalesce(nullif(sqrt(vx * vx + vy * vy), 0D), 1D)"
    return turned.select(
        *exits.columns, F.expr(f"mx + vx / {norm} * {off!r}D").alias("inside_x"), F.expr(f"my + vy / {norm} * {off!r}D").alias("inside_y")
    )
