"""Registered queries on floor plans, box tables and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import routing
from ..sources.tracks import TRACKS_SQL, from_events
from ..streaming import live
from .evaluation import BOXES, MOT, _boxes, _mot, _read
from .site import SITE

#: Rows, columns and size of cells, and clearance from walls, of the plan.
ROWS, COLS, CELL, CLEAR = 100, 100, 10.0, 6.0
_PLAN = (ROWS, COLS, CELL)


def _walls(spark, d):
    k = "CAST(n_nationkey AS BIGINT)"
    return _read(spark, d, "nation").selectExpr(
        f"CAST(({k} * 379) % 1000 AS DOUBLE) AS ax", f"CAST(({k} * 617) % 1000 AS DOUBLE) AS ay",
        f"CAST(({k} * 379) % 1000 + ({k} * 71) % 400 - 200 AS DOUBLE) AS bx", f"CAST(({k} * 617) % 1000 + ({k} * 89) % 400 - 200 AS DOUBLE) AS by",
    )


def _exits(spark, d):
    return _read(spark, d, "region").selectExpr("r_regionkey * 2e2D + 5e0D AS x", "CAST(r_regionkey * 237 % 1000 AS DOUBLE) AS y")


def _shapes(spark, d):
    box = "array(r_regionkey * 15e1D, r_regionkey * 1e2D, r_regionkey * 15e1D + 3e2D, r_regionkey * 1e2D + 25e1D)"
    corner = "array(r_regionkey * 15e1D, r_regionkey * 1e2D, r_regionkey * 15e1D + 3e2D, r_regionkey * 1e2D, r_regionkey * 15e1D + 1e2D, r_regionkey * 1e2D + 25e1D)"
    shapes = _read(spark, d, "region").selectExpr(
        "CASE WHEN r_regionkey % 2 = 0 THEN 'open' ELSE 'block' END AS op", "element_at(array('rect', 'line', 'poly'), r_regionkey % 3 + 1) AS kind",
        f"CASE WHEN r_regionkey % 3 = 2 THEN {corner} ELSE {box} END AS pts", "6e1D AS w",
    )
    doors = spark.range(1).selectExpr("700D AS x1", "100D AS y1", "700D AS x2", "300D AS y2")
    return shapes.unionByName(routing.shapes_of(doors, 40.0))


def obstacle_grid(spark, d):
    return routing.obstacle_grid(_walls(spark, d), _exits(spark, d), *_PLAN, CLEAR)


def carve_open_block(spark, d):
    return routing.apply_shapes(obstacle_grid(spark, d), _shapes(spark, d), *_PLAN, _exits(spark, d))


def _floors(spark, d):
    """Two floors: walls as they are, and as edited."""
    start = _exits(spark, d).selectExpr(f"CAST(floor(y / {CELL}D) AS INT) AS r", f"CAST(floor(x / {CELL}D) AS INT) AS c").distinct()
    floors = obstacle_grid(spark, d).withColumn("floor_id", F.lit("f0")).unionByName(carve_open_block(spark, d).withColumn("floor_id", F.lit("f1")))
    return floors.join(start.withColumn("s", F.lit(True)), ["r", "c"], "left").withColumn("start", F.col("s").isNotNull()).drop("s")


def evac_routes(spark, d):
    """Metres to the nearest exit, with walls as they are and as edited."""
    return routing.evacuation_field(_floors(spark, d), CELL * SITE.m_per_px)


def evac_paths(spark, d):
    """Ways out of customers' places, in pixels of the plan."""
    places = _read(spark, d, "customer").where("c_custkey <= 60").selectExpr(
        "concat('f', c_custkey % 2) AS floor_id", "c_custkey AS start_id", "CAST(c_custkey * 137 % 1000 AS DOUBLE) AS x", "CAST(c_custkey * 71 % 1000 AS DOUBLE) AS y"
    )
    return routing.evacuation_paths(_floors(spark, d), places, CELL, CLEAR, 400.0)


def evac_worst_routes(spark, d):
    """The longest ways out of each floor, as routes on a map."""
    floors = _floors(spark, d)
    worst = routing.worst_starts(floors, CELL, 5, 150.0, 20.0)
    return routing.map_routes(routing.evacuation_paths(floors, worst, CELL, CLEAR, 400.0), COLS * CELL, ROWS * CELL, 800.0, 600.0)


def floor_connectivity(spark, d):
    return routing.connectivity(_floors(spark, d))


def exit_inside_points(spark, d):
    e = _read(spark, d, "nation").selectExpr(
        "n_nationkey AS exit_id", "CAST(n_nationkey * 379 % 1000 AS DOUBLE) AS x1", "CAST(n_nationkey * 617 % 1000 AS DOUBLE) AS y1",
        "CAST(n_nationkey * 379 % 1000 + 100 AS DOUBLE) AS x2", "CAST(n_nationkey * 617 % 1000 AS DOUBLE) AS y2",
    )
    out = routing.exit_lines(e, 1000.0, 1000.0, 15.0)
    return out.select("exit_id", F.round("inside_x", 6).alias("inside_x"), F.round("inside_y", 6).alias("inside_y"))


def target_filter(spark, d):
    """Boxes that are not too wide for a person and large enough."""
    return _boxes(spark, d).where("(x2 - x1) <= 16e-1D * (y2 - y1) AND (x2 - x1) * (y2 - y1) > 2e4D").select("cam_id", "frame", "det_id")


def central_velocity(spark, d):
    w = Window.partitionBy("seq", "id").orderBy("frame")
    side = lambda c, f: F.coalesce(f(c).over(w), F.col(c))
    span = side("frame", F.lead) - side("frame", F.lag)
    v = lambda c: F.round(F.when(span > 0, (side(c, F.lead) - side(c, F.lag)) / span).otherwise(F.lit(0.0)), 6)
    return _mot(spark, d).select("seq", "id", "frame", v("x").alias("vx"), v("y").alias("vy"))


def stream_visits(spark, d):
    return live.drain(live.visits(live.event_tracks(spark, f"{d}/events.parquet"), SITE.lost_us))


def stream_rates(spark, d):
    return live.drain(live.rates(live.event_tracks(spark, f"{d}/events.parquet")))


_CELLS = f"SELECT CAST(i // {COLS} AS INTEGER) AS r, CAST(i % {COLS} AS INTEGER) AS c, (i % {COLS} + 5e-1) * 1e1 AS cx, (i // {COLS} + 5e-1) * 1e1 AS cy FROM range({ROWS * COLS}) AS t(i)"
_GRID = f"""cells AS ({_CELLS}),
ex AS (SELECT DISTINCT CAST(floor((r_regionkey * 237 % 1000) / 1e1) AS INTEGER) AS r, CAST(floor((r_regionkey * 2e2 + 5e0) / 1e1) AS INTEGER) AS c FROM region),
wl AS (SELECT CAST(k * 379 % 1000 AS DOUBLE) AS ax, CAST(k * 617 % 1000 AS DOUBLE) AS ay, CAST(k * 71 % 400 - 200 AS DOUBLE) AS dx, CAST(k * 89 % 400 - 200 AS DOUBLE) AS dy FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)),
dw AS (SELECT r, c, cx, cy, ax, ay, dx, dy, least(1e0, greatest(0e0, coalesce(((cx - ax) * dx + (cy - ay) * dy) / nullif(dx * dx + dy * dy, 0e0), 0e0))) AS t FROM cells, wl),
hit AS (SELECT DISTINCT r, c FROM dw WHERE (cx - ax - t * dx) * (cx - ax - t * dx) + (cy - ay - t * dy) * (cy - ay - t * dy) < 36e0),
gr AS (SELECT r, c, cx, cy, (r, c) IN (SELECT (r, c) FROM hit) AND (r, c) NOT IN (SELECT (r, c) FROM ex) AS blocked FROM cells)"""
_SHAPED = """sp AS (SELECT r_regionkey % 2 AS blocks, r_regionkey % 3 AS kind, r_regionkey * 15e1 AS x1, r_regionkey * 1e2 AS y1, r_regionkey * 15e1 + 3e2 AS x2, r_regionkey * 1e2 + 25e1 AS y2, 30e0 AS half FROM region UNION ALL SELECT 0, 1, 7e2, 1e2, 7e2, 3e2, 2e1),
sx AS (SELECT r, c, cx, cy, sp.*, least(1e0, greatest(0e0, ((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM cells, sp),
sh AS (SELECT DISTINCT r, c, blocks FROM sx WHERE (kind = 0 AND c BETWEEN floor(x1 / 10) AND floor(x2 / 10) AND r BETWEEN floor(y1 / 10) AND floor(y2 / 10))
  OR (kind = 1 AND (cx - x1 - t * (x2 - x1)) * (cx - x1 - t * (x2 - x1)) + (cy - y1 - t * (y2 - y1)) * (cy - y1 - t * (y2 - y1)) < half * half)
  OR (kind = 2 AND cy > y1 AND cy < y2 AND cx > x1 + (cy - y1) / (y2 - y1) * 1e2 AND cx < x2 - (cy - y1) / (y2 - y1) * 2e2))"""
_SIDE = "coalesce({f}({c}) OVER w, {c})"


def _diff(c):
    return f"{_SIDE.format(f='lead', c=c)} - {_SIDE.format(f='lag', c=c)}"


ORACLE = {
    "obstacle_grid": f"WITH {_GRID} SELECT r, c, blocked FROM gr",
    "carve_open_block": f"WITH {_GRID}, {_SHAPED} SELECT r, c, ((blocked AND (r, c) NOT IN (SELECT (r, c) FROM sh WHERE blocks = 0)) OR (r, c) IN (SELECT (r, c) FROM sh WHERE blocks = 1)) AND (r, c) NOT IN (SELECT (r, c) FROM ex) AS blocked FROM gr",
    "exit_inside_points": "WITH e AS (SELECT n_nationkey AS exit_id, n_nationkey * 379 % 1000 + 50e0 AS mx, n_nationkey * 617 % 1000 + 0e0 AS my FROM nation), v AS (SELECT *, CASE WHEN mx = 500 AND my = 500 THEN 0e0 ELSE 500 - mx END AS vx, CASE WHEN mx = 500 AND my = 500 THEN 100e0 ELSE 500 - my END AS vy FROM e) SELECT exit_id, round(mx + vx / sqrt(vx * vx + vy * vy) * 50 * sqrt(2), 6) AS inside_x, round(my + vy / sqrt(vx * vx + vy * vy) * 50 * sqrt(2), 6) AS inside_y FROM v",
    "target_filter": f"WITH {BOXES} SELECT cam_id, frame, det_id FROM boxes WHERE (x2 - x1) <= 16e-1 * (y2 - y1) AND (x2 - x1) * (y2 - y1) > 2e4",
    "central_velocity": f"WITH {MOT}, cv AS (SELECT seq, id, frame, {_diff('frame')} AS span, {_diff('x')} AS gx, {_diff('y')} AS gy FROM mt WINDOW w AS (PARTITION BY seq, id ORDER BY frame)) SELECT seq, id, frame, round(CASE WHEN span > 0 THEN gx / span ELSE 0e0 END, 6) AS vx, round(CASE WHEN span > 0 THEN gy / span ELSE 0e0 END, 6) AS vy FROM cv",
    "stream_visits": f"WITH {TRACKS_SQL}, sg AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > {SITE.lost_us} THEN 1 ELSE 0 END AS fresh FROM tracks WINDOW w AS (PARTITION BY gid ORDER BY ts_us, event_id)), sh AS (SELECT *, sum(fresh) OVER (PARTITION BY gid ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM sg) SELECT gid, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM sh GROUP BY gid, seg",
    "stream_rates": f"WITH {TRACKS_SQL} SELECT cam_id, ts_us // 5000000 AS w, count(*) AS n FROM tracks GROUP BY 1, 2",
}

QUERIES = {f.__name__: f for f in (
    obstacle_grid, carve_open_block, evac_routes, evac_paths, evac_worst_routes, floor_connectivity, exit_inside_points, target_filter,
    central_velocity, stream_visits, stream_rates,
)}
