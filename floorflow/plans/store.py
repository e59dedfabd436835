"""Registered queries on the configuration store, real speeds, map bounds and
simulated truth, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as agr
from ..operators import calibration as cal
from ..operators import config
from ..sources import store
from ..streaming import live
from .agreement import _AG, _agents
from .evaluation import _read


def store_reset(spark, d):
    """A store that takes absent sites from a seed and has one brought back."""
    s = _read(spark, d, "supplier")
    body = lambda v: f"concat('{{\"id\":', s_suppkey, ',\"by\":\"{v}\"}}')"
    docs = lambda rows, v: rows.selectExpr(
        "concat('n', s_nationkey) AS site_id", "CASE WHEN s_suppkey = first THEN 'site' ELSE 'camera' END AS kind", "CASE WHEN s_suppkey = first THEN 'site' ELSE concat('c', s_suppkey) END AS name", f"{body(v)} AS body"
    )
    known = s.join(s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first")), "s_nationkey")
    root = live.fresh_folder(spark)
    store.commit(docs(known.where("s_nationkey % 2 = 0"), "own"), root)
    seed = docs(known.where("s_nationkey % 3 = 0 AND (s_suppkey % 2 = 0 OR s_suppkey = first)"), "seed")
    store.bootstrap(spark, root, seed)
    for site in ("n6", "n2"):  # n2 is not in the seed
        store.reset(spark, root, seed, site)
    return store.load(spark, root)


def floor_elements_reset(spark, d):
    """A floor's elements set anew from a drawing, the other floors untouched."""
    p = _read(spark, d, "part")
    now = p.selectExpr(
        "concat('f', p_size % 3) AS floor_id", "element_at(array('route', 'exit', 'zone', 'bottleneck'), CAST(p_partkey % 4 AS INT) + 1) AS kind",
        "concat(CASE WHEN p_partkey % 8 = 0 THEN 'auto-evac-' ELSE 'e' END, p_partkey) AS id", "p_name AS body",
    )
    fresh = _read(spark, d, "nation").selectExpr("concat('auto-evac-n', n_nationkey) AS id", "n_name AS body")
    return config.floor_reset(now, "f1", fresh.where("id < 'auto-evac-n2'"), fresh.selectExpr("concat('x', id) AS id", "body"), clear_zones=True)


def speed_units(spark, d):
    """Moves in km/h by projection or scale, or in pixels a second."""
    n = lambda v: f"CAST({v} AS DOUBLE)"
    rows = _read(spark, d, "orders").selectExpr(
        "o_orderkey", f"{n('o_orderkey % 640')} AS u0", f"{n('o_orderkey % 480')} AS v0", f"{n('o_custkey % 640')} AS u1", f"{n('o_custkey % 480')} AS v1",
        f"{n('o_orderkey % 5')} / 4 AS dt", f"CASE WHEN o_orderkey % 3 = 0 THEN array(0.02D, 0D, 1D, 0D, 0.03D, 2D, 0.0001D, 0.0002D, 1D) END AS h",
        "CASE WHEN o_orderkey % 2 = 0 THEN 0.5D END AS units_per_px", "CASE WHEN o_orderkey % 3 = 1 THEN 40D END AS px_per_m", "50D AS least_px",
    )
    return cal.real_speeds(rows).select("o_orderkey", F.round("speed", 6).alias("speed"), "unit")


def map_bounds(spark, d):
    rows = _read(spark, d, "customer").selectExpr(
        "concat('cam', c_custkey) AS cam_id", "CASE WHEN c_custkey % 4 = 0 THEN 1000 + c_nationkey END AS map_w", "CASE WHEN c_custkey % 4 = 0 THEN 700 END AS map_h",
        "CASE WHEN c_custkey % 3 > 0 THEN array(2D, 0D, CAST(c_nationkey AS DOUBLE), 0D, 3D, 1D, 0D, 0D, 2D) END AS h",
        "CASE WHEN c_custkey % 3 = 1 THEN array(named_struct('u', 10D, 'v', 20D), named_struct('u', CAST(c_custkey AS DOUBLE), 'v', 5D), named_struct('u', 30D, 'v', 90D)) END AS roi",
        "1920 AS width", "1080 AS height",
    )
    return cal.map_bounds(rows)


#: A triangle with a level edge, its area, and the line that agents leave by.
TRIANGLE, AREA, LINE = ((200.0, 100.0), (800.0, 100.0), (500.0, 900.0)), 24.0, ((500.0, 200.0), (500.0, 800.0))


def truth_frames(spark, d):
    c = agr.truth_counts(_agents(spark, d), TRIANGLE, AREA)
    return c.select("frame", "n", F.round("density", 6).alias("density"), F.round("speed", 6).alias("speed"))


def truth_digest(spark, d):
    return agr.truth_summary(_agents(spark, d), TRIANGLE, AREA, LINE)


# the triangle's legs: x between them, y from the level edge (included) up
_IN = "y >= 100 AND y < 900 AND x >= 200 + (y - 100) * 3 / 8 AND x < 800 - (y - 100) * 3 / 8"
_TF = f"tf AS (SELECT frame, count(*) FILTER (WHERE {_IN}) AS n, avg(speed) FILTER (WHERE {_IN}) AS v FROM ag GROUP BY frame)"
_H = "(0.0001e0 * {u} + 0.0002e0 * {v} + 1)"
QUERIES = {f.__name__: f for f in (store_reset, floor_elements_reset, speed_units, map_bounds, truth_frames, truth_digest)}
ORACLE = {
    "store_reset": """WITH k AS (SELECT *, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first FROM supplier)
SELECT 'n' || s_nationkey AS site_id, CASE WHEN s_suppkey = first THEN 'site' ELSE 'camera' END AS kind, CASE WHEN s_suppkey = first THEN 'site' ELSE 'c' || s_suppkey END AS name,
  '{"id":' || s_suppkey || ',"by":"' || CASE WHEN s_nationkey % 2 = 0 AND s_nationkey <> 6 THEN 'own' ELSE 'seed' END || '"}' AS body
FROM k WHERE (s_nationkey % 2 = 0 AND s_nationkey <> 6) OR (s_nationkey % 3 = 0 AND (s_suppkey % 2 = 0 OR s_suppkey = first))""",
    "floor_elements_reset": """WITH e AS (SELECT 'f' || (p_size % 3) AS floor_id, ['route', 'exit', 'zone', 'bottleneck'][p_partkey % 4 + 1] AS kind,
  CASE WHEN p_partkey % 8 = 0 THEN 'auto-evac-' ELSE 'e' END || p_partkey AS id, p_name AS body FROM part)
SELECT * FROM e WHERE floor_id <> 'f1' OR kind = 'bottleneck' OR (kind = 'route' AND NOT starts_with(id, 'auto-evac-'))
UNION ALL SELECT 'f1', 'route', 'auto-evac-n' || n_nationkey, n_name FROM nation WHERE 'auto-evac-n' || n_nationkey < 'auto-evac-n2'
UNION ALL SELECT 'f1', 'exit', 'xauto-evac-n' || n_nationkey, n_name FROM nation""",
    "speed_units": f"""WITH m AS (SELECT o_orderkey, o_orderkey % 640 AS a, o_orderkey % 480 AS b, o_custkey % 640 AS c, o_custkey % 480 AS e, (o_orderkey % 5) / 4 AS dt FROM orders),
p AS (SELECT *, sqrt((c - a) ** 2 + (e - b) ** 2) AS px, (0.02e0 * c + 1) / {_H.format(u='c', v='e')} - (0.02e0 * a + 1) / {_H.format(u='a', v='b')} AS dx,
  (0.03e0 * e + 2) / {_H.format(u='c', v='e')} - (0.03e0 * b + 2) / {_H.format(u='a', v='b')} AS dy FROM m)
SELECT o_orderkey, round(CASE WHEN dt = 0 OR px < 50 THEN 0 WHEN o_orderkey % 3 = 0 THEN sqrt(dx ** 2 + dy ** 2) * CASE WHEN o_orderkey % 2 = 0 THEN 0.5e0 ELSE 1 END / dt * 3.6e0
  WHEN o_orderkey % 3 = 1 THEN px / 40 / dt * 3.6e0 ELSE px / dt END, 6) AS speed, CASE WHEN o_orderkey % 3 < 2 THEN 'km/h' ELSE 'px/s' END AS unit FROM p""",
    "map_bounds": """SELECT 'cam' || c_custkey AS cam_id, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 0e0 WHEN c_custkey % 3 = 1 THEN least(10, c_custkey) + c_nationkey / 2 END AS x0,
  CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 0e0 WHEN c_custkey % 3 = 1 THEN 8e0 END AS y0,
  CASE WHEN c_custkey % 4 = 0 THEN 1000e0 + c_nationkey WHEN c_custkey % 3 = 0 THEN 1920e0 WHEN c_custkey % 3 = 1 THEN greatest(30, c_custkey) + c_nationkey / 2 END AS x1,
  CASE WHEN c_custkey % 4 = 0 THEN 700e0 WHEN c_custkey % 3 = 0 THEN 1080e0 WHEN c_custkey % 3 = 1 THEN 135.5e0 END AS y1 FROM customer""",
    "truth_frames": f"WITH {_AG}, {_TF} SELECT frame, n, round(n / 24, 6) AS density, round(v, 6) AS speed FROM tf",
    "truth_digest": f"""WITH {_AG}, {_TF},
sd AS (SELECT agent, frame, (x - 500) * 600 AS s, lag((x - 500) * 600) OVER (PARTITION BY agent ORDER BY frame) AS p, (y - 200) / 600 AS t FROM ag)
SELECT round(max(v), 3) AS peak_speed, max(n) AS peak_count, round(max(n) / 24, 3) AS peak_density, (SELECT count(DISTINCT agent) FROM sd WHERE p * s < 0 AND t BETWEEN -0.1 AND 1.1) AS unique_exits FROM tf""",
}
