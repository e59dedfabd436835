"""Registered queries on camera regions and ground planes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ground, hull, spatial
from .evaluation import _read

#: Cameras of the region queries; a third of them have a ROI of their own.
CAMERAS = 40


def _regions(spark, d):
    customer = _read(spark, d, "customer")
    pairs = customer.selectExpr(
        f"concat('k', c_custkey % {CAMERAS}) AS cam_id", "CAST((c_custkey * 7919) % 997 AS DOUBLE) AS x", "CAST((c_custkey * 10473) % 991 AS DOUBLE) AS y"
    )
    corner = lambda x, y: f"named_struct('x', {x}D, 'y', {y}D)"
    box = f"array({corner(100, 100)}, {corner(900, 200)}, {corner(800, 800)}, {corner(100, 700)})"
    cameras = customer.selectExpr(f"c_custkey % {CAMERAS} AS k").distinct().selectExpr("concat('k', k) AS cam_id", f"CASE WHEN k % 3 = 0 THEN {box} END AS roi")
    return hull.regions(cameras, pairs)


def camera_regions(spark, d):
    """Corners and area of each camera's region."""
    each = _regions(spark, d).withColumn("edges", spatial.ring(F.col("polygon")))
    return each.select("cam_id", F.size("polygon").alias("corners"), F.expr(spatial.ring_area("edges")).alias("area"))


def region_filter(spark, d):
    """Pixels inside and outside their camera's region."""
    seen = _read(spark, d, "events").selectExpr(
        "event_id", f"concat('k', user_id % {CAMERAS}) AS cam_id", "CAST((event_id * 7919) % 1000 AS DOUBLE) AS x", "CAST((event_id * 104729) % 1000 AS DOUBLE) AS y"
    )
    inside = spatial.containing(seen, _regions(spark, d), "cam_id").groupBy("cam_id").agg(F.count("*").alias("n_in"))
    return seen.groupBy("cam_id").agg(F.count("*").alias("n")).join(inside, "cam_id", "left").select(
        "cam_id", F.coalesce("n_in", F.lit(0)).alias("n_in"), (F.col("n") - F.coalesce("n_in", F.lit(0))).alias("n_out")
    )


#: Size of the depth images and the camera's focal length in them.
WIDTH, HEIGHT, TRUE_FOCAL = 160, 120, 100


def _scene(spark, d):
    """A depth image of each nation: pixels of its customers' orders show a
    tilted floor with a little noise, one in six something else; its suppliers
    stand on it."""
    orders = _read(spark, d, "orders").selectExpr("o_custkey % 25 AS image", f"o_orderkey * 7919 % {WIDTH} AS u", f"54 + o_orderkey * 10473 % {HEIGHT - 54} AS v", "o_orderkey AS k")
    once = orders.groupBy("image", "u", "v").agg(F.min("k").alias("k"))
    # the floor is 0.1 x + y + 0.3 z = 1 + image / 25
    slope = f"(0.1D * (u - {WIDTH // 2}) / {TRUE_FOCAL} + (v - {HEIGHT // 2}) / {TRUE_FOCAL}D)"
    depths = once.selectExpr(
        "image", "CAST(u AS INT) AS u", "CAST(v AS INT) AS v",
        f"CASE WHEN k % 6 = 0 THEN 0.5D + k % 7 ELSE (1 + image / 25D) / ({slope} + 0.3D) + (k % 11 - 5) * 0.002D END AS z",
    )
    people = _read(spark, d, "supplier").selectExpr(
        "s_nationkey AS image", "CAST(s_suppkey % 130 AS DOUBLE) AS x1", "CAST(s_suppkey % 130 + 8 AS DOUBLE) AS x2", "40D + s_suppkey % 30 AS y1", "80D + s_suppkey % 37 AS y2"
    )
    sizes = people.select("image").distinct().selectExpr("image", f"{WIDTH} AS width", f"{HEIGHT} AS height")
    return depths, people, sizes


def camera_focal(spark, d):
    depths, people, _ = _scene(spark, d)
    return ground.focal_lengths(depths, people).select("image", F.round("focal", 6).alias("focal"))


def ground_planes(spark, d):
    """Floor and projection of each image with the camera's known focal length."""
    depths, people, sizes = _scene(spark, d)
    focal = sizes.selectExpr("image", f"{TRUE_FOCAL}D AS focal")
    planes = ground.ground_planes(ground.floor_points(depths, people, sizes, focal))
    shown = ground.ground_projections(planes, sizes, focal)
    return planes.join(shown, "image").select("image", *(F.round(c, 4).alias(c) for c in ("nx", "ny", "nz", "d", "inlier", *(f"h{k}" for k in range(9)))))


_PAIRS = f"""pt AS (SELECT DISTINCT c_custkey % {CAMERAS} AS k, CAST((c_custkey * 7919) % 997 AS DOUBLE) AS x, CAST((c_custkey * 10473) % 991 AS DOUBLE) AS y FROM customer),
side AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bq, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 AS reach,
  (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) AS along FROM pt a JOIN pt b ON a.k = b.k AND (a.x <> b.x OR a.y <> b.y) JOIN pt c ON c.k = a.k),
rim AS (SELECT k, ax, ay, bx, bq FROM side WHERE k % 3 <> 0 GROUP BY ALL HAVING min(turn) >= 0 AND bool_and(turn > 0 OR along BETWEEN 0 AND reach)),
own(ax, ay, bx, bq) AS (VALUES (100e0, 100e0, 900e0, 200e0), (900e0, 200e0, 800e0, 800e0), (800e0, 800e0, 100e0, 700e0), (100e0, 700e0, 100e0, 100e0)),
edge AS (SELECT * FROM rim UNION ALL SELECT k, own.* FROM (SELECT DISTINCT k FROM pt WHERE k % 3 = 0), own)"""

QUERIES = {f.__name__: f for f in (camera_regions, region_filter, camera_focal, ground_planes)}
ORACLE = {
    "camera_regions": f"WITH {_PAIRS} SELECT 'k' || k AS cam_id, CAST(count(*) AS INTEGER) AS corners, abs(sum(ax * bq - bx * ay)) / 2 AS area FROM edge GROUP BY k",
    "region_filter": f"""WITH {_PAIRS}, ev AS (SELECT event_id, user_id % {CAMERAS} AS k, CAST((event_id * 7919) % 1000 AS DOUBLE) AS x, CAST((event_id * 104729) % 1000 AS DOUBLE) AS y FROM events),
ins AS (SELECT event_id, ev.k, bool_and((bx - ax) * (y - ay) - (bq - ay) * (x - ax) >= 0) AS is_in FROM ev JOIN edge ON edge.k = ev.k GROUP BY event_id, ev.k)
SELECT 'k' || k AS cam_id, count(*) FILTER (WHERE is_in) AS n_in, count(*) FILTER (WHERE NOT is_in) AS n_out FROM ins GROUP BY k""",
    "camera_focal": f"""WITH px AS (SELECT image, u, v, min(k) AS k FROM (SELECT o_custkey % 25 AS image, o_orderkey * 7919 % {WIDTH} AS u, 54 + o_orderkey * 10473 % {HEIGHT - 54} AS v, o_orderkey AS k FROM orders) GROUP BY ALL),
dp AS (SELECT image, u, v, CASE WHEN k % 6 = 0 THEN 0.5e0 + k % 7 ELSE (1 + image / 25e0) / (0.1e0 * (u - {WIDTH // 2}) / {TRUE_FOCAL} + (v - {HEIGHT // 2}) / {TRUE_FOCAL}e0 + 0.3e0) + (k % 11 - 5) * 0.002e0 END AS z FROM px),
pe AS (SELECT s_suppkey, s_nationkey AS image, 40 + s_suppkey % 37 - s_suppkey % 30 AS h, s_suppkey % 130 + 4 AS cx, 80e0 + s_suppkey % 37 AS y2 FROM supplier),
zs AS (SELECT s_suppkey, pe.image, h, median(z) AS z FROM pe JOIN dp ON dp.image = pe.image AND u >= greatest(0, cx - 6) AND u < cx + 6 AND v >= floor(y2 - 0.12e0 * h) AND v <= floor(y2) WHERE h >= 15 GROUP BY ALL)
SELECT image, round(median(h * z / 1.7e0), 6) AS focal FROM zs WHERE z > 0 GROUP BY image""",
}
