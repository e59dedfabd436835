"""Registered queries on calibration, graphs and drawings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators.config import bounds
from ..sources import drawings as dxf
from ..sources.tracks import TRACKS_SQL, from_events


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pairs(spark, d):
    """Camera points of suppliers and where a known projection puts them, the
    projection differing by nation."""
    u, v, k = "(s_suppkey * 7919 % 1000)", "(s_suppkey * 104729 % 997)", "s_nationkey"
    w = f"({u} * {k} * 1e-6D + {v} * 2e-5D + 1D)"
    return _read(spark, d, "supplier").selectExpr(
        "concat('cam', s_nationkey) AS cam_id", "s_suppkey AS pair", f"CAST({u} AS DOUBLE) AS u", f"CAST({v} AS DOUBLE) AS v",
        f"({u} * 1.1D + {v} * 0.05D + {k}) / {w} AS x", f"({v} * 0.9D - {u} * 0.02D + 3D) / {w} AS y",
    )


def calibration_fit(spark, d):
    """The fitted projection of each camera against the one that made its
    pairs; null where fewer than four pairs leave it open."""
    h = lambda i: F.round(F.col("h")[i], 6).alias(f"h{i}")
    return cal.plane_fits(_pairs(spark, d)).select("cam_id", "pairs", h(0), h(1), h(4), h(7))


def calibration_errors(spark, d):
    pairs = _pairs(spark, d)
    return cal.fit_errors(pairs, cal.plane_fits(pairs)).select("cam_id", "pair", F.abs("error_px").alias("error_px"))


def _quads(spark, d):
    return _read(spark, d, "customer").selectExpr(
        "concat('cam', c_custkey) AS cam_id", "2D + c_custkey % 9 AS width_m", "3D + c_custkey % 7 AS height_m",
        "transform(array(array(0, 0), array(1, 0), array(1, 1), array(0, 1)), c -> named_struct("
        "'u', 100D + 200D * c[0], 'v', 50D + (100D + c_custkey % 50) * c[1])) AS corners",
    )


def corner_projection(spark, d):
    """Projection of rectangular image regions of known size, and the ground
    area of each region measured through it."""
    fits = cal.four_corners(_quads(spark, d)).join(_quads(spark, d).select("cam_id", "corners"), "cam_id")
    return fits.select("cam_id", "area_m2", F.round(cal.ground_area("corners"), 6).alias("measured_m2"), F.round(F.col("h")[0], 9).alias("h0"), F.round(F.col("h")[4], 9).alias("h4"))


def _graph(spark, d):
    """Graph of each region: its nations on a line and a node apart."""
    n = _read(spark, d, "nation").selectExpr("concat('g', n_regionkey) AS graph_id", "n_nationkey AS k", "n_regionkey AS r")
    nodes = n.selectExpr("graph_id", "concat('n', k) AS node_id", "CAST(k * 10 AS DOUBLE) AS x", "CAST(r AS DOUBLE) AS y")
    pairs = n.alias("a").join(n.alias("b"), F.expr("a.graph_id = b.graph_id AND a.k < b.k AND (a.k + b.k) % 3 <> 0"))
    return nodes, pairs.selectExpr("a.graph_id AS graph_id", "concat('n', a.k) AS a", "concat('n', b.k) AS b")


def graph_ways(spark, d):
    """Shortest ways along each region's graph from its first node."""
    nodes, edges = _graph(spark, d)
    first = nodes.groupBy("graph_id").agg(F.min_by("node_id", "x").alias("node_id"))
    return cal.graph_distances(nodes, edges, first).withColumn("distance", F.round("distance", 6))


def graph_trips(spark, d):
    """Metres from alarms to zones by graph, or straight where it has no way."""
    nodes, edges = _graph(spark, d)
    trips = _read(spark, d, "supplier").selectExpr(
        "concat('g', s_suppkey % 7) AS graph_id", "concat('z', s_suppkey) AS zone", "CAST(s_nationkey * 9 AS DOUBLE) AS ox", "0D AS oy",
        "CAST(s_suppkey % 240 AS DOUBLE) AS zx", "1D AS zy", "CASE WHEN s_suppkey % 3 = 0 THEN concat('n', s_suppkey % 30) END AS node",
    )
    out = cal.graph_or_straight(trips, nodes, edges, 0.05)
    return out.select("zone", F.round("metres", 6).alias("metres"), "by_graph")


def projected_foot_points(spark, d):
    """Every observation through the projection fitted for its camera."""
    t = from_events(_read(spark, d, "events"))
    fits = cal.plane_fits(_pairs(spark, d)).where("h IS NOT NULL").select("cam_id", "h")
    x, y = cal.projected("u", "v")
    return t.join(fits, "cam_id").select("event_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def _tags(*pairs: str) -> str:
    """A text of tags: codes and SQL values by turns."""
    return "concat_ws('\\n', " + ", ".join(f"'{v}'" if i % 2 == 0 else v for i, v in enumerate(pairs)) + ")"


def _drawings(spark, d):
    """A drawing a nation: a line, a closed polyline, an exit and a path for
    each of its suppliers, an occupant pair for every fourth, and, for every
    other, a reference to a block, turned by 90 degrees and scaled by two, that
    holds a line, another block and a circle of radius 50."""
    k, x = "CAST(s_suppkey AS STRING)", "CAST(s_suppkey % 100 AS STRING)"
    line = lambda layer, handle: _tags("0", "'LINE'", "5", f"concat('{handle}', {k})", "8", f"'{layer}'", "10", x, "20", "'1'", "11", "'7.5'", "21", x)
    poly = lambda layer, handle, flag: _tags("0", "'LWPOLYLINE'", "5", f"concat('{handle}', {k})", "8", f"'{layer}'", "70", f"'{flag}'", "10", "'0'", "20", "'0'", "10", "'4'", "20", "'0'", "10", "'4'", "20", x)
    insert = _tags("0", "'INSERT'", "5", f"concat('I', {k})", "8", "'0'", "2", "'B'", "10", x, "20", "'10'", "41", "'2'", "42", "'2'", "50", "'90'")
    hatch = _tags("0", "'HATCH'", "8", "'walls'", "10", "'0'", "20", "'0'")
    one = (
        f"concat_ws('\\n', {line('walls', 'L')}, {poly('walls', 'P', 1)}, {line(dxf.EXIT, 'E')}, {hatch}, CASE WHEN s_suppkey % 3 = 0 THEN {poly(dxf.PASS, 'R', 0)} ELSE {poly(dxf.FAIL, 'R', 0)} END,"
        f" CASE WHEN s_suppkey % 4 = 0 THEN {line(dxf.OCCUPANT, 'O')} END, CASE WHEN s_suppkey % 2 = 0 THEN {insert} END)"
    )
    head = _tags("0", "'SECTION'", "2", "'HEADER'", "9", "'$EXTMIN'", "10", "'-1'", "20", "'-2'", "30", "'0'", "9", "'$EXTMAX'", "10", "CAST(s_nationkey AS STRING)", "20", "'50'", "0", "'ENDSEC'")
    blocks = _tags(
        "0", "'SECTION'", "2", "'BLOCKS'", "0", "'BLOCK'", "2", "'B'", "10", "'1'", "20", "'0'", "0", "'LINE'", "8", "'walls'", "10", "'1'", "20", "'0'", "11", "'3'", "21", "'0'",
        "0", "'INSERT'", "2", "'C'", "10", "'5'", "20", "'5'", "0", "'CIRCLE'", "8", "'walls'", "10", "'1'", "20", "'0'", "40", "'50'", "0", "'ENDBLK'",
        "0", "'BLOCK'", "2", "'C'", "10", "'0'", "20", "'0'", "0", "'POLYLINE'", "8", "'doors'", "70", "'0'", "0", "'VERTEX'", "10", "'0'", "20", "'0'", "0", "'VERTEX'", "10", "'0'", "20", "'2'", "0", "'SEQEND'",
        "0", "'ENDBLK'", "0", "'ENDSEC'", "0", "'SECTION'", "2", "'ENTITIES'",
    )
    rows = _read(spark, d, "supplier").selectExpr("s_nationkey", f"{one} AS t")
    text = rows.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("t"))
    return text.selectExpr("concat('d', s_nationkey) AS drawing", f"concat_ws('\\n', {head}, {blocks}, t, {_tags('0', chr(39) + 'ENDSEC' + chr(39), '0', chr(39) + 'EOF' + chr(39))}) AS value")


def drawing_walls(spark, d):
    """Walls of each drawing and layer: segments, their whole length, sums of
    their ends."""
    lying = dxf.placed(dxf.entities(_drawings(spark, d)))
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    whole = lambda c: F.round(F.sum(c), 3)
    total = lambda c: F.when(whole(c) == 0, 0.0).otherwise(whole(c))  # noqa: E731  # a sum of -0.0 is 0.0
    return dxf.segments(lying).groupBy("drawing", "handle", "layer").agg(
        F.count("*").alias("n"), total(size).alias("length"), total(F.col("x1") + F.col("x2")).alias("x"), total(F.col("y1") + F.col("y2")).alias("y")
    )


def drawing_marks(spark, d):
    return dxf.marks(dxf.placed(dxf.entities(_drawings(spark, d))))


def drawing_paths(spark, d):
    paths = dxf.reference_paths(dxf.entities(_drawings(spark, d)))
    return paths.select("drawing", "handle", "passes", F.size("points").alias("points"), F.expr("points[2].y").alias("y"))


def drawing_extents(spark, d):
    """Extents by the header where it spans more than a unit, else by walls."""
    texts = _drawings(spark, d)
    return bounds(dxf.segments(dxf.placed(dxf.entities(texts))), dxf.extents(texts), "drawing").select("drawing", *(F.round(c, 3).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


_PAIRS = "pairs AS (SELECT 'cam' || CAST(s_nationkey AS VARCHAR) AS cam_id, s_suppkey AS pair, s_nationkey AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)"
_GRAPH = """n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation),
e AS (SELECT a.r, a.k AS a, b.k AS b, abs(a.k - b.k) * 10e0 AS length FROM n a JOIN n b ON a.r = b.r AND a.k <> b.k AND (a.k + b.k) % 3 <> 0)"""
_WAYS = f"""{_GRAPH}, w AS (SELECT r, k AS source, k AS node, 0e0 AS d, 0 AS hops FROM n UNION SELECT w.r, w.source, e.b, w.d + e.length, hops + 1 FROM w JOIN e ON e.r = w.r AND e.a = w.node WHERE hops < 6),
s AS (SELECT r, source, node, min(d) AS d FROM w GROUP BY ALL)"""

_DRAWN = """s AS (SELECT 'd' || CAST(s_nationkey AS VARCHAR) AS drawing, s_nationkey AS nation, CAST(s_suppkey AS VARCHAR) AS k, s_suppkey AS i, CAST(s_suppkey % 100 AS DOUBLE) AS x FROM supplier),
ring AS (SELECT a AS j, 50 * cos(2 * pi() * a / 12) AS u, 50 * sin(2 * pi() * a / 12) AS v, 50 * cos(2 * pi() * (a + 1) / 12) AS u2, 50 * sin(2 * pi() * (a + 1) / 12) AS v2 FROM range(12) t(a)),
w AS (SELECT drawing, nation, 'L' || k AS handle, 'walls' AS layer, x AS x1, 1e0 AS y1, 7.5e0 AS x2, x AS y2 FROM s
 UNION ALL SELECT drawing, nation, 'P' || k, 'walls', 0, 0, 4, 0 FROM s UNION ALL SELECT drawing, nation, 'P' || k, 'walls', 4, 0, 4, x FROM s UNION ALL SELECT drawing, nation, 'P' || k, 'walls', 4, x, 0, 0 FROM s
 UNION ALL SELECT drawing, nation, 'I' || k, 'walls', x, 10, x, 14 FROM s WHERE i % 2 = 0
 UNION ALL SELECT drawing, nation, 'I' || k, 'doors', x - 10, 18, x - 14, 18 FROM s WHERE i % 2 = 0
 UNION ALL SELECT drawing, nation, 'I' || k, 'walls', x - 2 * v, 10 + 2 * u, x - 2 * v2, 10 + 2 * u2 FROM s, ring WHERE i % 2 = 0)"""

ORACLE = {
    "drawing_walls": f"WITH {_DRAWN} SELECT drawing, handle, layer, count(*) AS n, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 3) AS length, CASE WHEN round(sum(x1 + x2), 3) = 0 THEN 0e0 ELSE round(sum(x1 + x2), 3) END AS x, CASE WHEN round(sum(y1 + y2), 3) = 0 THEN 0e0 ELSE round(sum(y1 + y2), 3) END AS y FROM w GROUP BY 1, 2, 3",
    "drawing_marks": f"WITH {_DRAWN} SELECT drawing, 'exit' AS mark, (x + 7.5e0) / 2 AS x, (1 + x) / 2 AS y FROM s UNION ALL SELECT drawing, 'occupant', x, 1 FROM s WHERE i % 4 = 0 UNION ALL SELECT drawing, 'occupant', 7.5e0, x FROM s WHERE i % 4 = 0",
    "drawing_paths": f"WITH {_DRAWN} SELECT drawing, 'R' || k AS handle, i % 3 = 0 AS passes, 3 AS points, x AS y FROM s",
    "drawing_extents": f"WITH {_DRAWN} SELECT drawing, CASE WHEN nation > 0 THEN -1e0 ELSE round(min(least(x1, x2)), 3) END AS minx, CASE WHEN nation > 0 THEN -2e0 ELSE round(min(least(y1, y2)), 3) END AS miny, CASE WHEN nation > 0 THEN CAST(nation AS DOUBLE) ELSE round(max(greatest(x1, x2)), 3) END AS maxx, CASE WHEN nation > 0 THEN 50e0 ELSE round(max(greatest(y1, y2)), 3) END AS maxy FROM w GROUP BY drawing, nation",
    "calibration_fit": f"WITH {_PAIRS} SELECT cam_id, n AS pairs, CASE WHEN n > 3 THEN round(1.1e0, 6) END AS h0, CASE WHEN n > 3 THEN round(0.05e0, 6) END AS h1, CASE WHEN n > 3 THEN round(0.9e0, 6) END AS h4, CASE WHEN n > 3 THEN round(2e-5, 6) END AS h7 FROM pairs GROUP BY ALL",
    "calibration_errors": f"WITH {_PAIRS} SELECT cam_id, pair, 0e0 AS error_px FROM pairs WHERE n > 3",
    "corner_projection": "SELECT 'cam' || CAST(c_custkey AS VARCHAR) AS cam_id, (2e0 + c_custkey % 9) * (3 + c_custkey % 7) AS area_m2, round((2e0 + c_custkey % 9) * (3 + c_custkey % 7), 6) AS measured_m2, round((2e0 + c_custkey % 9) / 200, 9) AS h0, round((3e0 + c_custkey % 7) / (100 + c_custkey % 50), 9) AS h4 FROM customer",
    "graph_ways": f"WITH RECURSIVE {_WAYS} SELECT 'g' || CAST(r AS VARCHAR) AS graph_id, 'n' || CAST(source AS VARCHAR) AS source, 'n' || CAST(node AS VARCHAR) AS node_id, round(d, 6) AS distance FROM s WHERE source = (SELECT min(k) FROM n WHERE n.r = s.r)",
    "graph_trips": f"""WITH RECURSIVE {_WAYS},
t AS (SELECT s_suppkey AS z, s_suppkey % 7 AS g, s_nationkey * 9e0 AS ox, s_suppkey % 240 AS zx, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 30 END AS own FROM supplier),
q AS (SELECT *, (SELECT arg_min(k, struct_pack(d := sqrt((k * 10 - ox) * (k * 10 - ox) + r * r), i := 'n' || CAST(k AS VARCHAR))) FROM n WHERE r = g) AS source,
 coalesce((SELECT k FROM n WHERE r = g AND k = own), (SELECT arg_min(k, struct_pack(d := sqrt((k * 10 - zx) * (k * 10 - zx) + (r - 1) * (r - 1)), i := 'n' || CAST(k AS VARCHAR))) FROM n WHERE r = g)) AS target FROM t)
SELECT 'z' || CAST(z AS VARCHAR) AS zone, round(coalesce(d, sqrt((ox - zx) * (ox - zx) + 1)) * 0.05e0, 6) AS metres, d IS NOT NULL AS by_graph FROM q LEFT JOIN s ON s.r = g AND s.source = q.source AND s.node = q.target""",
    "projected_foot_points": f"WITH {TRACKS_SQL}, {_PAIRS}, c AS (SELECT DISTINCT cam_id, k FROM pairs WHERE n > 3) SELECT event_id, round((u * 1.1e0 + v * 0.05e0 + k) / (u * k * 1e-6 + v * 2e-5 + 1), 4) AS x, round((v * 0.9e0 - u * 0.02e0 + 3) / (u * k * 1e-6 + v * 2e-5 + 1), 4) AS y FROM tracks JOIN c USING (cam_id)",
}

QUERIES = {
    f.__name__: f
    for f in (calibration_fit, calibration_errors, corner_projection, graph_ways, graph_trips, projected_foot_points, drawing_walls, drawing_marks, drawing_paths, drawing_extents)
}
