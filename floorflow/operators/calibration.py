"""Camera calibration from point pairs, and distances on a drawn graph.

A camera has a handful of pairs, a graph some thousand nodes: each is one
group.  Everything that follows from the result (errors, projected areas) is an
expression again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their middle and scaled to a mean distance of sqrt(2),
    and the matrix that does it."""
    middle = p.mean(axis=0)
    size = np.hypot(*(p - middle).T).mean()
    k = np.sqrt(2) / size if size > 0 else 1.0
    t = np.array([[k, 0, -k * middle[0]], [0, k, -k * middle[1]], [0, 0, 1]])
    return (p - middle) * k, t


def fit_plane(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """3 x 3 projection that takes ``src`` to ``dst``: the direct linear
    transform on scaled points, exact for four pairs and least squares beyond.
    None for fewer than four pairs, values that are not finite, and pairs that
    leave it open."""
    if len(src) < 4 or not (np.isfinite(src).all() and np.isfinite(dst).all()):
        return None
    (a, ta), (b, tb) = _scaled(src), _scaled(dst)
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    p = np.column_stack([a, one])
    rows = np.vstack([np.hstack([p, zero, -b[:, :1] * p]), np.hstack([zero, p, -b[:, 1:] * p])])
    _, s, vt = np.linalg.svd(rows)
    if s[7] < 1e-9 * s[0]:
        return None
    h = np.linalg.solve(tb, vt[-1].reshape(3, 3) @ ta)
    if abs(np.linalg.det(vt[-1].reshape(3, 3))) < 1e-12 or abs(h[2, 2]) < 1e-12 * np.abs(h).max():
        return None
    return h / h[2, 2]


def plane_fits(pairs: DataFrame) -> DataFrame:
    """The projection of each camera: cam_id, pairs, h (nine values by rows).
    ``pairs``: cam_id, u, v, x, y.  h is null where none can be fitted."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = fit_plane(rows[["u", "v"]].to_numpy(float), rows[["x", "y"]].to_numpy(float))
        value = None if h is None else h.ravel().tolist()
        return pd.DataFrame({"cam_id": [rows["cam_id"].iloc[0]], "pairs": [len(rows)], "h": [value]})

    narrow = pairs.where("cam_id IS NOT NULL").select("cam_id", "u", "v", "x", "y")
    return narrow.groupBy("cam_id").applyInPandas(run, "cam_id string, pairs long, h array<double>")


def projected(u: str, v: str, h: str = "h") -> tuple[Column, Column]:
    """x and y of a point by a column of nine values."""
    at = lambda i: f"{h}[{3 * i}] * {u} + {h}[{3 * i + 1}] * {v} + {h}[{3 * i + 2}]"
    return F.expr(f"({at(0)}) / ({at(2)})"), F.expr(f"({at(1)}) / ({at(2)})")


def fit_errors(pairs: DataFrame, fits: DataFrame) -> DataFrame:
    """Distance in map pixels between each pair's map point and where its
    camera point falls, to two places."""
    x, y = projected("u", "v")
    both = pairs.join(fits.where("h IS NOT NULL"), "cam_id")
    return both.select(*pairs.columns, F.round(F.hypot(x - F.col("x"), y - F.col("y")), 2).alias("error_px"))


def four_corners(rows: DataFrame) -> DataFrame:
    """Projection from an image quadrilateral to a rectangle of real size, and
    that size's area.  ``rows``: cam_id, corners (array of four structs u, v,
    from the top left on clockwise), width_m, height_m."""
    at = [("0D", "0D"), ("width_m", "0D"), ("width_m", "height_m"), ("0D", "height_m")]
    real = ", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in at)
    both = rows.select("cam_id", "corners", F.expr(f"array({real})").alias("real"))
    pairs = both.select("cam_id", F.explode(F.arrays_zip("corners", "real")).alias("p")).selectExpr(
        "cam_id", "p.corners.u AS u", "p.corners.v AS v", "p.real.x AS x", "p.real.y AS y"
    )
    areas = rows.select("cam_id", (F.col("width_m") * F.col("height_m")).alias("area_m2"))
    return plane_fits(pairs).join(areas, "cam_id")


def ground_area(polygon: str, h: str = "h") -> Column:
    """Area on the ground of an image polygon (an array of structs u, v)."""
    shape = F.transform(polygon, lambda p: F.struct(*_at(p, h)))
    nxt = F.concat(F.slice(shape, 2, F.greatest(F.size(shape) - 1, F.lit(0))), F.slice(shape, 1, 1))
    cross = F.zip_with(shape, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def _at(p: Column, h: str) -> tuple[Column, Column]:
    k = F.col(h)
    row = lambda i: k[3 * i] * p["u"] + k[3 * i + 1] * p["v"] + k[3 * i + 2]
    return (row(0) / row(2)).alias("x"), (row(1) / row(2)).alias("y")


def graph_distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Shortest way along edges from each source: graph_id, source, node_id,
    distance; what cannot be reached has no row.

    ``nodes``: graph_id, node_id, x, y; ``edges``: graph_id, a, b (both ways,
    as long as the straight line; one with an unknown end is left out);
    ``sources``: graph_id, node_id.  A drawn graph is one group."""
    here = nodes.select("graph_id", "node_id", "x", "y")
    end = lambda k: here.selectExpr("graph_id", f"node_id AS {k}", f"x AS {k}x", f"y AS {k}y")
    long = edges.select("graph_id", "a", "b").join(end("a"), ["graph_id", "a"]).join(end("b"), ["graph_id", "b"]).select(
        "graph_id", "a", "b", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("length")
    )
    both = long.unionByName(long.selectExpr("graph_id", "b AS a", "a AS b", "length"))
    start = sources.select("graph_id", "node_id").distinct().join(here.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")

    def run(links: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = pd.unique(pd.concat([links["a"], asked["node_id"]], ignore_index=True))
        place = pd.Series(range(len(names)), index=names)
        a, b, size = place[links["a"]].to_numpy(), place[links["b"]].to_numpy(), links["length"].to_numpy()
        out = []
        for source in asked["node_id"]:
            far = np.full(len(names), np.inf)
            far[place[source]] = 0.0
            for _ in range(len(names)):
                nearer = far.copy()
                np.minimum.at(nearer, b, far[a] + size)
                if np.array_equal(nearer, far):
                    break
                far = nearer
            reached = np.isfinite(far)
            graph = asked["graph_id"].iloc[0]
            out.append(pd.DataFrame({"graph_id": graph, "source": source, "node_id": names[reached], "distance": far[reached]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["graph_id", "source", "node_id", "distance"])

    kind = "graph_id string, source string, node_id string, distance double"
    return both.groupBy("graph_id").cogroup(start.groupBy("graph_id")).applyInPandas(run, kind)


def nearest_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``points`` (graph_id, x, y and more) with node_id, the nearest node of
    the graph, of equals the smallest id; null where the graph has none."""
    listed = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "x", "y")).alias("all"))
    near = "array_min(transform(all, n -> named_struct('d', hypot(n.x - x, n.y - y), 'id', n.node_id))).id"
    return points.join(listed, "graph_id", "left").select(*points.columns, F.expr(near).alias("node_id"))


def graph_or_straight(trips: DataFrame, nodes: DataFrame, edges: DataFrame, m_per_px: float | None) -> DataFrame:
    """Metres from an alarm's place to a zone: along the graph between the
    nodes nearest to both (the zone's own node, if it names one that exists),
    else in a straight line; null without a scale.

    ``trips``: graph_id, zone, ox, oy (place), zx, zy (zone's middle), node
    (the zone's own, or null)."""
    known = nodes.selectExpr("graph_id", "node_id AS node", "true AS found")
    own = trips.join(known, ["graph_id", "node"], "left")
    begin = nearest_nodes(own.withColumns({"x": F.col("ox"), "y": F.col("oy")}), nodes).withColumnRenamed("node_id", "source").drop("x", "y")
    end = nearest_nodes(begin.withColumns({"x": F.col("zx"), "y": F.col("zy")}), nodes).drop("x", "y")
    routes = end.withColumn("node_id", F.when(F.col("found"), F.col("node")).otherwise(F.col("node_id"))).drop("found")
    far = graph_distances(nodes, edges, routes.selectExpr("graph_id", "source AS node_id").where("node_id IS NOT NULL"))
    straight = F.hypot(F.col("ox") - F.col("zx"), F.col("oy") - F.col("zy"))
    metres = F.coalesce("distance", straight) * F.lit(m_per_px).cast("double")
    return routes.join(far, ["graph_id", "source", "node_id"], "left").select(*trips.columns, metres.alias("metres"), F.col("distance").isNotNull().alias("by_graph"))


def _on_ground(u: str, v: str, h: str) -> tuple[str, str]:
    row = lambda i: f"({h}[{3 * i}] * {u} + {h}[{3 * i + 1}] * {v} + {h}[{3 * i + 2}])"
    return f"{row(0)} / {row(2)}", f"{row(1)} / {row(2)}"


def real_speeds(moves: DataFrame) -> DataFrame:
    """``moves`` with speed and unit.  A move is the first and last pixel of a
    window (u0, v0, u1, v1; dt seconds) with its camera's calibration: h (array
    of nine, row by row; null: none), units_per_px of what it projects to (null:
    1), px_per_m, and least_px, below which nothing moves.  By the projection,
    else by the scale, in km/h; else in px/s."""
    (x0, y0), (x1, y1) = _on_ground("u0", "v0", "h"), _on_ground("u1", "v1", "h")
    px = "sqrt((u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0))"
    metres = f"sqrt(pow({x1} - ({x0}), 2) + pow({y1} - ({y0}), 2)) * coalesce(units_per_px, 1D)"
    speed = (
        f"CASE WHEN dt IS NULL OR dt <= 0 OR {px} < least_px THEN 0D WHEN h IS NOT NULL THEN {metres} / dt * 3.6D"
        f" WHEN px_per_m > 0 THEN {px} / px_per_m / dt * 3.6D ELSE {px} / dt END"
    )
    unit = F.when(F.col("h").isNotNull() | (F.coalesce("px_per_m", F.lit(0.0)) > 0), "km/h").otherwise("px/s")
    return moves.withColumns({"speed": F.expr(speed), "unit": unit})


def map_bounds(cameras: DataFrame) -> DataFrame:
    """cam_id and the rectangle x0, y0, x1, y1 that a camera's map shows: the
    map's size (map_w, map_h) if it has one, else its ROI (array of (u, v)) on
    the ground, nothing with a projection alone, and else its image (width,
    height)."""
    ground = "transform(roi, p -> named_struct('x', {}, 'y', {}))".format(*_on_ground("p.u", "p.v", "h"))
    shape = F.when(F.col("map_w").isNull() & F.col("h").isNotNull() & (F.size("roi") > 0), F.expr(ground))
    side = lambda ends, axis, low, image: (
        F.when(F.col("map_w").isNotNull(), F.lit(0.0) if low else F.col(f"map_{'w' if axis == 'x' else 'h'}").cast("double"))
        .when(F.col("shape").isNotNull(), ends(F.col(f"shape.{axis}")))
        .when(F.col("h").isNull(), F.lit(0.0) if low else F.col(image).cast("double"))
    )
    return cameras.withColumn("shape", shape).select(
        "cam_id", side(F.array_min, "x", True, "width").alias("x0"), side(F.array_min, "y", True, "height").alias("y0"),
        side(F.array_max, "x", False, "width").alias("x1"), side(F.array_max, "y", False, "height").alias("y1"),
    )
