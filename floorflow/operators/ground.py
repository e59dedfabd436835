"""Focal length and ground plane of an image from metric depths.

Depths are rows (image, u, v, z), people's boxes rows (image, x1, y1, x2, y2).
The plane is found by consensus: hypotheses through three points are rows, and
their followers an aggregate over all points of the image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import sent, written

#: Height of a standing person (m), a box's least height (px), half the width
#: and the part of the height of the patch at the feet (fixed values).
PERSON_M, LEAST_PX, HALF_PX, FOOT = 1.70, 15, 6, 0.12
#: The ground is looked for below this part of an image's height.
BELOW = 0.45
#: Points that hypotheses are drawn from, in the order of a seeded hash.
DRAWN = 1000


def focal_lengths(depths: DataFrame, people: DataFrame, height_m: float = PERSON_M) -> DataFrame:
    """image and focal (px): the median over people of a box's height times
    the median depth at its feet over a person's height.  Boxes under LEAST_PX,
    and those without a depth at their feet, say nothing; images without such
    boxes are left out.  A patch has few pixels, so boxes meet depths by pixel."""
    h = "(y2 - y1)"
    told = written(people.where(f"{h} >= {LEAST_PX}").withColumn("person", F.monotonically_increasing_id()))
    patch = told.select(
        "image", "person", F.expr(h).alias("h"),
        F.explode(F.expr(f"sequence(greatest(0, CAST(floor((x1 + x2) / 2) AS INT) - {HALF_PX}), greatest(0, CAST(floor((x1 + x2) / 2) AS INT) + {HALF_PX} - 1))")).alias("u"),
        F.expr(f"sequence(greatest(0, CAST(floor(y2 - {FOOT}D * {h}) AS INT)), greatest(0, CAST(floor(y2) AS INT)))").alias("vs"),
    ).select("image", "person", "h", "u", F.explode("vs").alias("v"))
    met = depths.where("z IS NOT NULL").join(patch, ["image", "u", "v"])
    each = met.groupBy("image", "person").agg(F.first("h").alias("h"), F.median("z").alias("z")).where("z > 0")
    return each.groupBy("image").agg(F.median(F.col("h") * F.col("z") / F.lit(height_m)).alias("focal"))


def floor_points(depths: DataFrame, people: DataFrame, sizes: DataFrame, focal: DataFrame) -> DataFrame:
    """image, x, y, z of the places (m) that lower pixels outside all boxes
    show.  ``sizes``: image, width, height."""
    camera = sizes.join(focal, "image")
    seen = depths.where("z > 0").join(sent(written(camera), F.lit(48)), "image").where(F.col("v") >= F.floor(F.col("height") * BELOW))
    # boxes meet pixels by row of pixels: a box has as many as it is high
    rows = people.select("image", F.expr("floor(x1)").alias("x1"), F.expr("floor(x2)").alias("x2"), F.explode(F.expr("sequence(greatest(0L, floor(y1)), greatest(0L, floor(y2) - 1))")).alias("v"))
    hidden = seen.join(rows, ["image", "v"]).where("u >= x1 AND u < x2").select("image", "u", "v").distinct()
    free = seen.join(hidden, ["image", "u", "v"], "left_anti")
    return free.selectExpr("image", "(u - width / 2D) * z / focal AS x", "(v - height / 2D) * z / focal AS y", "z")


def hypotheses(points: DataFrame, n: int, seed: int) -> DataFrame:
    """image, i, nx, ny, nz, d: ``n`` planes through three of DRAWN points."""
    h = F.xxhash64("x", "y", "z", F.lit(seed))
    many = points.groupBy("image").agg(F.count("*").alias("all")).where("all >= 50")
    share = (h / F.lit(2.0**64) + 0.5) * F.col("all") < 2 * DRAWN + 500
    order = Window.partitionBy("image").orderBy(h, "x", "y", "z")
    some = points.join(F.broadcast(many), "image").where(share).withColumn("k", F.row_number().over(order)).where(F.col("k") <= DRAWN)
    drawn = written(some.select("image", "k", F.struct("x", "y", "z").alias("p")))
    counts = drawn.groupBy("image").agg(F.count("*").alias("m"))
    tries = counts.select("image", "m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    for j in "abc":
        pick = F.pmod(F.xxhash64("i", F.lit(j), F.lit(seed)), F.col("m")) + 1
        tries = tries.withColumn("k", pick).join(drawn.withColumnRenamed("p", j), ["image", "k"]).drop("k")
    side = lambda p: {c: F.col(f"{p}.{c}") - F.col(f"a.{c}") for c in "xyz"}
    p, q = side("b"), side("c")
    cross = {"nx": p["y"] * q["z"] - p["z"] * q["y"], "ny": p["z"] * q["x"] - p["x"] * q["z"], "nz": p["x"] * q["y"] - p["y"] * q["x"]}
    sized = tries.withColumns(cross).withColumn("size", F.expr("sqrt(nx * nx + ny * ny + nz * nz)")).where("size >= 1e-9")
    unit = sized.withColumns({c: F.col(c) / F.col("size") for c in cross})
    return unit.withColumn("d", F.expr("nx * a.x + ny * a.y + nz * a.z")).select("image", "i", *cross, "d")


def ground_planes(points: DataFrame, near: float = 0.10, n: int = 300, seed: int = 0) -> DataFrame:
    """image, nx, ny, nz, d, inlier: the plane (n . p = d, unit normal with a
    positive d) that most points are within ``near`` metres of, set through all
    of those by least squares, and their share.  Of equally followed
    hypotheses the first counts.  Images with under 50 points are left out."""
    points = written(points)
    tried = written(hypotheses(points, n, seed).groupBy("image").agg(F.collect_list(F.struct("i", "nx", "ny", "nz", "d")).alias("tries")))
    # at most n planes an image, so they go to the points and only counts come back
    each = points.join(sent(tried, 64 + 40 * F.size("tries")), "image").select("image", "x", "y", "z", F.explode("tries").alias("t"))
    follows = F.expr(f"abs(x * t.nx + y * t.ny + z * t.nz - t.d) < {near}D").cast("bigint")
    votes = each.groupBy("image", "t").agg(F.sum(follows).alias("votes"))
    best = written(votes.groupBy("image").agg(F.max(F.struct("votes", (-F.col("t.i")).alias("o"), "t")).alias("b")).select("image", "b.t"))
    inside = points.join(F.broadcast(best), "image")
    sums = [F.sum(F.expr(f"CASE WHEN {{}} THEN {v} END".format(f"abs(x * t.nx + y * t.ny + z * t.nz - t.d) < {near}D"))).alias(c) for c, v in _MOMENTS.items()]
    moments = inside.groupBy("image").agg(*sums, F.count("*").alias("n_all"))
    kind = points.schema["image"].dataType.simpleString()
    return moments.mapInPandas(_refit, f"image {kind}, nx double, ny double, nz double, d double, inlier double")


_MOMENTS = {"m": "1D", **{c: c for c in "xyz"}, **{a + b: f"{a} * {b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}}


def _refit(batches):
    """The least axis of the scatter of each image's followers."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            mean = np.array([r.x, r.y, r.z]) / r.m
            whole = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]]) / r.m
            normal = np.linalg.eigh(whole - np.outer(mean, mean))[1][:, 0]
            d = float(normal @ mean)
            if d < 0:
                normal, d = -normal, -d
            out.append((r.image, *map(float, normal), d, r.m / r.n_all))
        yield pd.DataFrame(out, columns=["image", "nx", "ny", "nz", "d", "inlier"])


def ground_projections(planes: DataFrame, sizes: DataFrame, focal: DataFrame) -> DataFrame:
    """image and h0..h8 (h8 = 1): the projection of pixels to metres on the
    ground.  Its first axis is normal to the image's first axis, or to the
    second where the plane faces the first."""
    flat = planes.join(sizes, "image").join(focal, "image").withColumn("turned", F.abs("nx") > 0.9)
    # u axis: n x (1, 0, 0) or n x (0, 1, 0); v axis: n x u
    axis = {"ux": "CASE WHEN turned THEN -nz ELSE 0D END", "uy": "CASE WHEN turned THEN 0D ELSE nz END", "uz": "CASE WHEN turned THEN nx ELSE -ny END"}
    flat = flat.withColumns({k: F.expr(v) for k, v in axis.items()}).withColumn("s", F.expr("sqrt(ux * ux + uy * uy + uz * uz)"))
    flat = flat.withColumns({k: F.col(k) / F.col("s") for k in axis})
    flat = flat.withColumns({"vx": F.expr("ny * uz - nz * uy"), "vy": F.expr("nz * ux - nx * uz"), "vz": F.expr("nx * uy - ny * ux")})
    rows = []
    for name, scale in (("u", "d * "), ("v", "d * "), ("n", "")):
        rows += [f"{scale}{name}x / focal", f"{scale}{name}y / focal", f"{scale}({name}z - ({name}x * width + {name}y * height) / (2D * focal))"]
    return flat.select("image", *(F.expr(f"({r}) / ({rows[8]})").alias(f"h{k}") for k, r in enumerate(rows)))
