"""Observations on the floor plan: filters, projection, kinematics, crossings.

Every session and floor has a clock, objects and elements of its own, so all
windows and groups start with KEY.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import homography, inside, line_distance, line_part, num, segment_distance2
from ..plans.site import Site

KEY = ["session_id", "floor_id"]
SECOND = 1_000_000


def _by_camera(site: Site, value) -> str:
    cases = " ".join(f"WHEN '{c.name}' THEN {value(c)}" for c in site.cameras)
    return f"CASE cam_id {cases} END"


def routed(tracks: DataFrame, site: Site) -> DataFrame:
    """``tracks`` with the floor that each camera belongs to."""
    names = [*(c.name for c in site.cameras), *(n for n, _ in site.unmapped)]
    cases = " ".join(f"WHEN '{n}' THEN '{site.floor_of(n)}'" for n in names)
    return tracks.withColumn("floor_id", F.expr(f"CASE cam_id {cases} ELSE '{site.floors[0]}' END"))


def mapped(tracks: DataFrame, site: Site) -> DataFrame:
    return tracks.where(F.col("cam_id").isin([c.name for c in site.cameras]))


def placed(tracks: DataFrame, site: Site) -> DataFrame:
    """Rows with x, y on the plan, in_roi and in_map, null for cameras that are
    not mapped."""
    x = _by_camera(site, lambda c: homography("u", "v", c.h)[0])
    y = _by_camera(site, lambda c: homography("u", "v", c.h)[1])
    roi = _by_camera(site, lambda c: inside("u", "v", c.region))
    return tracks.withColumns({"x": F.expr(x), "y": F.expr(y), "in_roi": F.expr(roi)}).withColumn(
        "in_map", F.expr(f"x BETWEEN 0e0 AND {num(site.width)} AND y BETWEEN 0e0 AND {num(site.height)}")
    )


def project(tracks: DataFrame, site: Site) -> DataFrame:
    """Rows of mapped cameras with x, y on the plan, in_roi and in_map."""
    return placed(mapped(tracks, site), site)


def is_confident(site: Site) -> str:
    least = _by_camera(site, lambda c: num(site.min_conf if c.min_conf is None else c.min_conf))
    return f"conf >= coalesce({least}, {num(site.min_conf)})"


def confident(tracks: DataFrame, site: Site) -> DataFrame:
    """Rows at or above their camera's threshold, else the site's."""
    return tracks.where(F.expr(is_confident(site)))


def sessions(tracks: DataFrame, site: Site) -> DataFrame:
    """Start and end of each session and floor: KEY, t0, t1."""
    return routed(tracks, site).groupBy(*KEY).agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))


def by_object(*more: str):
    return Window.partitionBy(*KEY, "gid", *more).orderBy("ts_us", "event_id")


def _with_clock(rows: DataFrame) -> DataFrame:
    """before_us: the time of the call before each row in its session and
    floor.  Calls are ordered within their second, and seconds among each
    other, so no task sorts a whole floor."""
    timed = rows.withColumn("sec", F.expr(f"ts_us div {SECOND}"))
    inside_second = Window.partitionBy(*KEY, "sec").orderBy("ts_us", "event_id")
    among = Window.partitionBy(*KEY).orderBy("sec")
    seconds = timed.groupBy(*KEY, "sec").agg(F.max("ts_us").alias("last")).withColumn("prior", F.lag("last").over(among))
    return (
        timed.withColumn("own", F.lag("ts_us").over(inside_second))
        .join(seconds.drop("last"), [*KEY, "sec"])
        .withColumn("before_us", F.coalesce("own", "prior"))
        .drop("own", "prior", "sec")
    )


def touched(tracks: DataFrame, site: Site) -> DataFrame:
    """Confident rows of mapped cameras, on or off their ROI, with

    * seg: how often the object was dropped before.  A row outside the ROI
      drops its object, and so does a call at which the object was unseen for
      longer than the lost timeout; history, dwell and sides start anew;
    * until: the object's next row here (ts_us, event_id), which ends what this
      row says of it.
    """
    rows = project(confident(_with_clock(mapped(routed(tracks, site), site)), site), site)
    w = by_object()
    last_in, last_us = F.lag("in_roi").over(w), F.lag("ts_us").over(w)
    dropped = F.col("in_roi") & last_in.isNotNull() & (~last_in | (F.col("before_us") - last_us > site.lost_us))
    marked = rows.withColumns({"fresh": F.when(dropped, 1).otherwise(0), "until": F.lead(F.struct("ts_us", "event_id")).over(w)})
    return marked.withColumn("seg", F.sum("fresh").over(w)).drop("fresh", "before_us")


def observed(tracks: DataFrame, site: Site) -> DataFrame:
    """What takes part in metrics: mapped, confident, inside the camera's ROI."""
    return touched(tracks, site).where("in_roi")


def kinematics(seen: DataFrame, site: Site) -> DataFrame:
    """Speed (m/s) and heading over the last window: from its first to its
    last row, 0 below the least movement and for a single row; no speed
    without a scale."""
    w = Window.partitionBy(*KEY, "gid", "seg").orderBy("ts_us").rangeBetween(-site.window_us, 0)
    first = F.min(F.struct("ts_us", "event_id", "x", "y")).over(w)
    ends = seen.withColumn("f", first).withColumns(
        {"dx": F.expr("x - f.x"), "dy": F.expr("y - f.y"), "dt": F.expr("(ts_us - f.ts_us) / 1e6")}
    )
    size = "sqrt(dx * dx + dy * dy)"
    scale = num(site.m_per_px)
    speed = f"CASE WHEN {scale} IS NULL THEN NULL WHEN dt <= 0e0 OR {size} * {scale} < {num(site.min_move_m)} THEN 0e0 ELSE {size} * {scale} / dt END"
    return ends.withColumns(
        {
            "speed": F.expr(speed),
            "hx": F.expr(f"CASE WHEN {size} > 1e-9 THEN dx / {size} ELSE 0e0 END"),
            "hy": F.expr(f"CASE WHEN {size} > 1e-9 THEN dy / {size} ELSE 0e0 END"),
        }
    ).drop("f", "dx", "dy", "dt")


def route_segments(site: Site) -> list[tuple[str, int, int, tuple, tuple]]:
    return [
        (route.floor, r, k, a, b)
        for r, route in enumerate(site.routes)
        for k, (a, b) in enumerate(zip(route.points, route.points[1:]))
    ]


def nearest_route(site: Site) -> str:
    """A struct (d2, route number, segment number, tx, ty) of the floor's
    nearest route segment; ties go to the first.  Null without routes."""
    cases = []
    for floor in site.floors:
        parts = []
        for f, r, k, a, b in route_segments(site):
            if f != floor:
                continue
            dx, dy = b[0] - a[0], b[1] - a[1]
            size = (dx * dx + dy * dy) ** 0.5 or 1.0
            parts.append(
                f"named_struct('d2', {segment_distance2('x', 'y', a, b)}, 'r', {r}, 'k', {k}, 'tx', {num(dx / size)}, 'ty', {num(dy / size)})"
            )
        if parts:
            cases.append(f"WHEN '{floor}' THEN array_min(array({', '.join(parts)}))")
    if not cases:
        return "CAST(NULL AS STRUCT<d2: DOUBLE, r: INT, k: INT, tx: DOUBLE, ty: DOUBLE>)"
    return f"CASE floor_id {' '.join(cases)} END"


def aligned(moving: DataFrame, site: Site) -> DataFrame:
    """align: heading along the nearest route segment, null without heading."""
    return moving.withColumn("near", F.expr(nearest_route(site))).withColumn(
        "align", F.expr("CASE WHEN hx = 0e0 AND hy = 0e0 THEN NULL ELSE hx * near.tx + hy * near.ty END")
    )


def on_floor(items, parts: list[str]) -> str:
    """An array of structs (one for each item) of the row's floor only."""
    if not items:
        return "array()"
    floors = sorted({i.floor for i in items})
    cases = " ".join(
        f"WHEN '{f}' THEN array({', '.join(p for i, p in zip(items, parts) if i.floor == f)})" for f in floors
    )
    return f"CASE floor_id {cases} END"


def all_crossings(seen: DataFrame, site: Site) -> DataFrame:
    """Rows at which an object is first on the other side of an exit's line,
    farther than the margin from it, near the exit; direction in or out.  All
    exits of a floor share one pass and one shuffle."""
    lines = [
        f"named_struct('exit_id', '{e.name}', 'd', {line_distance('x', 'y', e.a, e.b, e.within)}, 't', {line_part('x', 'y', e.a, e.b)})"
        for e in site.exits
    ]
    rows = seen.withColumn("e", F.explode(F.expr(on_floor(site.exits, lines))))
    clear = rows.select(*KEY, "gid", "seg", "event_id", "ts_us", "e.*").where(f"abs(d) >= {num(site.margin)}")
    w = by_object("seg", "exit_id")
    sided = clear.withColumn("side", F.expr("CASE WHEN d > 0e0 THEN 1 ELSE -1 END"))
    return (
        sided.withColumn("before", F.lag("side").over(w))
        .where("before <> side AND t BETWEEN -6e-2 AND 1.06e0")
        .select(*KEY, "exit_id", "gid", "event_id", "ts_us", F.expr("CASE WHEN side = 1 THEN 'in' ELSE 'out' END").alias("direction"))
    )


def snapshot(tracks: DataFrame, site: Site) -> DataFrame:
    """The last row of each object that is on its floor when the session's
    last mapped call has passed: neither outside the ROI nor lost by then."""
    rows = project(confident(mapped(routed(tracks, site), site), site), site)
    fields = F.struct("ts_us", "event_id", "x", "y", "conf", "in_roi", "in_map", "cam_id")
    last = rows.groupBy(*KEY, "gid").agg(F.max(fields).alias("s"), F.min("ts_us").alias("first_us")).select(*KEY, "gid", "first_us", "s.*")
    clock = mapped(routed(tracks, site), site).groupBy(*KEY).agg(F.max("ts_us").alias("now_us"))
    return last.where("in_roi").join(F.broadcast(clock), KEY).where(F.col("now_us") - F.col("ts_us") <= site.lost_us)


def counted(rows: DataFrame, base: DataFrame, site: Site, zones, key: list[str]) -> DataFrame:
    """Rows inside each zone of the row's floor, one pass over ``rows``: key,
    zone, n.  ``base`` has every key, whose zones count 0 without rows."""
    flags = [F.sum(F.expr(f"CASE WHEN {inside('x', 'y', z.polygon)} THEN 1 ELSE 0 END")).alias(z.name) for z in zones]
    wide = base.join(rows.groupBy(*key).agg(*flags), key, "left")
    pairs = on_floor(zones, [f"named_struct('zone', '{z.name}', 'n', coalesce({z.name}, 0L))" for z in zones])
    return wide.select(*base.columns, F.explode(F.expr(pairs)).alias("z")).select(*base.columns, "z.zone", "z.n")


def labelled(rows: DataFrame, zones) -> DataFrame:
    """zone: the first zone of the row's floor, in the site's order, that
    holds the row; null in none."""
    cases = " ".join(f"WHEN floor_id = '{z.floor}' AND {inside('x', 'y', z.polygon)} THEN '{z.name}'" for z in zones)
    return rows.withColumn("zone", F.expr(f"CASE {cases} END") if zones else F.lit(None).cast("string"))


def constant(zones, column: str, value) -> Column:
    """A column with a value of each zone by name."""
    cases = " ".join(f"WHEN '{z.name}' THEN {value(z)}" for z in zones)
    return F.expr(f"CASE {column} {cases} END")
