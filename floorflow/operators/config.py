"""Site and camera configuration as tables: patches, states, routes, versions.

Configuration is small; what it is joined to is not, so each function is a join
or an aggregate that leaves the choice of strategy to Spark.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def patch(config: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``config`` with the non-null values of ``changes``; columns that only
    ``changes`` has are ignored.  Any change to an unknown key fails the whole
    patch, and then nothing is changed."""
    bad = changes.join(config.select(key), key, "left_anti").agg(F.count("*").alias("unknown"))
    fields = [c for c in changes.columns if c != key and c in config.columns]
    joined = config.alias("a").join(changes.alias("b"), key, "left").join(F.broadcast(bad))
    def value(c):
        new = F.when(F.col("unknown") == 0, F.col(f"b.{c}"))
        return F.coalesce(new, F.col(f"a.{c}")).alias(c) if c in fields else F.col(f"a.{c}")

    return joined.select(*(F.col(key) if c == key else value(c) for c in config.columns))


def with_state(cameras: DataFrame, seen: DataFrame, now: Column, fresh_us: int = 10_000_000) -> DataFrame:
    """Cameras with fps and status: disabled, running (seen within the last
    ten seconds), reconnecting (seen before) or disconnected (never).
    ``seen``: cam_id, last_us, fps."""
    status = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("last_us").isNull(), "disconnected")
        .when(now - F.col("last_us") < fresh_us, "running")
        .otherwise("reconnecting")
    )
    live = status == "running"
    return cameras.join(seen, "cam_id", "left").select(
        *cameras.columns, status.alias("status"), F.when(live, F.coalesce("fps", F.lit(0.0))).otherwise(0.0).alias("fps")
    )


def floor_cameras(floors: DataFrame, cameras: DataFrame) -> DataFrame:
    """Cameras, enabled and mapped ones of each floor, floors without any too."""
    n = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias
    return (
        floors.join(cameras, "floor_id", "left").groupBy("floor_id").agg(
            F.count("cam_id").alias("cameras"), n(F.col("enabled"))("enabled"), n(F.col("mapped"))("mapped")
        )
    )


def next_ids(cameras: DataFrame, n: int) -> DataFrame:
    """The next ``n`` names cam%02d after the largest in use."""
    top = cameras.agg(F.coalesce(F.max(F.try_to_number(F.nullif(F.regexp_extract("cam_id", "^cam([0-9]+)$", 1), F.lit("")), F.lit("999999999"))), F.lit(0)).cast("int").alias("top"))
    ids = top.select(F.explode(F.sequence(F.col("top") + 1, F.col("top") + n)).alias("i"))
    return ids.select(F.when(F.col("i") < 100, F.format_string("cam%02d", "i")).otherwise(F.concat(F.lit("cam"), F.col("i").cast("string"))).alias("cam_id"))


def merge_routes(old: DataFrame, new: DataFrame, replace: bool = False, prefix: str = "auto-evac-") -> DataFrame:
    """New routes in place of all old ones, or of those named by the prefix."""
    kept = old.limit(0) if replace else old.where(~F.col("route_id").startswith(prefix))
    return kept.unionByName(new)


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The newest version of each key."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def saved(versions: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``changed`` as new versions, numbered one above each key's last."""
    last = versions.groupBy(key).agg(F.max("version").alias("last"))
    rows = changed.join(last, key, "left").withColumn("version", F.coalesce("last", F.lit(0).cast("long")) + 1)
    return rows.select(*versions.columns)


def live_or_stored(floors: DataFrame, live: DataFrame, stored: DataFrame) -> DataFrame:
    """Each floor's result: the live one, else the newest stored one.  ``live``:
    floor_id, result; ``stored``: floor_id, result, saved_us."""
    newest = latest(stored, "floor_id", "saved_us").select("floor_id", F.col("result").alias("old"))
    out = floors.join(live, "floor_id", "left").join(newest, "floor_id", "left")
    return out.select("floor_id", F.coalesce("result", "old").alias("result"), F.col("result").isNotNull().alias("is_live"))


def capped(rows: DataFrame, key: list[str], order: str, most: int = 7200) -> DataFrame:
    """The last ``most`` rows of each key, as a ring buffer keeps them."""
    by = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("back", F.row_number().over(by)).where(F.col("back") <= most).drop("back")


#: Millimetres of a drawing's unit codes (fixed values).
UNIT_MM = {1: 25.4, 2: 304.8, 4: 1.0, 5: 10.0, 6: 1000.0}


def unit_mm(code: str, default: float | None = None) -> Column:
    """Millimetres of a unit code; unknown and missing codes give ``default``,
    which is null unless a caller dares to guess."""
    table = F.create_map(*[F.lit(x) for pair in UNIT_MM.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(code)), F.lit(default).cast("double"))


def plausible(width_mm: Column, height_mm: Column) -> Column:
    """Whether the longer side of a plan is between 3 m and 3 km; null without
    a unit."""
    return F.greatest(width_mm, height_mm).between(3_000.0, 3_000_000.0)


def bounds(segments: DataFrame, header: DataFrame, key: str) -> DataFrame:
    """Extents of each drawing: the header's if they span more than one unit,
    else those of its segments."""
    box = segments.groupBy(key).agg(
        F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"),
    )
    good = F.coalesce((F.col("h.maxx") - F.col("h.minx") > 1) & (F.col("h.maxy") - F.col("h.miny") > 1), F.lit(False))
    both = box.alias("b").join(header.alias("h"), key, "full")
    return both.select(key, *(F.when(good, F.col(f"h.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


def map_scale(rows: DataFrame) -> DataFrame:
    """m_per_px: as given, else from two points and the metres between them;
    null where they coincide or are missing."""
    far = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return rows.withColumn("scale", F.coalesce("m_per_px", F.when(far > 0, F.col("meters") / far)))


def worker_stats(lines: DataFrame) -> DataFrame:
    """Numbers of the STATS lines of worker logs: cam_id, fps, drops."""
    found = lambda k, p: F.nullif(F.regexp_extract("value", rf"STATS .*{k}={p}", 1), F.lit(""))
    return lines.where(F.col("value").contains("STATS ")).select(
        found("cam", "([a-z0-9]+)").alias("cam_id"), found("fps", "([0-9.]+)").cast("double").alias("fps"), found("drop", "([0-9]+)").cast("long").alias("drops")
    )


def balanced(cameras: DataFrame, slots: int) -> DataFrame:
    """Slots for the cameras of each site: by descending rate and then id, each
    goes to the slot with the least load, of equals to the first.  A site's
    cameras are one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fps", "cam_id"], ascending=[False, True])
        heap, slot = [(0.0, k) for k in range(slots)], []
        for fps in rows["fps"]:
            load, k = heapq.heappop(heap)
            slot.append(k)
            heapq.heappush(heap, (load + fps, k))
        return rows.assign(slot=slot)[["site_id", "cam_id", "fps", "slot"]]

    return cameras.groupBy("site_id").applyInPandas(run, "site_id string, cam_id string, fps double, slot int")


def _sequential(frames: DataFrame, key: str, apart_us: int, run) -> DataFrame:
    """``run`` over each camera's frames in order.  Where two frames are so far
    apart that what comes before no longer matters, a new group begins."""
    by = Window.partitionBy(key).orderBy("ts_us", "event_id")
    far = F.when(F.col("ts_us") - F.lag("ts_us").over(by) > apart_us, 1).otherwise(0)
    split = frames.withColumn("far", far).withColumn("part", F.sum("far").over(by)).drop("far")

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts_us", "event_id"])
        return rows[run(rows["ts_us"].tolist())].drop(columns="part")

    return split.groupBy(key, "part").applyInPandas(task, frames.schema)


def rate_gate(frames: DataFrame, key: str, step_us: int) -> DataFrame:
    """Frames that a gate of one in ``step_us`` lets through: those at or after
    the due time, which then advances by the step, or starts anew from the frame
    where it would still lie behind it."""

    def run(times: list[int]) -> list[bool]:
        due, keep = None, []
        for t in times:
            passes = due is None or t >= due
            if passes:
                due = t + step_us if due is None or due + step_us < t else due + step_us
            keep.append(passes)
        return keep

    return _sequential(frames, key, 2 * step_us, run)


def sampled(frames: DataFrame, key: str, step_us: int) -> DataFrame:
    """The first frame, then each that is at least the step behind the last."""

    def run(times: list[int]) -> list[bool]:
        last, keep = None, []
        for t in times:
            keep.append(last is None or t - last >= step_us)
            last = t if keep[-1] else last
        return keep

    return _sequential(frames, key, step_us - 1, run)


#: What the automatic routes' ids begin with.
AUTO = "auto-evac-"


def floor_reset(
    elements: DataFrame, floor: str, routes: DataFrame | None = None, exits: DataFrame | None = None, replace: str = "auto",
    clear_zones: bool = False, clear_bottlenecks: bool = False,
) -> DataFrame:
    """Elements (floor_id, kind: route, exit, zone or bottleneck; id, body) with
    one floor set anew from a drawing: its automatic routes (``replace`` auto)
    or all of them are replaced by ``routes``, its exits by ``exits`` (id, body;
    None: left as they are), zones and bottlenecks cleared on demand.  Other
    floors are not touched."""
    if replace not in ("auto", "all"):
        raise ValueError("replace is auto or all")
    here, kind = F.col("floor_id") == floor, F.col("kind")
    goes = F.lit(False)
    if routes is not None:
        goes = goes | ((kind == "route") & (F.lit(replace == "all") | F.col("id").startswith(AUTO)))
    for name, on in (("exit", exits is not None), ("zone", clear_zones), ("bottleneck", clear_bottlenecks)):
        if on:
            goes = goes | (kind == name)
    out = elements.where(~(here & goes)).select("floor_id", "kind", "id", "body")
    for name, rows in (("route", routes), ("exit", exits)):
        if rows is not None:
            out = out.unionByName(rows.select(F.lit(floor).alias("floor_id"), F.lit(name).alias("kind"), "id", "body"))
    return out
