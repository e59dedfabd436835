"""Sessions started and stopped by commands, and exit counts over versions of
their lines: state machines whose state is a window function of the rows before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import sent


def decided(commands: DataFrame) -> DataFrame:
    """Commands (floor_id, at_us, n, command: start, stop or reset) with
    accepted and epoch.  A start is turned down while a session runs, a stop
    while none does; a reset always passes.  After a start, turned down or
    not, a session runs, and after a stop none does, so the command before
    decides.  ``epoch`` counts what clears counters and histories: accepted
    starts and resets.  Equal times go by ``n``; other commands and those
    without a floor, time or command are dropped."""
    known = commands.where("floor_id IS NOT NULL AND at_us IS NOT NULL AND command IN ('start', 'stop', 'reset')")
    by = Window.partitionBy("floor_id").orderBy("at_us", "n")
    before = F.last(F.when(F.col("command") != "reset", F.col("command")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    running = F.coalesce(before == "start", F.lit(False))
    passes = F.when(F.col("command") == "start", ~running).when(F.col("command") == "stop", running).otherwise(F.lit(True))
    clears = (F.col("accepted") & (F.col("command") != "stop")).cast("int")
    return known.withColumn("accepted", passes).withColumn("epoch", F.sum(clears).over(by).cast("bigint"))


def session_spans(commands: DataFrame) -> DataFrame:
    """floor_id, session_id, start_us and stop_us (null while it runs) of each
    accepted start."""
    pairs = decided(commands).where("accepted AND command <> 'reset'")
    by = Window.partitionBy("floor_id").orderBy("at_us", "n")
    name = F.concat(F.lit("sess-"), F.expr("CAST(bround(at_us / 1e3) AS BIGINT)").cast("string"))
    return (
        pairs.withColumn("stop_us", F.lead("at_us").over(by)).where("command = 'start'")
        .select("floor_id", name.alias("session_id"), F.col("at_us").alias("start_us"), "stop_us")
    )


def line_versions(versions: DataFrame) -> DataFrame:
    """Versions of exit lines (floor_id, exit_id, from_us, ax, ay, bx, by, ix,
    iy; null ax: the exit is taken out) with until_us, run and era.  A new
    ``run`` begins where the geometry changes, a new ``era`` after a removal."""
    by = Window.partitionBy("floor_id", "exit_id").orderBy("from_us")
    shape = F.struct("ax", "ay", "bx", "by", "ix", "iy")
    kept = shape.eqNullSafe(F.lag(shape).over(by))
    return versions.withColumns({
        "until_us": F.lead("from_us").over(by),
        "run": F.sum(F.when(kept, 0).otherwise(1)).over(by),
        "era": F.sum(F.when(F.col("ax").isNull(), 1).otherwise(0)).over(by),
    })


def clear_sides(seen: DataFrame, spans: DataFrame, margin: float) -> DataFrame:
    """Observations with the side of each line valid at their time, but for
    those nearer to it than the margin: floor_id, exit_id, era, run, gid, seg,
    ts_us, n, t (part of the line), side.  Lines of no length have no sides.
    ``spans``: versions with until_us, run and era; they go to the rows if
    their measured size allows it, and are met by floor otherwise."""
    lines = spans.where("ax IS NOT NULL AND (ax <> bx OR ay <> by)").withColumnRenamed("floor_id", "f")
    on = "floor_id = f AND ts_us >= from_us AND (until_us IS NULL OR ts_us < until_us)"
    cross = "((bx - ax) * ({y} - ay) - (by - ay) * ({x} - ax))"
    size2 = "((bx - ax) * (bx - ax) + (by - ay) * (by - ay))"
    toward = f"CASE WHEN {cross.format(x='ix', y='iy')} >= 0e0 THEN 1e0 ELSE -1e0 END"
    return (
        seen.join(sent(lines, F.lit(150)), F.expr(on))
        .withColumn("d", F.expr(f"{toward} * {cross.format(x='x', y='y')} / sqrt({size2})"))
        .withColumn("t", F.expr(f"((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / {size2}"))
        .where(F.abs("d") >= margin)
        .withColumn("side", F.expr("CASE WHEN d > 0e0 THEN 1 ELSE -1 END"))
    )


def flips(clear: DataFrame) -> DataFrame:
    """Where an object is on another side of the same line than before, near
    the line: floor_id, exit_id, era, gid, ts_us, direction."""
    by = Window.partitionBy("floor_id", "exit_id", "run", "gid", "seg").orderBy("ts_us", "n")
    return (
        clear.withColumn("before", F.lag("side").over(by))
        .where("before <> side AND t BETWEEN -6e-2 AND 1.06e0")
        .select("floor_id", "exit_id", "era", "gid", "ts_us", F.expr("CASE WHEN side = 1 THEN 'in' ELSE 'out' END").alias("direction"))
    )


def reloaded_crossings(seen: DataFrame, versions: DataFrame, margin: float) -> DataFrame:
    """Crossings of the line valid at each observation.  ``seen``: floor_id,
    gid, seg, ts_us, n (order of equal times), x, y.  An object's side outlives
    a version of the same geometry and is forgotten at one of another; rows
    nearer to the line than the margin leave it as it was."""
    return flips(clear_sides(seen, line_versions(versions), margin))


def reloaded_counts(seen: DataFrame, versions: DataFrame, margin: float) -> DataFrame:
    """Objects that passed each exit, once a direction; counts go on over new
    versions and end at a removal."""
    n = lambda way: F.sum((F.col("direction") == way).cast("bigint")).alias(f"{way}_count")
    once = reloaded_crossings(seen, versions, margin).select("floor_id", "exit_id", "era", "gid", "direction").distinct()
    return once.groupBy("floor_id", "exit_id", "era").agg(n("in"), n("out"))


def drill_starts(requests: DataFrame, floors: list[str], spans: DataFrame) -> DataFrame:
    """Requests to start a drill on all floors that take part, and whether they
    pass.  ``requests``: n, at_us, alarm_us (null: at once), origins (array of
    floors with an origin of the alarm).  ``spans``: floor_id, start_us,
    stop_us of sessions (null: still running).  Returns n, accepted, reason
    (``no_floors``, ``no_origin`` or ``busy``), floors (those that stand in the
    way, in the site's order) and the shared alarm_us of those accepted."""
    every = F.array(*map(F.lit, floors)).cast("array<string>")
    lacking = F.filter(every, lambda f: ~F.coalesce(F.array_contains(F.coalesce("origins", F.array().cast("array<string>")), f), F.lit(False)))
    known = requests.select("n", "at_us", F.coalesce("alarm_us", "at_us").alias("alarm_us"), lacking.alias("lacking"))
    lasting = spans.where(F.col("floor_id").isin(floors)).select("floor_id", "start_us", F.coalesce("stop_us", F.lit(2**62)).alias("ends"))
    # a floor is busy when the latest end of the spans begun so far is still to come: those of a request's own stretch
    # of time in their order, those of earlier stretches by their latest end
    ends = known.agg(F.min("at_us").alias("first"), F.max("at_us").alias("last")).first()
    stretch = max(1, ((ends.last or 0) - (ends.first or 0)) // 1000)
    asked = known.where("at_us IS NOT NULL").select(F.explode(every).alias("floor_id"), F.col("at_us").alias("t"), "n", F.lit(None).cast("bigint").alias("ends"))
    begun = lasting.where("start_us IS NOT NULL").select("floor_id", F.col("start_us").alias("t"), F.lit(None).cast(known.schema["n"].dataType).alias("n"), "ends")
    line = begun.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1))).withColumn("m", F.expr(f"t div {stretch}"))
    earlier = Window.partitionBy("floor_id").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.groupBy("floor_id", "m").agg(F.max("ends").alias("ends")).select("floor_id", "m", F.max("ends").over(earlier).alias("carried"))
    so_far = Window.partitionBy("floor_id", "m").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.withColumn("latest", F.max("ends").over(so_far)).where("asks = 1").join(carried, ["floor_id", "m"], "left")
    busy = met.where("greatest(latest, carried) > t").groupBy("n").agg(F.collect_set("floor_id").alias("held"))
    both = known.join(busy, "n", "left").withColumn("held", F.filter(every, lambda f: F.coalesce(F.array_contains("held", f), F.lit(False))))
    reason = F.when(F.size(every) == 0, "no_floors").when(F.size("lacking") > 0, "no_origin").when(F.size("held") > 0, "busy")
    out = both.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    way = F.when(F.col("reason") == "no_origin", F.col("lacking")).when(F.col("reason") == "busy", F.col("held"))
    return out.select("n", "accepted", "reason", F.array_join(F.coalesce(way, F.array().cast("array<string>")), ",").alias("floors"), F.when(F.col("accepted"), F.col("alarm_us")).alias("alarm_us"))
