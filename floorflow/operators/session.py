"""An evaluation session: tick states, congestion, response, fidelity, exits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import centroid, even_odd, inside, num, segment_distance2
from ..plans.site import Site
from .observations import (
    KEY, aligned, all_crossings, by_object, confident, constant, counted, kinematics, mapped, nearest_route, on_floor, project,
    route_segments, routed, sessions,
)

TICK = 1_000_000


def ticks(tracks: DataFrame, site: Site) -> DataFrame:
    """The samples of each session and floor: every second after its start and
    what is left at its end.  KEY, k, tick_us, t0, dt (seconds since the sample
    before) and the call (c: ts_us, event_id) whose state is sampled, the first
    at or after the tick or else the last one."""
    span = sessions(tracks, site)
    calls = mapped(routed(tracks, site), site).select(*KEY, "ts_us", "event_id")
    length = f"(t1 - t0) div {TICK}"
    whole = span.select("*", F.explode(F.expr(f"sequence(1L, {length} + if((t1 - t0) % {TICK} > 0, 1L, 0L))")).alias("k")).where("t1 > t0")
    grid = whole.withColumn("tick_us", F.least("t1", F.col("t0") + F.col("k") * TICK))
    first = (
        calls.join(F.broadcast(span.select(*KEY, "t0")), KEY)
        .groupBy(*KEY, F.expr(f"(ts_us - t0) div {TICK}").alias("k"))
        .agg(F.min(F.struct("ts_us", "event_id")).alias("own"), F.max(F.struct("ts_us", "event_id")).alias("last"))
    )
    ends = first.groupBy(*KEY).agg(F.max("last").alias("last"))
    later = Window.partitionBy(*KEY).orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    found = grid.join(first.drop("last"), [*KEY, "k"], "left").join(F.broadcast(ends), KEY)
    asked = F.when(F.col("tick_us") == F.col("t0") + F.col("k") * TICK, F.min("own").over(later))
    return found.select(
        *KEY, "k", "tick_us", "t0", F.coalesce(asked, "last").alias("c"),
        ((F.col("tick_us") - F.col("t0") - (F.col("k") - 1) * TICK) / F.lit(1e6)).alias("dt"),
    )


def tick_states(rows: DataFrame, grid: DataFrame, site: Site) -> DataFrame:
    """The row of each object that holds at each tick: its last at the tick's
    call, if not dropped or lost by then.  A row meets the seconds from itself
    to its object's next row or the lost timeout only."""
    ends = f"least(coalesce(until.ts_us, ts_us + {site.lost_us}), ts_us + {site.lost_us})"
    spread = rows.withColumn("b", F.explode(F.expr(f"sequence(ts_us div {TICK}, {ends} div {TICK})")))
    asked = grid.select(*KEY, "k", "tick_us", "t0", "c", F.expr(f"c.ts_us div {TICK}").alias("b"))
    here = F.struct("ts_us", "event_id")
    return (
        spread.join(asked, [*KEY, "b"])
        .where((here <= F.col("c")) & (F.col("until").isNull() | (F.col("until") > F.col("c"))))
        .where(F.col("c.ts_us") - F.col("ts_us") <= site.lost_us)
        .drop("b", "c", "until")
    )


def tick_counts(states: DataFrame, grid: DataFrame, site: Site, zones) -> DataFrame:
    """n of each zone at each tick, zeros included: KEY, k, tick_us, t0, dt, zone, n."""
    return counted(states, grid.drop("c"), site, zones, [*KEY, "k"])


def with_density(counts: DataFrame, site: Site) -> DataFrame:
    return counted_density(counts, site, site.bottlenecks)


def counted_density(counts: DataFrame, site: Site, zones) -> DataFrame:
    return counts.withColumn("rho", F.col("n") / constant(zones, "zone", lambda z: num(site.area_m2(z))))


def congestion(counts: DataFrame, site: Site, rho_scale: float = 1.0) -> DataFrame:
    """CBS of each bottleneck: what the density held from the tick before is
    over the critical one, weighted, times the seconds between; share of the
    session's worst gives the risk."""
    zones = site.bottlenecks
    dense = with_density(counts, site).withColumns(
        {
            "crit": constant(zones, "zone", lambda z: num(z.rho_crit * rho_scale)),
            "weight": constant(zones, "zone", lambda z: num(z.weight)),
        }
    )
    held = dense.withColumn("held", F.lag("rho").over(Window.partitionBy(*KEY, "zone").orderBy("k")))
    return ranked_congestion(held)


def ranked_congestion(held: DataFrame, *more: str) -> DataFrame:
    over = F.greatest(F.coalesce(F.col("held") - F.col("crit"), F.lit(0.0)), F.lit(0.0))
    out = held.groupBy(*more, *KEY, "zone").agg(
        F.round(F.sum(over * F.col("weight") * F.col("dt")), 6).alias("cbs"),
        F.round(F.sum(F.when(F.col("held") > F.col("crit"), F.col("dt")).otherwise(0.0)), 6).alias("over_sec"),
        F.round(F.max("rho"), 6).alias("peak"),
    )
    top = F.max("cbs").over(Window.partitionBy(*more, *KEY))
    risk = (
        F.when((top <= 0) | (F.col("cbs") <= 0), "low")
        .when(F.col("cbs") * 3 <= top, "low")
        .when(F.col("cbs") * 3 <= top * 2, "mid")
        .otherwise("high")
    )
    return out.withColumn("risk", risk)


def zone_conditions(states: DataFrame, site: Site) -> DataFrame:
    """Mean speed, mean alignment and share of movers of each zone and tick
    that has members, and whether all reach their thresholds."""
    names = on_floor(site.zones, [f"CASE WHEN {inside('x', 'y', z.polygon)} THEN '{z.name}' END" for z in site.zones])
    member = F.explode(F.filter(F.expr(names), lambda v: v.isNotNull()))
    moves = f"CASE WHEN speed >= {num(site.v_th)} AND align >= {num(site.a_th)} THEN 1 ELSE 0 END"
    return (
        states.withColumn("zone", member)
        .groupBy(*KEY, "k", "tick_us", "t0", "zone")
        .agg(
            F.avg("speed").alias("v_e"), F.avg("align").alias("a_e"),
            (F.sum(F.expr(moves)) / F.count("*")).alias("r_e"), F.count("*").alias("n"),
        )
        .withColumn(
            "holds",
            F.expr(f"coalesce(v_e >= {num(site.v_th)} AND a_e >= {num(site.a_th)} AND r_e >= {num(site.r_th)}, false)"),
        )
    )


def onset(conditions: DataFrame, site: Site, *more: str) -> DataFrame:
    """Start of each zone's first run of samples that holds for dt_hold, and
    the share of movers when that was reached: KEY, zone, start_us, delay_sec,
    participants.  With ``more`` columns (such as a variant's name) each of
    their values has runs of its own, and a column dt_hold says how long."""
    key = [*more, *KEY, "zone"]
    run = conditions.where("holds").withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy(*key).orderBy("k")))
    since = run.withColumn("start_us", F.min("tick_us").over(Window.partitionBy(*key, "run")))
    least = F.col("dt_hold") if more else F.lit(float(site.dt_hold))
    return (
        since.where((F.col("tick_us") - F.col("start_us")) / F.lit(1e6) >= least)
        .groupBy(*key)
        .agg(F.min(F.struct("k", "start_us", "t0", "r_e")).alias("x"))
        .select(
            *key, "x.start_us", ((F.col("x.start_us") - F.col("x.t0")) / F.lit(1e6)).alias("delay_sec"),
            F.round("x.r_e", 6).alias("participants"),
        )
    )


def grid_cells(site: Site) -> tuple[int, int, float]:
    size = site.cell
    rows, cols = int(-(-site.height // size)), int(-(-site.width // size))
    return rows, cols, size


def origin_distance(site: Site, zone, origin) -> str:
    """Mean grid steps from an origin's cell to a zone's cells, in metres, as
    an expression over columns r and c (all cells); without walls a step count
    is |dr| + |dc|."""
    rows, cols, size = grid_cells(site)
    r0 = max(0, min(rows - 1, int(origin[1] / size)))
    c0 = max(0, min(cols - 1, int(origin[0] / size)))
    within = even_odd("cx", "cy", zone.polygon)
    middle = centroid(zone.polygon)
    straight = ((origin[0] - middle[0]) ** 2 + (origin[1] - middle[1]) ** 2) ** 0.5 * site.m_per_px
    metre = size * site.m_per_px
    return f"coalesce(avg(CASE WHEN {within} THEN (abs(r - {r0}) + abs(c - {c0})) * {num(metre)} END), {num(straight)})"


def zone_distances(spark, site: Site) -> DataFrame:
    """Distance of every zone from every origin: zone, origin, distance."""
    rows, cols, size = grid_cells(site)
    cells = spark.range(rows * cols).selectExpr(
        f"int(id div {cols}) AS r", f"int(id % {cols}) AS c",
        f"(id % {cols} + 5e-1) * {num(size)} AS cx", f"(id div {cols} + 5e-1) * {num(size)} AS cy",
    )
    items = [
        F.expr(f"named_struct('zone', '{z.name}', 'origin', {o}, 'distance', {origin_distance(site, z, p)})")
        for z in site.zones
        for o, p in enumerate(site.origins)
    ]
    return cells.agg(F.array(*items).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def response(starts: DataFrame, distances: DataFrame, base: DataFrame, site: Site) -> DataFrame:
    """IDR of each zone of each session and floor (``base``): distance over
    delay, averaged over origins; null for zones without a start."""
    floors = " ".join(f"WHEN '{z.name}' THEN '{z.floor}'" for z in site.zones)
    rows = distances.withColumn("floor_id", F.expr(f"CASE zone {floors} END")).join(base.select(*KEY), "floor_id")
    return (
        rows.join(starts, [*KEY, "zone"], "left")
        .groupBy(*KEY, "zone")
        .agg(
            F.round(F.avg(F.expr("CASE WHEN delay_sec IS NOT NULL THEN distance / greatest(delay_sec, 1e-6) END")), 6).alias("idr"),
            F.round(F.max("delay_sec"), 6).alias("delay_sec"),
            F.round(F.avg("distance"), 6).alias("mean_distance"),
            F.max("participants").alias("participants"),
        )
        .withColumn("status", F.when(F.col("delay_sec").isNull(), "not_started").otherwise("started"))
    )


def deviations(seen: DataFrame, site: Site) -> DataFrame:
    """Distance (m) of each row from the route that was nearest at the
    object's first row."""
    first = F.first(F.expr(f"{nearest_route(site)}.r")).over(by_object())
    by_route = []
    for r in range(len(site.routes)):
        parts = [segment_distance2("x", "y", a, b) for _, n, _, a, b in route_segments(site) if n == r]
        least = parts[0] if len(parts) == 1 else f"least({', '.join(parts)})"
        by_route.append(f"WHEN {r} THEN sqrt({least})")
    cases = f"CASE route {' '.join(by_route)} END" if by_route else num(None)
    return seen.withColumn("route", first).withColumn("d", F.expr(f"({cases}) * {num(site.m_per_px)}"))


def paths(dev: DataFrame) -> DataFrame:
    """Of each object: area between its path and its route over time (a
    trapezoid from row to row, over gaps too), duration, mean and largest
    deviation."""
    steps = dev.withColumns({"d0": F.lag("d").over(by_object()), "t_before": F.lag("ts_us").over(by_object())})
    return (
        steps.groupBy(*KEY, "gid", "route")
        .agg(
            F.sum(F.expr("5e-1 * (d + d0) * ((ts_us - t_before) / 1e6)")).alias("area"),
            F.expr("(max(ts_us) - min(ts_us)) / 1e6").alias("duration"),
            F.round(F.max("d"), 6).alias("max_deviation"),
        )
    )


def epfi(allow: str) -> str:
    return f"CASE WHEN duration >= 2e0 AND area IS NOT NULL THEN round(greatest(0e0, 1e0 - area / (duration * {allow})) * 1e2, 6) END"


def fidelity(dev: DataFrame, site: Site, d_allow: float | None = None) -> DataFrame:
    """EPFI of each object: deviation over time against what is allowed; null
    under two seconds, without a route or without a scale."""
    return told(paths(dev), site, d_allow)


def told(each: DataFrame, site: Site, d_allow: float | None = None) -> DataFrame:
    """``fidelity`` of ``paths``."""
    allow = site.d_allow if d_allow is None else d_allow
    return each.select(
        *KEY, "gid", "route", F.round("duration", 6).alias("duration"), "max_deviation", F.expr(epfi(num(allow))).alias("epfi")
    )


def exit_counts(seen: DataFrame, base: DataFrame, site: Site) -> DataFrame:
    """Objects that passed each exit, once per direction: KEY, exit_id, n_in,
    n_out, all exits of all sessions and floors (``base``) included."""
    each = all_crossings(seen, site).groupBy(*KEY, "exit_id", "gid").agg(
        F.max(F.expr("CAST(direction = 'in' AS BIGINT)")).alias("i"), F.max(F.expr("CAST(direction = 'out' AS BIGINT)")).alias("o")
    )
    passed = each.groupBy(*KEY, "exit_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    names = base.select(*KEY, F.explode(F.expr(on_floor(site.exits, [f"'{e.name}'" for e in site.exits]))).alias("exit_id"))
    return names.join(passed, [*KEY, "exit_id"], "left").select(
        *KEY, "exit_id", F.coalesce("i", F.lit(0)).alias("n_in"), F.coalesce("o", F.lit(0)).alias("n_out")
    )


def exit_shares(counts: DataFrame, site: Site) -> DataFrame:
    """Actual and design share of exits that have a capacity."""
    cases = " ".join(f"WHEN '{e.name}' THEN {e.capacity if e.capacity is not None else 'CAST(NULL AS INT)'}" for e in site.exits)
    known = counts.withColumn("capacity", F.expr(f"CASE exit_id {cases} END")).where("capacity IS NOT NULL")
    whole = Window.partitionBy(*KEY)
    return known.withColumns(
        {
            "actual": F.expr("n_out") / F.nullif(F.sum("n_out").over(whole), F.lit(0)),
            "design": F.expr("capacity") / F.nullif(F.sum("capacity").over(whole), F.lit(0)),
        }
    )


def exit_balance(shares: DataFrame) -> DataFrame:
    """SEI; null without passages or capacities."""
    return shares.groupBy(*KEY).agg(F.round((1 - F.sum(F.abs(F.col("actual") - F.col("design"))) / 2) * 100, 6).alias("sei"))


def with_motion(seen: DataFrame, site: Site) -> DataFrame:
    return aligned(kinematics(seen, site), site)


def quality(tracks: DataFrame, site: Site) -> DataFrame:
    """Of each session and floor: points taken, dropped (unmapped or outside
    the ROI) and their share, objects, cameras and warnings."""
    rows = routed(tracks, site)
    names = [c.name for c in site.cameras]
    unmapped = rows.groupBy(*KEY).agg(F.sum((~F.col("cam_id").isin(names)).cast("long")).alias("unmapped"))
    taken = project(confident(rows, site), site).groupBy(*KEY).agg(
        F.sum((~F.col("in_roi")).cast("long")).alias("outside"), F.sum(F.col("in_roi").cast("long")).alias("points"),
        F.countDistinct(F.expr("CASE WHEN in_roi THEN gid END")).alias("tracks"),
        F.array_join(F.array_sort(F.collect_set(F.expr("CASE WHEN in_roi THEN cam_id END"))), ",").alias("cameras"),
    )
    zero = F.lit(0)
    both = unmapped.join(taken, KEY, "left").withColumns({c: F.coalesce(c, zero) for c in ("outside", "points", "tracks")})
    dropped = F.col("unmapped") + F.col("outside")
    ratio = F.coalesce(dropped / F.nullif(dropped + F.col("points"), zero), F.lit(0.0))
    warning = "" if site.m_per_px is not None else "no_map_scale"
    return both.select(
        *KEY, "points", dropped.alias("dropped"), "tracks", F.coalesce("cameras", F.lit("")).alias("cameras"),
        F.round(ratio, 4).alias("dropped_ratio"), F.lit(warning).alias("warnings"),
    )
