"""Session results: what-if variants, roll-ups, digests, exports, counters.

``facts`` are the tables of one evaluation, each keyed by session and floor:
base (t0, t1), persons, bottlenecks, exits, zones and quality.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import inside, line_distance, line_part, num
from ..plans.site import Site
from .observations import KEY, SECOND, constant, on_floor
from .session import epfi, exit_balance, exit_shares, onset, ranked_congestion, with_density


def _overridden(elements, variants: dict, kind: str, field: str, common: str | None = None) -> str:
    """CASE over variant and element: the variant's own value, else its common
    one, else the site's."""
    cases = []
    for name, change in variants.items():
        for e in elements:
            own = (change.get(kind) or {}).get(e.name)
            own = own.get(field) if isinstance(own, dict) else own
            value = own if own is not None else change.get(common) if common and change.get(common) is not None else getattr(e, field)
            cases.append(f"WHEN variant = '{name}' AND element = '{e.name}' THEN {num(value)}")
    return f"CASE {' '.join(cases)} END"


def _each(rows: DataFrame, variants: dict, element: str) -> DataFrame:
    names = F.explode(F.array(*map(F.lit, variants))).alias("variant")
    return rows.select("*", F.col(element).alias("element"), names)


def congestion_variants(counts: DataFrame, site: Site, variants: dict) -> DataFrame:
    """CBS under each variant from one pass over the counts."""
    held = with_density(counts, site).withColumn("held", F.lag("rho").over(Window.partitionBy(*KEY, "zone").orderBy("k")))
    each = _each(held, variants, "zone").withColumns(
        {
            "crit": F.expr(_overridden(site.bottlenecks, variants, "bottlenecks", "rho_crit", "rho_crit")),
            "weight": F.expr(_overridden(site.bottlenecks, variants, "bottlenecks", "weight")),
        }
    )
    return ranked_congestion(each, "variant")


def replays(counts: DataFrame, exits: DataFrame, site: Site, variants: dict) -> DataFrame:
    """CBS total and SEI of each session and floor under each variant."""
    total = congestion_variants(counts, site, variants).groupBy("variant", *KEY).agg(F.round(F.sum("cbs"), 6).alias("cbs_total"))
    each = _each(exits, variants, "exit_id").withColumn("capacity", F.expr(_overridden(site.exits, variants, "exits", "capacity")))
    whole = Window.partitionBy("variant", *KEY)
    shares = each.where("capacity IS NOT NULL").withColumns(
        {
            "actual": F.col("n_out") / F.nullif(F.sum("n_out").over(whole), F.lit(0)),
            "design": F.col("capacity") / F.nullif(F.sum("capacity").over(whole), F.lit(0.0)),
        }
    )
    sei = shares.groupBy("variant", *KEY).agg(F.round((1 - F.sum(F.abs(F.col("actual") - F.col("design"))) / 2) * 100, 6).alias("sei"))
    return total.join(sei, ["variant", *KEY], "left").select("variant", *KEY, "cbs_total", "sei")


#: Thresholds that a replay may change without a new pass over the tracks.
THRESHOLDS = ("v_th", "a_th", "r_th", "dt_hold", "d_allow")


def _threshold(variants: dict, site: Site, field: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {num((change.get('thresholds') or {}).get(field, getattr(site, field)))}" for name, change in variants.items())
    return f"CASE variant {cases} END"


def condition_variants(states: DataFrame, site: Site, variants: dict) -> DataFrame:
    """``zone_conditions`` under each variant's thresholds, in one pass over
    the sampled objects: movers are counted once a variant in the same group."""
    sites = [replace(site, **{k: v for k, v in (c.get("thresholds") or {}).items() if k in THRESHOLDS and v is not None}) for c in variants.values()]
    names = on_floor(site.zones, [f"CASE WHEN {inside('x', 'y', z.polygon)} THEN '{z.name}' END" for z in site.zones])
    moves = [F.sum(F.expr(f"CASE WHEN speed >= {num(v.v_th)} AND align >= {num(v.a_th)} THEN 1 ELSE 0 END")).alias(f"m{i}") for i, v in enumerate(sites)]
    counted_ = (
        states.withColumn("zone", F.explode(F.filter(F.expr(names), lambda v: v.isNotNull())))
        .groupBy(*KEY, "k", "tick_us", "t0", "zone")
        .agg(F.avg("speed").alias("v_e"), F.avg("align").alias("a_e"), F.count("*").alias("n"), *moves)
    )
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("variant"), (F.col(f"m{i}") / F.col("n")).alias("r_e")) for i, name in enumerate(variants)])).alias("x")
    rows = counted_.select(*KEY, "k", "tick_us", "t0", "zone", "v_e", "a_e", each).select("*", "x.*").drop("x")
    holds = " AND ".join(f"{c} >= {_threshold(variants, site, t)}" for c, t in (("v_e", "v_th"), ("a_e", "a_th"), ("r_e", "r_th")))
    return rows.withColumns({"holds": F.expr(f"coalesce({holds}, false)"), "dt_hold": F.expr(_threshold(variants, site, "dt_hold"))})


def whole_replays(facts: dict[str, DataFrame], site: Site, variants: dict) -> DataFrame:
    """Every total of each session and floor under each variant's thresholds,
    critical densities, weights and capacities: variant, KEY, zones_started,
    idr_avg, epfi_avg, cbs_total, sei, and for roll-ups e and m (sum and number
    of EPFIs).  ``facts``: base, states, counts (of bottlenecks), exits, paths
    and distances.  Tracks are not read again: thresholds only decide what the
    same samples mean."""
    starts = onset(condition_variants(facts["states"], site, variants), site, "variant")
    floors = " ".join(f"WHEN '{z.name}' THEN '{z.floor}'" for z in site.zones)
    every = _each(facts["base"].select(*KEY), variants, "floor_id").drop("element")
    far = facts["distances"].withColumn("floor_id", F.expr(f"CASE zone {floors} END"))
    zones = every.join(far, "floor_id").join(starts, ["variant", *KEY, "zone"], "left").groupBy("variant", *KEY, "zone").agg(
        F.round(F.avg(F.expr("CASE WHEN delay_sec IS NOT NULL THEN distance / greatest(delay_sec, 1e-6) END")), 6).alias("idr")
    )
    idr = zones.groupBy("variant", *KEY).agg(F.count("idr").alias("zones_started"), F.round(F.avg("idr"), 6).alias("idr_avg"))
    score = epfi(_threshold(variants, site, "d_allow"))
    persons = _each(facts["paths"], variants, "gid").withColumn("epfi", F.expr(score)).groupBy("variant", *KEY).agg(
        F.round(F.avg("epfi"), 6).alias("epfi_avg"), F.sum("epfi").alias("e"), F.count("epfi").alias("m")
    )
    rest = replays(facts["counts"], facts["exits"], site, variants)
    key = ["variant", *KEY]
    out = every.join(idr, key, "left").join(persons, key, "left").join(rest, key, "left")
    return out.withColumn("zones_started", F.coalesce("zones_started", F.lit(0)))


def drill_replays(facts: dict[str, DataFrame], site: Site, variants: dict) -> DataFrame:
    """``whole_replays`` of the floors that take part, rolled up to one row for
    each variant and session: EPFI over all persons, CBS summed, SEI over the
    exits of all floors that have a capacity (0 counts as none), zones started."""
    part = F.col("floor_id").isin(site.taking_part())
    floors = whole_replays(facts, site, variants).where(part)
    each = _each(facts["exits"].where(part), variants, "exit_id").withColumn("capacity", F.expr(_overridden(site.exits, variants, "exits", "capacity"))).where("capacity <> 0e0")
    whole = Window.partitionBy("variant", "session_id")
    meant = each.withColumns({"sn": F.sum("n_out").over(whole), "sc": F.sum("capacity").over(whole)})
    off = F.abs(F.col("n_out") / F.nullif("sn", F.lit(0)) - F.col("capacity") / F.nullif("sc", F.lit(0.0)))
    sei = meant.groupBy("variant", "session_id").agg(F.round((1 - F.sum(off) / 2) * 100, 6).alias("sei"))
    return floors.groupBy("variant", "session_id").agg(
        F.count("*").alias("floors"), F.sum("zones_started").alias("zones_started"), F.round(F.sum("e") / F.nullif(F.sum("m"), F.lit(0)), 6).alias("epfi_avg"),
        F.round(F.sum("cbs_total"), 4).alias("cbs_total"),
    ).join(sei, ["variant", "session_id"], "left")


def exit_deviations(exits: DataFrame, site: Site) -> DataFrame:
    """Exits with actual less designed share, farthest first (without a share
    last), and those that nobody used though they were meant to be."""
    shares = exit_shares(exits, site).select(*KEY, "exit_id", "design", F.round(F.col("actual") - F.col("design"), 4).alias("delta"))
    both = exits.join(shares, [*KEY, "exit_id"], "left")
    by = Window.partitionBy(*KEY).orderBy(F.desc(F.abs(F.coalesce("delta", F.lit(0.0)))), "exit_id")
    unused = (F.col("n_out") == 0) & (F.coalesce("design", F.lit(0.0)) > 0)
    return both.select(*KEY, "exit_id", "n_out", "delta", unused.alias("unused"), F.row_number().over(by).cast("long").alias("place"))


def _floors(facts: dict[str, DataFrame], site: Site) -> DataFrame:
    """One row for each session and floor with all its totals."""
    zones = facts["zones"].groupBy(*KEY).agg(
        F.sum((F.col("status") == "started").cast("long")).alias("zones_started"), F.count("*").alias("zones_total"),
        F.round(F.min("delay_sec"), 6).alias("first_start"),
    )
    persons = facts["persons"].groupBy(*KEY).agg(
        F.round(F.avg("epfi"), 6).alias("epfi_avg"), F.count("*").alias("persons"), F.sum("epfi").alias("e"), F.count("epfi").alias("m")
    )
    congested = facts["bottlenecks"].groupBy(*KEY).agg(F.round(F.sum("cbs"), 6).alias("cbs_total"))
    out = facts["base"].join(zones, KEY, "left").join(persons, KEY, "left").join(congested, KEY, "left")
    out = out.join(exit_balance(exit_shares(facts["exits"], site)), KEY, "left")
    out = out.join(facts["exits"].groupBy(*KEY).agg(F.sum("n_out").alias("passed")), KEY, "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("zones_started", "zones_total", "persons", "passed")})


def session_list(facts: dict[str, DataFrame], site: Site) -> DataFrame:
    """Sessions of each floor with their totals, numbered from the newest."""
    newest = F.row_number().over(Window.partitionBy("floor_id").orderBy(F.desc("t0")))
    return _floors(facts, site).select(
        *KEY, F.col("t0").alias("alarm_us"), F.expr("(t1 - t0) / 1e6").alias("elapsed_sec"), "epfi_avg", "cbs_total", "sei",
        "zones_started", "zones_total", "persons", "passed", newest.cast("long").alias("newest"),
    )


def reliability(facts: dict[str, DataFrame], site: Site) -> DataFrame:
    """Whether a session can be read: insufficient with 30 % of the points
    dropped or under ten objects, caution from 15 % or under 30 seconds."""
    both = facts["quality"].join(facts["base"].selectExpr(*KEY, "(t1 - t0) / 1e6 AS duration"), KEY)
    verdict = (
        F.when((F.col("dropped_ratio") >= 0.30) | (F.col("tracks") < 10), "insufficient")
        .when((F.col("dropped_ratio") >= 0.15) | (F.col("duration") < 30), "caution")
        .otherwise("ok")
    )
    return both.select(*KEY, verdict.alias("verdict"), "dropped_ratio", "tracks", "cameras", "duration")


def _building(facts: dict[str, DataFrame], site: Site, floors: DataFrame) -> DataFrame:
    capacity = constant(site.exits, "exit_id", lambda e: num(None if e.capacity is None else float(e.capacity)))
    meant = facts["exits"].withColumn("capacity", F.expr("0e0") if not site.exits else capacity).where("capacity <> 0e0")
    whole = Window.partitionBy("session_id")
    share = meant.withColumns({"se": F.sum("n_out").over(whole), "sc": F.sum("capacity").over(whole)})
    part = F.abs(F.col("n_out") / F.nullif("se", F.lit(0)) - F.col("capacity") / F.nullif("sc", F.lit(0.0)))
    sei = share.groupBy("session_id").agg(F.round((1 - F.sum(part) / 2) * 100, 6).alias("sei"))
    order = F.lit(0)
    for k, f in enumerate(site.floors):  # of equal totals the first floor
        order = F.when(F.col("floor_id") == f, -k).otherwise(order)
    return floors.groupBy("session_id").agg(
        F.round(F.sum("e") / F.nullif(F.sum("m"), F.lit(0)), 6).alias("epfi_avg"),
        F.round(F.sum("cbs_total"), 4).alias("cbs_total"),
        F.sum("passed").alias("passed"), F.sum("persons").alias("persons"),
        F.max_by("floor_id", F.struct(F.coalesce("cbs_total", F.lit(0.0)).alias("c"), order.alias("o"))).alias("max_cbs_floor"),
        F.min("first_start").alias("first_start"),
    ).join(sei, "session_id", "left")


def building_rollup(facts: dict[str, DataFrame], site: Site) -> DataFrame:
    """A row for each floor of each session and one for the building: EPFI of
    all persons, CBS summed, SEI over the exits of all floors that have a
    capacity (0 counts as none), the worst floor and the earliest start."""
    floors = _floors(facts, site)
    columns = ["session_id", "floor_id", "epfi_avg", "cbs_total", "sei", "passed", "persons", "max_cbs_floor", "first_start"]
    each = floors.withColumns({"max_cbs_floor": F.lit(None).cast("string"), "cbs_total": F.round("cbs_total", 4)}).select(*columns)
    whole = _building(facts, site, floors).withColumn("floor_id", F.lit("building")).select(*columns)
    return whole.unionByName(each)


def drill_list(facts: dict[str, DataFrame], site: Site) -> DataFrame:
    """Sessions that every floor which takes part has, with building totals."""
    floors = _floors(facts, site).where(F.col("floor_id").isin(site.taking_part()))
    each = floors.groupBy("session_id").agg(
        F.min("t0").alias("alarm_us"), F.array_join(F.array_sort(F.collect_set("floor_id")), ",").alias("floors"), F.count("*").alias("n")
    )
    whole = _building(facts, site, floors).select("session_id", "epfi_avg", "cbs_total", "sei")
    return each.where(F.col("n") == len(site.taking_part())).drop("n").join(whole, "session_id")


def _long(rows: DataFrame, kind: str, name: str, columns: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    return rows.select(*KEY, F.lit(kind).alias("kind"), F.col(name).alias("id"), F.expr(f"stack({len(columns)}, {pairs}) AS (k, v)"))


def entity_export(facts: dict[str, DataFrame], site: Site) -> DataFrame:
    """Everything in long form: kind, id, k, v."""
    parts = [
        _long(facts["bottlenecks"], "bottleneck", "zone", ["cbs", "over_sec", "peak"]),
        _long(facts["persons"], "person", "gid", ["duration", "max_deviation", "epfi"]),
        _long(facts["exits"], "exit", "exit_id", ["n_in", "n_out"]),
        _long(facts["zones"], "zone", "zone", ["idr", "delay_sec", "mean_distance"]),
        _long(_floors(facts, site), "summary", "floor_id", ["epfi_avg", "cbs_total", "sei"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def surges(series: DataFrame) -> DataFrame:
    """Of each zone's series (KEY, zone, k, tick_us, t0, rho): the peak, when it
    is first reached, first and last time above zero, and seconds above zero,
    as samples times the median step."""
    by = Window.partitionBy(*KEY, "zone").orderBy("k")
    timed = series.withColumns(
        {"t": F.expr("(tick_us - t0) / 1e6"), "step": (F.col("tick_us") - F.lag("tick_us").over(by)) / F.lit(1e6)}
    )
    up = F.expr("CASE WHEN rho > 0e0 THEN t END")
    step = F.round(F.coalesce(F.percentile("step", F.lit(0.5)), F.lit(1.0)), 3)
    out = timed.groupBy(*KEY, "zone").agg(
        F.round(F.max("rho"), 3).alias("peak"),
        F.round(F.min_by("t", F.struct((-F.col("rho")).alias("a"), "k")), 1).alias("peak_at"),
        F.round(F.min(up), 1).alias("first_on"), F.round(F.max(up), 1).alias("last_on"), F.round(F.count(up) * step, 1).alias("on_sec"),
    )
    return out.withColumn("peak_at", F.expr("CASE WHEN first_on IS NOT NULL THEN peak_at END"))


def person_series(dev: DataFrame, grid: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Each object's deviation at each sample, if its last row is at most so
    many seconds old.  ``dev``: KEY, gid, ts_us, event_id, d."""
    w = Window.partitionBy(*KEY, "gid").orderBy("ts_us", "event_id")
    held = dev.withColumn("until", F.lead(F.struct("ts_us", "event_id")).over(w))
    most = int(seconds * SECOND)
    # a sample's call may be later than the sample, never earlier but at the end
    spread = held.withColumn("b", F.explode(F.expr(f"sequence(ts_us div {SECOND}, (ts_us + {most}) div {SECOND})")))
    asked = grid.select(*KEY, "k", "tick_us", "c", F.expr(f"tick_us div {SECOND}").alias("b"))
    early = spread.join(asked, [*KEY, "b"])
    # a row between the sample and its call is newer than the sample
    late = held.join(grid.select(*KEY, "k", "tick_us", "c", F.col("c.ts_us").alias("ts_us")), [*KEY, "ts_us"]).where("tick_us < ts_us")
    columns = [*KEY, "gid", "ts_us", "event_id", "until", "d", "k", "tick_us", "c"]
    here = F.struct("ts_us", "event_id")
    both = early.where("ts_us <= tick_us").select(*columns).unionByName(late.select(*columns))
    live = both.where((here <= F.col("c")) & (F.col("until").isNull() | (F.col("until") > F.col("c"))))
    return live.where(F.col("tick_us") - F.col("ts_us") <= most).select(*KEY, "gid", "k", "d")


def line_counter(tracks: DataFrame, a, b, within, margin: float = 6.0, start: int = 0, pad: float = 0.06) -> DataFrame:
    """One camera's raw crossings of a line in the image, a frame a second:
    an object keeps its side while it is in every frame of its camera, farther
    than the margin from the line.  cam_id, n_in, n_out, occupancy, alert (it
    fell below 0) and present (objects of the last frame)."""
    rows = (
        tracks.withColumn("frame", F.expr(f"ts_us div {SECOND}"))
        .groupBy("cam_id", "frame", "gid")
        .agg(F.max(F.struct("ts_us", "event_id", "u", "v")).alias("m"))
    )
    frames = rows.select("cam_id", "frame").distinct().withColumn("f", F.row_number().over(Window.partitionBy("cam_id").orderBy("frame")))
    by = Window.partitionBy("cam_id", "gid").orderBy("f")
    placed = rows.join(frames, ["cam_id", "frame"]).select(
        "cam_id", "gid", "f", F.expr(line_distance("m.u", "m.v", a, b, within)).alias("d"), F.expr(line_part("m.u", "m.v", a, b)).alias("t")
    )
    islands = placed.withColumn("gap", F.when(F.col("f") - F.lag("f").over(by) > 1, 1).otherwise(0)).withColumn("isle", F.sum("gap").over(by))
    clear = islands.where(F.abs("d") >= margin).withColumn("s", F.col("d") > 0)
    was = F.lag("s").over(Window.partitionBy("cam_id", "gid", "isle").orderBy("f"))
    crossed = clear.withColumn("p", was).where((F.col("p") != F.col("s")) & F.col("t").between(-pad, 1 + pad))
    counts = crossed.groupBy("cam_id").agg(F.sum(F.col("s").cast("long")).alias("i"), F.sum((~F.col("s")).cast("long")).alias("o"))
    last = frames.groupBy("cam_id").agg(F.max("f").alias("f"))
    present = placed.join(F.broadcast(last), ["cam_id", "f"]).groupBy("cam_id").agg(F.count("*").alias("present"))
    out = present.join(counts, "cam_id", "left").select("cam_id", F.coalesce("i", F.lit(0)).alias("n_in"), F.coalesce("o", F.lit(0)).alias("n_out"), "present")
    out = out.withColumn("occupancy", F.lit(start) + F.col("n_in") - F.col("n_out"))
    return out.withColumn("alert", F.col("occupancy") < 0)
