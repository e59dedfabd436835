"""Registered queries on sessions of the site, and the same in SQL.

The SQL has the site as tables of numbers (cameras, edges of polygons, route
segments, exit lines) and joins them, so it shares no expression with the
operators.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import area, num
from ..operators import digest, observations as obs, session, summary
from ..operators.observations import KEY
from ..operators.tables import written_together
from ..sources.tracks import TRACKS_SQL, from_events
from .site import SITE

S = SITE


def _tracks(spark, d):
    return from_events(spark.read.parquet(f"{d}/events.parquet"))


def _seen(spark, d):
    return obs.observed(_tracks(spark, d), S)


def _base(spark, d):
    return obs.sessions(_tracks(spark, d), S)


def _states(spark, d):
    grid = session.ticks(_tracks(spark, d), S)
    moving = session.with_motion(_seen(spark, d), S).select(*KEY, "gid", "ts_us", "event_id", "until", "x", "y", "speed", "align")
    return grid, session.tick_states(moving, grid, S)


def _counts(spark, d):
    grid = session.ticks(_tracks(spark, d), S)
    rows = _seen(spark, d).select(*KEY, "gid", "ts_us", "event_id", "until", "x", "y")
    return session.tick_counts(session.tick_states(rows, grid, S), grid, S, S.bottlenecks)


def _now(spark, d, zones):
    n = obs.counted(obs.snapshot(_tracks(spark, d), S), _base(spark, d).select(*KEY), S, zones, KEY)
    return n.withColumn("density", F.round(F.col("n") / obs.constant(zones, "zone", lambda z: num(S.area_m2(z))), 3))


def zone_occupancy(spark, d):
    return _now(spark, d, S.zones)


def floor_view_zones(spark, d):
    """Occupancy by one floor's view of the site, which has its elements only."""
    view = S.floor_view("f1")
    tracks = _tracks(spark, d)
    base = obs.sessions(obs.mapped(tracks, view), view).select(*KEY)
    n = obs.counted(obs.snapshot(tracks, view), base, view, view.zones, KEY)
    return n.withColumn("cameras", F.lit(",".join(c.name for c in view.cameras)))


def bottleneck_state(spark, d):
    z = S.bottlenecks
    return _now(spark, d, z).withColumn("over", F.col("density") > obs.constant(z, "zone", lambda b: num(b.rho_crit)))


def object_labels(spark, d):
    """Objects on the floor with the zone that names them, and their dwell."""
    snap = obs.labelled(obs.snapshot(_tracks(spark, d), S), S.zones)
    return snap.select(*KEY, "gid", "event_id", "zone", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "in_map")


def floor_routing(spark, d):
    return obs.routed(_tracks(spark, d), S).groupBy("cam_id", "floor_id").agg(F.count("*").alias("n"))


def min_conf_filter(spark, d):
    return obs.confident(_tracks(spark, d), S).groupBy("cam_id").agg(F.count("*").alias("n"))


def roi_filter(spark, d):
    p = obs.project(_tracks(spark, d), S)
    return p.groupBy("cam_id").agg(
        F.sum(F.col("in_roi").cast("long")).alias("n_in"), F.sum((~F.col("in_roi")).cast("long")).alias("n_out")
    )


def homography_project(spark, d):
    p = obs.project(_tracks(spark, d), S)
    return p.select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "in_map")


def window_speed(spark, d):
    k = obs.kinematics(_seen(spark, d), S)
    return k.select("event_id", "gid", "seg", *(F.round(c, 6).alias(c) for c in ("speed", "hx", "hy")))


def route_alignment(spark, d):
    a = session.with_motion(_seen(spark, d), S)
    return a.select("event_id", F.col("near.r").alias("route"), F.col("near.k").alias("piece"), F.round("align", 6).alias("align"))


def dwell_time(spark, d):
    return _seen(spark, d).groupBy(*KEY, "gid", "seg").agg((F.max("ts_us") - F.min("ts_us")).alias("dwell_us"))


def lost_timeout_sessions(spark, d):
    return _seen(spark, d).groupBy(*KEY, "gid", "seg").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")
    )


def acceleration(spark, d):
    k = obs.kinematics(_seen(spark, d), S)
    w = obs.by_object("seg")
    dt = (F.col("ts_us") - F.lag("ts_us").over(w)) / F.lit(1e6)
    return k.select(
        "event_id", F.round(F.when(dt > 0, F.abs(F.col("speed") - F.lag("speed").over(w)) / dt), 6).alias("acceleration")
    )


def exit_crossings(spark, d):
    return obs.all_crossings(_seen(spark, d), S).select("exit_id", "gid", "event_id", "direction")


def _exit_counts(spark, d):
    return session.exit_counts(_seen(spark, d), _base(spark, d), S)


def exit_counts_debounced(spark, d):
    return _exit_counts(spark, d)


#: One camera's counting line, its inner side, margin (px) and first occupancy.
LINE = ((500.0, 0.0), (500.0, 1000.0), (400.0, 500.0))


def occupancy_counter(spark, d):
    return digest.line_counter(_tracks(spark, d), *LINE, margin=6.0, start=10)


def exit_share(spark, d):
    s = session.exit_shares(_exit_counts(spark, d), S)
    return s.select(*KEY, "exit_id", F.round("actual", 9).alias("actual"), F.round("design", 9).alias("design"))


def sei_score(spark, d):
    return session.exit_balance(session.exit_shares(_exit_counts(spark, d), S))


def exit_deviation(spark, d):
    """Exits by how far their share is from the designed one."""
    return digest.exit_deviations(_exit_counts(spark, d), S)


def route_deviation(spark, d):
    return session.deviations(_seen(spark, d), S).select("event_id", "route", F.round("d", 6).alias("deviation"))


def _epfi(spark, d, allow=None):
    return session.fidelity(session.deviations(_seen(spark, d), S), S, allow)


def epfi_person(spark, d):
    return _epfi(spark, d)


def epfi_avg(spark, d):
    return _epfi(spark, d).groupBy(*KEY).agg(F.round(F.avg("epfi"), 6).alias("epfi_avg"), F.count("epfi").alias("n"))


def tick_density(spark, d):
    return session.with_density(_counts(spark, d), S).select(*KEY, "k", "zone", "n", F.round("rho", 6).alias("rho"))


def cbs_bottleneck(spark, d):
    return session.congestion(_counts(spark, d), S)


def zone_conditions(spark, d):
    _, states = _states(spark, d)
    c = session.zone_conditions(states, S)
    return c.select(*KEY, "k", "zone", *(F.round(v, 6).alias(v) for v in ("v_e", "a_e", "r_e")), "n", "holds")


#: Scattered positions hold no direction; these thresholds let runs occur.
LOOSE = replace(S, v_th=0.2, a_th=-0.8, r_th=0.05, dt_hold=1.5)


def _onset(spark, d):
    _, states = _states(spark, d)
    return session.onset(session.zone_conditions(states, LOOSE), LOOSE)


def zone_onset_hold(spark, d):
    return _onset(spark, d)


def _idr(spark, d):
    return session.response(_onset(spark, d), session.zone_distances(spark, S), _base(spark, d), S)


def idr_zone(spark, d):
    return _idr(spark, d)


def grid_zone_distance(spark, d):
    return session.zone_distances(spark, S).select("zone", "origin", F.round("distance", 6).alias("distance"))


def session_timeline(spark, d):
    """Per sample: density of each bottleneck as a map of JSON, and people."""
    n = session.with_density(_counts(spark, d), S)
    return n.groupBy(*KEY, "k").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "zone", F.format_string("%.4f", F.round("rho", 4))))), ",").alias("density"),
        F.sum("n").alias("people"),
    )


def session_quality(spark, d):
    return session.quality(_tracks(spark, d), S)


def replay_sweep_dallow(spark, d):
    """One pass over the paths; each variant only rescales what is allowed."""
    variants = F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 4.0)))).alias("d_allow")
    each = session.paths(session.deviations(_seen(spark, d), S)).select(*KEY, "duration", "area", variants)
    return each.groupBy(*KEY, "d_allow").agg(F.round(F.avg(F.expr(session.epfi("d_allow"))), 6).alias("epfi_avg"))


#: What-if variants: a critical density for all bottlenecks, then for some of
#: them, weights, and exit capacities; only elements that exist are changed.
OVERRIDES = {
    "as_is": {},
    "dense": {"rho_crit": 0.125},
    "mixed": {"rho_crit": 0.25, "bottlenecks": {"b1": {"rho_crit": 0.5, "weight": 4.0}, "none": {"weight": 9.0}}, "exits": {"e2": 80, "e3": 10}},
}


def replay_overrides(spark, d):
    return digest.replays(_counts(spark, d), _exit_counts(spark, d), S, OVERRIDES)


#: The same with thresholds, which the tracks are not read again for.
REPLAYS = {
    "as_is": {},
    "slow": {"thresholds": {"v_th": 0.1, "dt_hold": 1.0, "d_allow": 4.0}},
    "strict": {"thresholds": {"a_th": -0.5, "r_th": 0.3, "d_allow": 1.0}, "rho_crit": 0.25},
    "mixed": {"thresholds": {"v_th": 0.15, "dt_hold": 0.5}, "bottlenecks": {"b1": {"rho_crit": 0.5, "weight": 4.0}}, "exits": {"e2": 80, "e3": 10}},
}


def _replayed(spark, d):
    facts = _drawn(spark, d)
    counts = session.tick_counts(facts["states"], facts["grid"], S, S.bottlenecks)
    return facts | {"counts": counts, "distances": session.zone_distances(spark, S)}


def replay_thresholds(spark, d):
    return digest.whole_replays(_replayed(spark, d), LOOSE, REPLAYS).drop("e", "m")


def drill_replay(spark, d):
    return digest.drill_replays(_replayed(spark, d), LOOSE, REPLAYS)


def replay_sweep_rhocrit(spark, d):
    sweep = {str(r): {"rho_crit": r} for r in (0.125, 0.25, 0.5, 1.0)}
    out = digest.congestion_variants(_counts(spark, d), S, sweep)
    return out.groupBy("variant", *KEY).agg(F.round(F.sum("cbs"), 6).alias("cbs_total"))


def _drawn(spark, d):
    """What facts are drawn from: sessions, samples, positions, the objects at
    each sample; each once."""
    tracks = _tracks(spark, d)
    first = written_together(
        base=obs.sessions(tracks, S), grid=session.ticks(tracks, S), seen=obs.observed(tracks, S), quality=session.quality(tracks, S)
    )
    seen = first["seen"]
    moving = session.with_motion(seen, S).select(*KEY, "gid", "ts_us", "event_id", "until", "x", "y", "speed", "align")
    second = written_together(
        states=session.tick_states(moving, first["grid"], S), paths=session.paths(session.deviations(seen, S)),
        exits=session.exit_counts(seen, first["base"], S),
    )
    return first | second


def _facts(spark, d):
    """What sessions are told by, each fact written once."""
    facts = _drawn(spark, d)
    states = facts["states"]
    starts = session.onset(session.zone_conditions(states, LOOSE), LOOSE)
    return facts | {"persons": session.told(facts["paths"], S)} | written_together(
        bottlenecks=session.congestion(session.tick_counts(states, facts["grid"], S, S.bottlenecks), S),
        zones=session.response(starts, session.zone_distances(spark, S), facts["base"], S),
    )


def session_list(spark, d):
    return digest.session_list(_facts(spark, d), S)


def session_digest(spark, d):
    return digest.reliability(_facts(spark, d), S)


def drill_rollup(spark, d):
    return digest.building_rollup(_facts(spark, d), S)


def drill_list(spark, d):
    return digest.drill_list(_facts(spark, d), S)


def drill_common_sessions(spark, d):
    """Sessions that every floor which takes part has."""
    t = obs.routed(_tracks(spark, d), S).where(F.col("floor_id").isin(S.taking_part()))
    return (
        t.groupBy("session_id").agg(F.countDistinct("floor_id").alias("f"), F.count("*").alias("n"))
        .where(F.col("f") == len(S.taking_part())).select("session_id", "n")
    )


def metrics_eav_export(spark, d):
    return digest.entity_export(_facts(spark, d), S)


def digest_quartiles(spark, d):
    return summary.index_quartiles(_epfi(spark, d), ["route"], "epfi")


def digest_surges(spark, d):
    return digest.surges(session.with_density(_counts(spark, d), S))


def bottleneck_ranks(spark, d):
    by = Window.partitionBy(*KEY).orderBy(F.desc("cbs"), F.desc("peak"), "zone")
    return cbs_bottleneck(spark, d).select(*KEY, "zone", "cbs", "risk", F.row_number().over(by).cast("long").alias("place"))


def idr_average(spark, d):
    return _idr(spark, d).groupBy(*KEY).agg(
        F.round(F.avg(F.expr("CASE WHEN status = 'started' THEN idr END")), 6).alias("idr_avg"),
        F.sum((F.col("status") == "started").cast("long")).alias("started"),
    )


def worst_epfi_topk(spark, d):
    return _epfi(spark, d).where("epfi IS NOT NULL").select("session_id", "gid", "epfi").orderBy("epfi", "session_id", "gid").limit(8)


def timeline_thin(spark, d):
    return summary.thin(session_timeline(spark, d), KEY, "k", 5)


def epfi_histogram(spark, d):
    return summary.histogram(_epfi(spark, d), "epfi")


def person_series(spark, d):
    """Deviation of each object at each sample, from a row at most 3 s old."""
    dev = session.deviations(_seen(spark, d), S).select(*KEY, "gid", "ts_us", "event_id", "d")
    return digest.person_series(dev, session.ticks(_tracks(spark, d), S)).select(*KEY, "gid", "k", F.round("d", 6).alias("d"))


# ---- the same in SQL -----------------------------------------------------


def _values(rows, names):
    def one(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names}))"


def _ring(polygon):
    return [(*a, *b) for a, b in zip(polygon, [*polygon[1:], polygon[0]])]


_FLOOR = {"cam0": "f0", "cam1": "f1", "cam2": "f0", "cam3": "f1"}  # yb hand: cam2 names a floor that is not there
_H = ", ".join(f"h{i}" for i in range(9))
CONFIG = f"""fl AS {_values(_FLOOR.items(), 'cam_id, floor_id')},
cam AS {_values([(c.name, *c.h, S.min_conf if c.min_conf is None else c.min_conf) for c in S.cameras], f'cam_id, {_H}, least')},
roie AS {_values([(c.name, *e) for c in S.cameras for e in _ring(c.roi)], 'cam_id, x1, y1, x2, y2')},
zn AS {_values([(k, z.name, z.floor, i, area(z.polygon) * 1e-4, z.rho_crit, z.weight) for k, zs in (('z', S.zones), ('b', S.bottlenecks)) for i, z in enumerate(zs)], 'kind, zone, floor_id, ord, area, crit, weight')},
ze AS {_values([(k, z.name, *e) for k, zs in (('z', S.zones), ('b', S.bottlenecks)) for z in zs for e in _ring(z.polygon)], 'kind, zone, x1, y1, x2, y2')},
rt AS {_values([(r.floor, i, k, *a, *b) for i, r in enumerate(S.routes) for k, (a, b) in enumerate(zip(r.points, r.points[1:]))], 'floor_id, r, k, xa, ya, xb, yb')},
xs AS {_values([(e.name, e.floor, *e.a, *e.b, *e.within, e.capacity) for e in S.exits], 'exit_id, floor_id, xa, ya, xb, yb, wx, wy, capacity')}"""
_HIT = "(y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1"
_EDGE = "(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1) = 0 AND {x} BETWEEN least(x1, x2) AND greatest(x1, x2) AND {y} BETWEEN least(y1, y2) AND greatest(y1, y2)"


def _within(x, y):
    return f"(count(*) FILTER (WHERE {_HIT.format(x=x, y=y)}) % 2 = 1 OR count(*) FILTER (WHERE {_EDGE.format(x=x, y=y)}) > 0)"


TRK = f"""{TRACKS_SQL.replace("'f' || CAST(user_id % 2 AS VARCHAR) AS floor_id,", '')}, {CONFIG},
trk AS (SELECT * FROM tracks JOIN fl USING (cam_id)),
sess AS (SELECT session_id, floor_id, min(ts_us) AS t0, max(ts_us) AS t1 FROM trk GROUP BY ALL)"""
PROJ = f"""{TRK},
pr0 AS (SELECT *, (h0 * u + h1 * v + h2) / (h6 * u + h7 * v + h8) AS x, (h3 * u + h4 * v + h5) / (h6 * u + h7 * v + h8) AS y,
  lag(ts_us) OVER (PARTITION BY session_id, floor_id ORDER BY ts_us, event_id) AS before_us FROM trk JOIN cam USING (cam_id)),
ins AS (SELECT event_id, {_within('u', 'v')} AS in_roi FROM trk JOIN roie USING (cam_id) GROUP BY event_id),
proj AS (SELECT * FROM pr0 JOIN ins USING (event_id))"""
_OBJ = "PARTITION BY session_id, floor_id, gid ORDER BY ts_us, event_id"
SEEN = f"""{PROJ},
tc0 AS (SELECT *, lag(in_roi) OVER w AS was_in, lag(ts_us) OVER w AS was_us, lead(ts_us) OVER w AS next_us, lead(event_id) OVER w AS next_id
  FROM proj WHERE conf >= least WINDOW w AS ({_OBJ})),
tc AS (SELECT *, CAST(sum(CASE WHEN in_roi AND was_in IS NOT NULL AND (NOT was_in OR before_us - was_us > 3000000) THEN 1 ELSE 0 END) OVER ({_OBJ} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM tc0),
seen AS (SELECT * FROM tc WHERE in_roi)"""
_GO = "sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))"
KIN = f"""{SEEN},
kn0 AS (SELECT *, min({{'t': ts_us, 'e': event_id, 'x': x, 'y': y}}) OVER (PARTITION BY session_id, floor_id, gid, seg ORDER BY ts_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS f FROM seen),
kn1 AS (SELECT *, f.x AS fx, f.y AS fy, (ts_us - f.t) / 1e6 AS dt FROM kn0),
kn AS (SELECT *, CASE WHEN dt <= 0 OR {_GO} * 0.01::DOUBLE < 0.05::DOUBLE THEN 0e0 ELSE {_GO} * 0.01::DOUBLE / dt END AS speed,
  CASE WHEN {_GO} > 1e-9 THEN (x - fx) / {_GO} ELSE 0e0 END AS hx, CASE WHEN {_GO} > 1e-9 THEN (y - fy) / {_GO} ELSE 0e0 END AS hy FROM kn1)"""
_PART = "least(1e0, greatest(0e0, ((x - xa) * (xb - xa) + (y - ya) * (yb - ya)) / ((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya))))"
_OFF = "(x - (xa + t * (xb - xa))) * (x - (xa + t * (xb - xa))) + (y - (ya + t * (yb - ya))) * (y - (ya + t * (yb - ya)))"
NEAR = f"""nr0 AS (SELECT event_id, r, k, xa, ya, xb, yb, x, y, {_PART} AS t FROM seen JOIN rt USING (floor_id)),
nr1 AS (SELECT *, {_OFF} AS d2 FROM nr0),
nr AS (SELECT event_id, r, k, (xb - xa) / sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS tx, (yb - ya) / sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS ty
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d2, r, k) AS place FROM nr1) WHERE place = 1)"""
MOVE = f"{KIN}, {NEAR}, mv AS (SELECT *, CASE WHEN hx <> 0 OR hy <> 0 THEN hx * tx + hy * ty END AS align FROM kn JOIN nr USING (event_id))"
GRID = """cl AS (SELECT session_id, floor_id, ts_us, event_id FROM trk JOIN cam USING (cam_id)),
tk0 AS (SELECT session_id, floor_id, t0, t1, unnest(range(1, CAST(ceil((t1 - t0) / 1e6) AS BIGINT) + 1)) AS k FROM sess),
tk1 AS (SELECT *, least(t1, t0 + k * 1000000) AS tick_us FROM tk0),
tick AS (SELECT session_id, floor_id, k, t0, tick_us, (tick_us - t0 - (k - 1) * 1000000) / 1e6 AS dt,
  coalesce(min({'t': ts_us, 'e': event_id}) FILTER (WHERE tick_us = t0 + k * 1000000 AND ts_us >= tick_us), max({'t': ts_us, 'e': event_id})) AS c
  FROM tk1 JOIN cl USING (session_id, floor_id) GROUP BY ALL)"""


def _states_sql(source):
    """Each tick's rows: the object's last before the call, unless dropped."""
    return f"""{GRID}, st0 AS (SELECT session_id, floor_id, k, t0, tick_us, gid, max({{'t': ts_us, 'e': event_id, 'i': in_roi}}) AS m, any_value(c) AS c
  FROM tick JOIN tc USING (session_id, floor_id) WHERE ts_us < c.t OR (ts_us = c.t AND event_id <= c.e) GROUP BY ALL),
st AS (SELECT st0.session_id, st0.floor_id, st0.k, st0.t0, st0.tick_us, {source}.* EXCLUDE (session_id, floor_id{', k' if source == 'mv' else ''}) FROM st0 JOIN {source} ON m.e = event_id WHERE m.i AND c.t - m.t <= 3000000)"""


STATES = f"{MOVE}, {_states_sql('mv')}"
INZ = f"zin AS (SELECT session_id, floor_id, k, gid, kind, zone FROM (SELECT st.session_id, st.floor_id, k, gid, x, y, kind, zone, x1, y1, x2, y2 FROM st JOIN zn ON zn.floor_id = st.floor_id JOIN ze USING (kind, zone)) GROUP BY session_id, floor_id, k, gid, kind, zone HAVING {_within('x', 'y')})"
COUNTS = f"""{SEEN}, {_states_sql('seen')}, {INZ},
cn AS (SELECT tick.session_id, tick.floor_id, tick.k, tick.tick_us, tick.t0, tick.dt, zn.zone, any_value(area) AS area, any_value(crit) AS crit, any_value(weight) AS weight, count(gid) AS n
  FROM tick JOIN zn ON zn.floor_id = tick.floor_id AND zn.kind = 'b' LEFT JOIN zin ON zin.session_id = tick.session_id AND zin.floor_id = tick.floor_id AND zin.k = tick.k AND zin.zone = zn.zone AND zin.kind = 'b'
  GROUP BY tick.session_id, tick.floor_id, tick.k, tick.tick_us, tick.t0, tick.dt, zn.zone),
held AS (SELECT *, n / area AS rho, lag(n / area) OVER (PARTITION BY session_id, floor_id, zone ORDER BY k) AS held FROM cn)"""


def _cbs(crit="crit", weight="weight"):
    return f"""cb0 AS (SELECT session_id, floor_id, zone, round(sum(greatest(coalesce(held - {crit}, 0e0), 0e0) * {weight} * dt), 6) AS cbs,
  round(sum(CASE WHEN held > {crit} THEN dt ELSE 0e0 END), 6) AS over_sec, round(max(rho), 6) AS peak FROM held GROUP BY ALL),
cb AS (SELECT *, CASE WHEN cbs <= 0 OR cbs * 3 <= max(cbs) OVER w THEN 'low' WHEN cbs * 3 <= max(cbs) OVER w * 2 THEN 'mid' ELSE 'high' END AS risk FROM cb0 WINDOW w AS (PARTITION BY session_id, floor_id))"""


_D = "((xb - xa) * (y - ya) - (yb - ya) * (x - xa)) / sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) * CASE WHEN (xb - xa) * (wy - ya) - (yb - ya) * (wx - xa) >= 0 THEN 1 ELSE -1 END"
CROSS = f"""xr0 AS (SELECT seen.session_id, seen.floor_id, gid, seg, event_id, ts_us, exit_id, {_D} AS d, ((x - xa) * (xb - xa) + (y - ya) * (yb - ya)) / ((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS t FROM seen JOIN xs USING (floor_id)),
xr1 AS (SELECT *, d > 0 AS inner_side, lag(d > 0) OVER (PARTITION BY session_id, floor_id, exit_id, gid, seg ORDER BY ts_us, event_id) AS was FROM xr0 WHERE abs(d) >= 10),
cr AS (SELECT *, CASE WHEN inner_side THEN 'in' ELSE 'out' END AS direction FROM xr1 WHERE was IS NOT NULL AND was <> inner_side AND t >= -0.06 AND t <= 1.06)"""
EXITS = f"""{SEEN}, {CROSS},
ex AS (SELECT sess.session_id, sess.floor_id, xs.exit_id, any_value(capacity) AS capacity, count(DISTINCT CASE WHEN direction = 'in' THEN gid END) AS n_in, count(DISTINCT CASE WHEN direction = 'out' THEN gid END) AS n_out
  FROM sess JOIN xs ON xs.floor_id = sess.floor_id LEFT JOIN cr ON cr.session_id = sess.session_id AND cr.exit_id = xs.exit_id GROUP BY sess.session_id, sess.floor_id, xs.exit_id),
sh AS (SELECT *, n_out / nullif(sum(n_out) OVER w, 0) AS actual, capacity / nullif(sum(capacity) OVER w, 0) AS design FROM ex WHERE capacity IS NOT NULL WINDOW w AS (PARTITION BY session_id, floor_id)),
se AS (SELECT session_id, floor_id, round((1 - sum(abs(actual - design)) / 2) * 100, 6) AS sei FROM sh GROUP BY ALL)"""
DEV = f"""{NEAR},
dv0 AS (SELECT seen.*, first_value(nr.r) OVER (PARTITION BY session_id, floor_id, gid ORDER BY ts_us, event_id) AS route FROM seen JOIN nr USING (event_id)),
dv AS (SELECT dv0.event_id, any_value(session_id) AS session_id, any_value(dv0.floor_id) AS floor_id, any_value(gid) AS gid, any_value(ts_us) AS ts_us, any_value(route) AS route, sqrt(min(d2)) * 0.01::DOUBLE AS d
  FROM dv0 JOIN nr1 ON nr1.event_id = dv0.event_id AND nr1.r = route GROUP BY dv0.event_id)"""
EPFI = f"""{SEEN}, {DEV},
ep0 AS (SELECT *, lag(d) OVER w AS d0, (ts_us - lag(ts_us) OVER w) / 1e6 AS dt FROM dv WINDOW w AS ({_OBJ})),
ep1 AS (SELECT session_id, floor_id, gid, route, sum((d + d0) / 2 * dt) AS area, (max(ts_us) - min(ts_us)) / 1e6 AS duration, round(max(d), 6) AS max_deviation FROM ep0 GROUP BY ALL),
ep AS (SELECT session_id, floor_id, gid, route, round(duration, 6) AS duration, max_deviation, CASE WHEN duration >= 2 THEN round(greatest(0e0, 1e0 - area / (duration * 2e0)) * 100, 6) END AS epfi FROM ep1)"""
_EPFI_ONLY = EPFI[len(SEEN) + 2 :]
_EXITS_ONLY = EXITS[len(SEEN) + 2 :]
_COUNTS_ONLY = COUNTS[len(SEEN) + 2 :]


def _cond(site):
    return f"""{STATES}, {INZ},
zc0 AS (SELECT session_id, floor_id, k, tick_us, t0, zone, avg(speed) AS v_e, avg(align) AS a_e, count(*) FILTER (WHERE speed >= {num(site.v_th)} AND align >= {num(site.a_th)}) / count(*) AS r_e, count(*) AS n
  FROM st JOIN zin USING (session_id, floor_id, k, gid) WHERE kind = 'z' GROUP BY ALL),
zc AS (SELECT *, coalesce(v_e >= {num(site.v_th)} AND a_e >= {num(site.a_th)} AND r_e >= {num(site.r_th)}, false) AS holds FROM zc0)"""


def _onset_sql(site):
    return f"""{_cond(site)},
ru AS (SELECT *, k - row_number() OVER (PARTITION BY session_id, floor_id, zone ORDER BY k) AS run FROM zc WHERE holds),
rv AS (SELECT *, min(tick_us) OVER (PARTITION BY session_id, floor_id, zone, run) AS start_us FROM ru),
os AS (SELECT session_id, floor_id, zone, start_us, (start_us - t0) / 1e6 AS delay_sec, round(r_e, 6) AS participants
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, floor_id, zone ORDER BY k) AS nth FROM rv WHERE (tick_us - start_us) / 1e6 >= {site.dt_hold}) WHERE nth = 1)"""


ONSET = _onset_sql(LOOSE)
_N = int(-(-S.height // S.cell))
_ORIGINS = _values([(i, *p) for i, p in enumerate(S.origins)], "origin, ox, oy")
DIST = f"""ga AS (SELECT i // {_N} AS row, i % {_N} AS col, (i % {_N} + 0.5::DOUBLE) * {num(S.cell)} AS cx, (i // {_N} + 0.5::DOUBLE) * {num(S.cell)} AS cy FROM range({_N * _N}) AS t(i)),
gz AS (SELECT zone, row, col FROM (SELECT * FROM ga, ze WHERE kind = 'z') GROUP BY zone, row, col HAVING count(*) FILTER (WHERE {_HIT.format(x='cx', y='cy')}) % 2 = 1),
zm AS (SELECT zone, avg(x1) AS mx, avg(y1) AS my FROM ze WHERE kind = 'z' GROUP BY zone),
og AS {_ORIGINS},
zd AS (SELECT zone, origin, coalesce(avg(abs(row - least({_N - 1}, greatest(0, floor(oy / {num(S.cell)})))) + abs(col - least({_N - 1}, greatest(0, floor(ox / {num(S.cell)}))))) * {num(S.cell / 100)},
  any_value(sqrt((ox - mx) * (ox - mx) + (oy - my) * (oy - my))) * 0.01::DOUBLE) AS distance FROM zm CROSS JOIN og LEFT JOIN gz USING (zone) GROUP BY zone, origin)"""
IDR = f"""{DIST},
ir AS (SELECT sess.session_id, sess.floor_id, zn.zone, round(avg(CASE WHEN delay_sec IS NOT NULL THEN distance / greatest(delay_sec, 1e-6) END), 6) AS idr, round(max(delay_sec), 6) AS delay_sec,
  round(avg(distance), 6) AS mean_distance, max(participants) AS participants, CASE WHEN max(delay_sec) IS NULL THEN 'not_started' ELSE 'started' END AS status
  FROM sess JOIN zn ON zn.floor_id = sess.floor_id AND kind = 'z' JOIN zd ON zd.zone = zn.zone LEFT JOIN os ON os.session_id = sess.session_id AND os.floor_id = sess.floor_id AND os.zone = zn.zone GROUP BY sess.session_id, sess.floor_id, zn.zone)"""
SNAP = f"""{SEEN},
sn0 AS (SELECT session_id, floor_id, gid, max({{'t': ts_us, 'e': event_id, 'i': in_roi}}) AS m FROM tc GROUP BY ALL),
ck AS (SELECT session_id, floor_id, max(ts_us) AS now_us FROM pr0 GROUP BY ALL),
sn AS (SELECT seen.* FROM sn0 JOIN ck USING (session_id, floor_id) JOIN seen ON seen.event_id = m.e WHERE m.i AND now_us - m.t <= 3000000),
sz AS (SELECT event_id, session_id, floor_id, kind, zone, ord FROM (SELECT sn.event_id, sn.session_id, sn.floor_id, x, y, kind, zone, ord, x1, y1, x2, y2 FROM sn JOIN zn ON zn.floor_id = sn.floor_id JOIN ze USING (kind, zone)) GROUP BY event_id, session_id, floor_id, kind, zone, ord HAVING {_within('x', 'y')})"""


def _occupied(kind, more=""):
    return f"""WITH {SNAP} SELECT session_id, floor_id, zone, n, round(n / area, 3) AS density{more} FROM (SELECT sess.session_id, sess.floor_id, zn.zone, any_value(area) AS area, any_value(crit) AS crit, count(event_id) AS n
  FROM sess JOIN zn ON zn.floor_id = sess.floor_id AND zn.kind = '{kind}' LEFT JOIN sz ON sz.session_id = sess.session_id AND sz.zone = zn.zone AND sz.kind = zn.kind GROUP BY sess.session_id, sess.floor_id, zn.zone)"""


QUALITY = """un AS (SELECT session_id, floor_id, count(*) FILTER (WHERE cam_id = 'cam3') AS unmapped FROM trk GROUP BY ALL),
ql AS (SELECT session_id, floor_id, any_value(unmapped) AS unmapped, count(*) FILTER (WHERE NOT in_roi) AS outside, count(*) FILTER (WHERE in_roi) AS points, count(DISTINCT CASE WHEN in_roi THEN gid END) AS tracks,
  coalesce(string_agg(DISTINCT CASE WHEN in_roi THEN cam_id END, ',' ORDER BY CASE WHEN in_roi THEN cam_id END), '') AS cameras FROM un LEFT JOIN tc USING (session_id, floor_id) GROUP BY session_id, floor_id),
qu AS (SELECT session_id, floor_id, points, unmapped + outside AS dropped, tracks, cameras, round(coalesce((unmapped + outside) / nullif(unmapped + outside + points, 0), 0), 4) AS dropped_ratio, '' AS warnings FROM ql)"""
# every table of a session: epfi ep, congestion cb, exits ex, shares sh, response ir, quality qu
_COND_ONLY = ONSET[len(MOVE) + 2 :]
FACTS = f"""{MOVE}, {_EPFI_ONLY.replace(NEAR + ',', '', 1).lstrip()}, {_EXITS_ONLY}, {_COND_ONLY}, {IDR},
cn AS (SELECT tick.session_id, tick.floor_id, tick.k, tick.tick_us, tick.dt, zn.zone, any_value(area) AS area, any_value(crit) AS crit, any_value(weight) AS weight, count(gid) AS n
  FROM tick JOIN zn ON zn.floor_id = tick.floor_id AND zn.kind = 'b' LEFT JOIN zin ON zin.session_id = tick.session_id AND zin.floor_id = tick.floor_id AND zin.k = tick.k AND zin.zone = zn.zone AND zin.kind = 'b'
  GROUP BY tick.session_id, tick.floor_id, tick.k, tick.tick_us, tick.dt, zn.zone),
held AS (SELECT *, n / area AS rho, lag(n / area) OVER (PARTITION BY session_id, floor_id, zone ORDER BY k) AS held FROM cn), {_cbs()}, {QUALITY},
fa AS (SELECT session_id, floor_id, t0, t1, (SELECT round(avg(epfi), 6) FROM ep WHERE ep.session_id = s.session_id AND ep.floor_id = s.floor_id) AS epfi_avg,
  (SELECT round(sum(cbs), 6) FROM cb WHERE cb.session_id = s.session_id AND cb.floor_id = s.floor_id) AS cbs_total,
  (SELECT sei FROM se WHERE se.session_id = s.session_id AND se.floor_id = s.floor_id) AS sei,
  (SELECT count(*) FILTER (WHERE status = 'started') FROM ir WHERE ir.session_id = s.session_id AND ir.floor_id = s.floor_id) AS zones_started,
  (SELECT count(*) FROM ir WHERE ir.session_id = s.session_id AND ir.floor_id = s.floor_id) AS zones_total,
  (SELECT round(min(delay_sec), 6) FROM ir WHERE ir.session_id = s.session_id AND ir.floor_id = s.floor_id) AS first_start,
  (SELECT coalesce(sum(n_out), 0) FROM ex WHERE ex.session_id = s.session_id AND ex.floor_id = s.floor_id) AS passed,
  (SELECT count(*) FROM ep WHERE ep.session_id = s.session_id AND ep.floor_id = s.floor_id) AS persons FROM sess s)"""
_POOL = """pe AS (SELECT *, sum(n_out) OVER w AS sume, sum(capacity) OVER w AS sumc FROM ex WHERE capacity <> 0 WINDOW w AS (PARTITION BY session_id)),
po AS (SELECT session_id, CASE WHEN any_value(sume) > 0 THEN round((1 - sum(abs(n_out / sume - capacity / sumc)) / 2) * 100, 6) END AS sei FROM pe GROUP BY session_id)"""
BUILDING = f"""{FACTS}, {_POOL},
bu AS (SELECT fa.session_id, 'building' AS floor_id, (SELECT round(avg(epfi), 6) FROM ep WHERE ep.session_id = fa.session_id) AS epfi_avg, round(sum(cbs_total), 4) AS cbs_total, any_value(po.sei) AS sei,
  CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(persons) AS BIGINT) AS persons, arg_max(fa.floor_id, {{'c': coalesce(cbs_total, 0), 'o': CASE fa.floor_id WHEN 'f0' THEN 1 ELSE 0 END}}) AS max_cbs_floor, min(first_start) AS first_start FROM fa LEFT JOIN po USING (session_id) GROUP BY fa.session_id)"""
_GLOBAL = {"as_is": None, "dense": 0.125, "mixed": 0.25}


def _replay_sql():
    parts = []
    for name, rho in _GLOBAL.items():
        crit = "crit" if rho is None else num(rho)
        if name == "mixed":
            crit = f"CASE zone WHEN 'b1' THEN 5e-1 ELSE {crit} END"
        weight = "CASE zone WHEN 'b1' THEN 4e0 ELSE weight END" if name == "mixed" else "weight"
        cap = "CASE exit_id WHEN 'e2' THEN 80 WHEN 'e3' THEN 10 ELSE capacity END" if name == "mixed" else "capacity"
        parts.append(
            f"""SELECT '{name}' AS variant, session_id, floor_id, cbs_total, sei FROM (SELECT session_id, floor_id, round(sum(c), 6) AS cbs_total FROM (SELECT session_id, floor_id, zone, round(sum(greatest(coalesce(held - {crit}, 0e0), 0e0) * {weight} * dt), 6) AS c FROM held GROUP BY ALL) GROUP BY ALL)
LEFT JOIN (SELECT session_id, floor_id, round((1 - sum(abs(actual - design)) / 2) * 100, 6) AS sei FROM (SELECT session_id, floor_id, n_out / nullif(sum(n_out) OVER w, 0) AS actual, cap / nullif(sum(cap) OVER w, 0) AS design FROM (SELECT *, {cap} AS cap FROM ex) WHERE cap IS NOT NULL WINDOW w AS (PARTITION BY session_id, floor_id)) GROUP BY ALL) USING (session_id, floor_id)"""
        )
    return " UNION ALL ".join(parts)


_FRAME = "cf AS (SELECT cam_id, ts_us // 1000000 AS frame, gid, max({'t': ts_us, 'e': event_id, 'u': u, 'v': v}) AS m FROM tracks GROUP BY ALL), ci AS (SELECT cam_id, frame, row_number() OVER (PARTITION BY cam_id ORDER BY frame) AS f FROM (SELECT DISTINCT cam_id, frame FROM cf))"
def _thresholds_sql(pooled):
    """Each variant evaluated by itself; ``pooled``: rolled up by session."""
    parts = []
    for name, change in REPLAYS.items():
        v = replace(LOOSE, **change.get("thresholds", {}))
        crit = num(change["rho_crit"]) if "rho_crit" in change else "CASE zone WHEN 'b1' THEN 5e-1 ELSE crit END" if name == "mixed" else "crit"
        weight = "CASE zone WHEN 'b1' THEN 4e0 ELSE weight END" if name == "mixed" else "weight"
        cap = "CASE exit_id WHEN 'e2' THEN 80 WHEN 'e3' THEN 10 ELSE capacity END" if name == "mixed" else "capacity"
        over, none = ("session_id", "nullif({cap}, 0)") if pooled else ("session_id, floor_id", "{cap}")
        here = " AND ".join(f"q.{c.strip()} = s.{c.strip()}" for c in over.split(","))
        parts.append(f"""SELECT * FROM (WITH {FACTS.replace(_COND_ONLY, _onset_sql(v)[len(MOVE) + 2 :])},
vp AS (SELECT *, CASE WHEN duration >= 2 THEN round(greatest(0e0, 1e0 - area / (duration * {num(v.d_allow)})) * 100, 6) END AS score FROM ep1),
vc AS (SELECT session_id, floor_id, zone, round(sum(greatest(coalesce(held - {crit}, 0e0), 0e0) * {weight} * dt), 6) AS cbs FROM held GROUP BY ALL),
vx AS (SELECT *, {none.format(cap=cap)} AS cap FROM ex),
vs AS (SELECT session_id, floor_id, n_out / nullif(sum(n_out) OVER w, 0) AS actual, cap / nullif(sum(cap) OVER w, 0) AS design FROM vx WHERE cap IS NOT NULL WINDOW w AS (PARTITION BY {over}))
SELECT '{name}' AS variant, {over}, {'count(*) AS floors,' if pooled else ''} (SELECT count(*) FROM ir q WHERE status = 'started' AND {here}) AS zones_started,
  {'' if pooled else f'(SELECT round(avg(idr), 6) FROM ir q WHERE {here}) AS idr_avg,'} (SELECT round(avg(score), 6) FROM vp q WHERE {here}) AS epfi_avg,
  (SELECT round(sum(cbs), {4 if pooled else 6}) FROM vc q WHERE {here}) AS cbs_total, (SELECT round((1 - sum(abs(actual - design)) / 2) * 100, 6) FROM vs q WHERE {here}) AS sei
FROM sess s GROUP BY ALL)""")
    return " UNION ALL ".join(parts)


COUNTER = f"""{TRACKS_SQL}, {_FRAME},
cg AS (SELECT cam_id, gid, f, 500 - m.u AS d, m.v / 1000 AS t, f - lag(f) OVER (PARTITION BY cam_id, gid ORDER BY f) AS gap FROM cf JOIN ci USING (cam_id, frame)),
ch AS (SELECT *, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cam_id, gid ORDER BY f ROWS UNBOUNDED PRECEDING) AS isle FROM cg),
cj AS (SELECT *, d > 0 AS s, lag(d > 0) OVER (PARTITION BY cam_id, gid, isle ORDER BY f) AS p FROM ch WHERE abs(d) >= 6),
ck AS (SELECT cam_id, count(*) FILTER (WHERE s AND NOT p AND t BETWEEN -0.06 AND 1.06) AS n_in, count(*) FILTER (WHERE NOT s AND p AND t BETWEEN -0.06 AND 1.06) AS n_out FROM cj GROUP BY cam_id)"""
_DENSITY = "string_agg(zone || '=' || printf('%.4f', round(rho, 4)), ',' ORDER BY zone)"
TIMELINE = f"{COUNTS}, tl AS (SELECT session_id, floor_id, k, {_DENSITY} AS density, CAST(sum(n) AS BIGINT) AS people FROM held GROUP BY ALL)"

ORACLE = {
    "zone_occupancy": _occupied("z"),
    "floor_view_zones": f"SELECT session_id, floor_id, zone, n, 'cam1' AS cameras FROM ({_occupied('z')}) WHERE floor_id = 'f1'",
    "bottleneck_state": _occupied("b", ", round(n / area, 3) > crit AS over"),
    "object_labels": f"WITH {SNAP} SELECT session_id, floor_id, gid, event_id, (SELECT arg_min(zone, ord) FROM sz WHERE sz.event_id = sn.event_id AND kind = 'z') AS zone, round(x, 6) AS x, round(y, 6) AS y, x >= 0 AND x <= 1000 AND y >= 0 AND y <= 1000 AS in_map FROM sn",
    "floor_routing": f"WITH {TRK} SELECT cam_id, floor_id, count(*) AS n FROM trk GROUP BY ALL",
    "min_conf_filter": f"WITH {TRK} SELECT cam_id, count(*) AS n FROM trk LEFT JOIN cam USING (cam_id) WHERE conf >= coalesce(least, {S.min_conf}) GROUP BY cam_id",
    "roi_filter": f"WITH {PROJ} SELECT cam_id, count(*) FILTER (WHERE in_roi) AS n_in, count(*) FILTER (WHERE NOT in_roi) AS n_out FROM proj GROUP BY cam_id",
    "homography_project": f"WITH {PROJ} SELECT event_id, round(x, 6) AS x, round(y, 6) AS y, x >= 0 AND x <= 1000 AND y >= 0 AND y <= 1000 AS in_map FROM proj",
    "window_speed": f"WITH {KIN} SELECT event_id, gid, seg, round(speed, 6) AS speed, round(hx, 6) AS hx, round(hy, 6) AS hy FROM kn",
    "route_alignment": f"WITH {MOVE} SELECT event_id, r AS route, k AS piece, round(align, 6) AS align FROM mv",
    "dwell_time": f"WITH {SEEN} SELECT session_id, floor_id, gid, seg, max(ts_us) - min(ts_us) AS dwell_us FROM seen GROUP BY ALL",
    "lost_timeout_sessions": f"WITH {SEEN} SELECT session_id, floor_id, gid, seg, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM seen GROUP BY ALL",
    "acceleration": f"WITH {KIN} SELECT event_id, round(CASE WHEN d0 > 0 THEN abs(speed - s0) / d0 END, 6) AS acceleration FROM (SELECT *, lag(speed) OVER w AS s0, (ts_us - lag(ts_us) OVER w) / 1e6 AS d0 FROM kn WINDOW w AS (PARTITION BY session_id, floor_id, gid, seg ORDER BY ts_us, event_id))",
    "exit_crossings": f"WITH {SEEN}, {CROSS} SELECT exit_id, gid, event_id, direction FROM cr",
    "exit_counts_debounced": f"WITH {EXITS} SELECT session_id, floor_id, exit_id, n_in, n_out FROM ex",
    "occupancy_counter": f"WITH {COUNTER} SELECT c.cam_id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, 10 + coalesce(n_in, 0) - coalesce(n_out, 0) AS occupancy, 10 + coalesce(n_in, 0) - coalesce(n_out, 0) < 0 AS alert, c.present FROM (SELECT cam_id, count(*) AS present FROM ch WHERE f = (SELECT max(f) FROM ci WHERE ci.cam_id = ch.cam_id) GROUP BY cam_id) c LEFT JOIN ck USING (cam_id)",
    "exit_share": f"WITH {EXITS} SELECT session_id, floor_id, exit_id, round(actual, 9) AS actual, round(design, 9) AS design FROM sh",
    "sei_score": f"WITH {EXITS} SELECT session_id, floor_id, sei FROM se",
    "exit_deviation": f"WITH {EXITS} SELECT session_id, floor_id, exit_id, ex.n_out, round(actual - design, 4) AS delta, ex.n_out = 0 AND coalesce(design, 0) > 0 AS unused, row_number() OVER (PARTITION BY session_id, floor_id ORDER BY abs(coalesce(round(actual - design, 4), 0)) DESC, exit_id) AS place FROM ex LEFT JOIN sh USING (session_id, floor_id, exit_id)",
    "route_deviation": f"WITH {SEEN}, {DEV} SELECT event_id, route, round(d, 6) AS deviation FROM dv",
    "epfi_person": f"WITH {EPFI} SELECT * FROM ep",
    "epfi_avg": f"WITH {EPFI} SELECT session_id, floor_id, round(avg(epfi), 6) AS epfi_avg, count(epfi) AS n FROM ep GROUP BY ALL",
    "tick_density": f"WITH {COUNTS} SELECT session_id, floor_id, k, zone, n, round(rho, 6) AS rho FROM held",
    "cbs_bottleneck": f"WITH {COUNTS}, {_cbs()} SELECT * FROM cb",
    "zone_conditions": f"WITH {_cond(S)} SELECT session_id, floor_id, k, zone, round(v_e, 6) AS v_e, round(a_e, 6) AS a_e, round(r_e, 6) AS r_e, n, holds FROM zc",
    "zone_onset_hold": f"WITH {ONSET} SELECT * FROM os",
    "idr_zone": f"WITH {ONSET}, {IDR} SELECT * FROM ir",
    "idr_average": f"WITH {ONSET}, {IDR} SELECT session_id, floor_id, round(avg(idr), 6) AS idr_avg, count(*) FILTER (WHERE status = 'started') AS started FROM ir GROUP BY ALL",
    "grid_zone_distance": f"WITH {TRK}, {DIST} SELECT zone, origin, round(distance, 6) AS distance FROM zd",
    "session_timeline": f"WITH {TIMELINE} SELECT * FROM tl",
    "session_quality": f"WITH {SEEN}, {QUALITY} SELECT * FROM qu",
    "replay_sweep_dallow": f"WITH {EPFI} SELECT session_id, floor_id, d_allow, round(avg(CASE WHEN duration >= 2 THEN round(greatest(0e0, 1e0 - area / (duration * d_allow)) * 100, 6) END), 6) AS epfi_avg FROM ep1, (SELECT unnest([0.5::DOUBLE, 1, 2, 4]) AS d_allow) GROUP BY ALL",
    "replay_sweep_rhocrit": f"WITH {COUNTS} SELECT variant, session_id, floor_id, round(sum(cbs), 6) AS cbs_total FROM (SELECT variant, session_id, floor_id, zone, round(sum(greatest(coalesce(held - CAST(variant AS DOUBLE), 0e0), 0e0) * weight * dt), 6) AS cbs FROM held, (SELECT unnest(['0.125', '0.25', '0.5', '1.0']) AS variant) GROUP BY ALL) GROUP BY ALL",
    "replay_overrides": f"WITH {COUNTS}, {_EXITS_ONLY} {_replay_sql()}",
    "replay_thresholds": _thresholds_sql(False),
    "drill_replay": _thresholds_sql(True),
    "session_list": f"WITH {FACTS} SELECT session_id, floor_id, t0 AS alarm_us, (t1 - t0) / 1e6 AS elapsed_sec, epfi_avg, cbs_total, sei, zones_started, zones_total, persons, CAST(passed AS BIGINT) AS passed, row_number() OVER (PARTITION BY floor_id ORDER BY t0 DESC) AS newest FROM fa",
    "session_digest": f"WITH {FACTS} SELECT session_id, floor_id, CASE WHEN dropped_ratio >= 0.30 OR tracks < 10 THEN 'insufficient' WHEN dropped_ratio >= 0.15 OR (t1 - t0) / 1e6 < 30 THEN 'caution' ELSE 'ok' END AS verdict, dropped_ratio, tracks, cameras, (t1 - t0) / 1e6 AS duration FROM fa JOIN qu USING (session_id, floor_id)",
    "drill_rollup": f"WITH {BUILDING} SELECT * FROM bu UNION ALL SELECT session_id, floor_id, epfi_avg, round(cbs_total, 4), sei, CAST(passed AS BIGINT), persons, NULL, first_start FROM fa",
    "drill_list": f"WITH {BUILDING} SELECT session_id, min(t0) AS alarm_us, string_agg(fa.floor_id, ',' ORDER BY fa.floor_id) AS floors, any_value(bu.epfi_avg) AS epfi_avg, any_value(bu.cbs_total) AS cbs_total, any_value(bu.sei) AS sei FROM fa JOIN bu USING (session_id) GROUP BY session_id HAVING count(*) = 2",
    "drill_common_sessions": f"WITH {TRK} SELECT session_id, count(*) AS n FROM trk GROUP BY session_id HAVING count(DISTINCT floor_id) = 2",
    "metrics_eav_export": f"WITH {FACTS} " + " UNION ALL ".join(
        [f"SELECT session_id, floor_id, 'bottleneck' AS kind, zone AS id, '{c}' AS k, CAST({c} AS DOUBLE) AS v FROM cb" for c in ("cbs", "over_sec", "peak")]
        + [f"SELECT session_id, floor_id, 'person', gid, '{c}', CAST({c} AS DOUBLE) FROM ep" for c in ("duration", "max_deviation", "epfi")]
        + [f"SELECT session_id, floor_id, 'exit', exit_id, '{c}', CAST({c} AS DOUBLE) FROM ex" for c in ("n_in", "n_out")]
        + [f"SELECT session_id, floor_id, 'zone', zone, '{c}', CAST({c} AS DOUBLE) FROM ir" for c in ("idr", "delay_sec", "mean_distance")]
        + [f"SELECT session_id, floor_id, 'summary', floor_id, '{c}', CAST({c} AS DOUBLE) FROM fa" for c in ("epfi_avg", "cbs_total", "sei")]
    ),
    "digest_quartiles": f"WITH {EPFI}, qs AS (SELECT route, list(epfi ORDER BY epfi) AS s FROM ep WHERE epfi IS NOT NULL GROUP BY route) SELECT route, CAST(len(s) AS BIGINT) AS n, round(s[1], 2) AS least, round(s[len(s) // 4 + 1], 2) AS p25, round((s[(len(s) - 1) // 2 + 1] + s[len(s) // 2 + 1]) / 2, 2) AS median, round(s[(3 * len(s)) // 4 + 1], 2) AS p75, round(s[len(s)], 2) AS largest, round(list_avg(s), 2) AS mean FROM qs",
    "digest_surges": f"WITH {COUNTS}, sq AS (SELECT *, (tick_us - t0) / 1e6 AS t, (tick_us - lag(tick_us) OVER (PARTITION BY session_id, floor_id, zone ORDER BY k)) / 1e6 AS step FROM held) SELECT session_id, floor_id, zone, round(max(rho), 3) AS peak, CASE WHEN max(rho) > 0 THEN round(arg_min(t, {{'a': -rho, 'k': k}}), 1) END AS peak_at, round(min(CASE WHEN rho > 0 THEN t END), 1) AS first_on, round(max(CASE WHEN rho > 0 THEN t END), 1) AS last_on, round(count(CASE WHEN rho > 0 THEN t END) * round(coalesce(quantile_cont(step, 0.5), 1), 3), 1) AS on_sec FROM sq GROUP BY ALL",
    "bottleneck_ranks": f"WITH {COUNTS}, {_cbs()} SELECT session_id, floor_id, zone, cbs, risk, row_number() OVER (PARTITION BY session_id, floor_id ORDER BY cbs DESC, peak DESC, zone) AS place FROM cb",
    "worst_epfi_topk": f"WITH {EPFI} SELECT session_id, gid, epfi FROM ep WHERE epfi IS NOT NULL ORDER BY epfi, session_id, gid LIMIT 8",
    "timeline_thin": f"WITH {TIMELINE}, th AS (SELECT *, row_number() OVER (PARTITION BY session_id, floor_id ORDER BY k) - 1 AS p, count(*) OVER (PARTITION BY session_id, floor_id) AS total FROM tl) SELECT * EXCLUDE (p, total) FROM th WHERE total <= 5 OR list_contains([floor(i * total / 5) FOR i IN range(5)], p)",
    "epfi_histogram": f"WITH {EPFI}, hb AS (SELECT greatest(0, least(9, CAST(floor(epfi / 1e1) AS INTEGER))) AS bin, count(*) AS n FROM ep WHERE epfi IS NOT NULL GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(10) AS t(i) LEFT JOIN hb ON hb.bin = i",
    "person_series": f"WITH {SEEN}, {DEV}, {GRID}, ps AS (SELECT session_id, floor_id, gid, k, tick_us, max({{'t': dv.ts_us, 'e': event_id, 'd': d}}) AS m FROM tick JOIN dv USING (session_id, floor_id) WHERE dv.ts_us < c.t OR (dv.ts_us = c.t AND event_id <= c.e) GROUP BY ALL) SELECT session_id, floor_id, gid, k, round(m.d, 6) AS d FROM ps WHERE tick_us - m.t <= 3000000",
}

QUERIES = {
    f.__name__: f
    for f in (
        zone_occupancy, floor_view_zones, bottleneck_state, object_labels, floor_routing, min_conf_filter, roi_filter, homography_project, window_speed,
        route_alignment, dwell_time, lost_timeout_sessions, acceleration, exit_crossings, exit_counts_debounced, occupancy_counter,
        exit_share, sei_score, exit_deviation, route_deviation, epfi_person, epfi_avg, tick_density, cbs_bottleneck, zone_conditions,
        zone_onset_hold, idr_zone, idr_average, grid_zone_distance, session_timeline, session_quality, replay_sweep_dallow,
        replay_sweep_rhocrit, replay_overrides, replay_thresholds, drill_replay, session_list, session_digest, drill_rollup, drill_list, drill_common_sessions,
        metrics_eav_export, digest_quartiles, digest_surges, bottleneck_ranks, worst_epfi_topk, timeline_thin, epfi_histogram,
        person_series,
    )
}
