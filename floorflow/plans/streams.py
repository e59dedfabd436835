"""Registered queries that run as streams, and the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observations as obs, session
from ..operators.observations import KEY
from ..operators import lifecycle as life
from ..sources.tracks import TRACKS_SQL, from_events
from ..streaming import engine, live, reload
from . import crowd, lifecycle
from .site import SITE

S = SITE
#: Micro-batches that a table is replayed in.
PARTS = 3


def _live(spark, d):
    events = engine.replayed(spark, spark.read.parquet(f"{d}/events.parquet"), "ts", PARTS)
    return engine.run(engine.engine(from_events(events), S))


def live_speed(spark, d):
    rows = engine.motion(_live(spark, d))
    return rows.select("event_id", "gid", "seg", *(F.round(c, 6).alias(c) for c in ("speed", "hx", "hy")))


def live_visits(spark, d):
    return engine.visits(_live(spark, d))


def live_tick_density(spark, d):
    grid, states = engine.samples(_live(spark, d))
    counts = obs.counted(states, grid, S, S.bottlenecks, [*KEY, "k"])
    return session.with_density(counts, S).select(*KEY, "k", "zone", "n", F.round("rho", 6).alias("rho"))


def live_exit_counts(spark, d):
    """Counts of a stream whose lines' versions lie in a table beside it."""
    path = live.fresh_folder(spark)
    lifecycle._versions(spark, d).write.parquet(f"{path}/versions")
    events = engine.replayed(spark, spark.read.parquet(f"{d}/events.parquet"), "ts", PARTS)
    seen = from_events(events).selectExpr("floor_id", "gid", "0 AS seg", "ts_us", "event_id AS n", "u AS x", "v AS y")
    reload.follow(seen, lambda s: s.read.parquet(f"{path}/versions"), path, 12.0).awaitTermination()
    return reload.counted(spark, path)


def newest_frames(spark, d):
    """A camera's newest row of each trigger and how many it hid."""
    events = engine.replayed(spark, spark.read.parquet(f"{d}/events.parquet"), "ts", PARTS)
    rows = live.follow_newest(from_events(events).select("cam_id", "ts_us", "event_id", "gid"), "cam_id")
    return rows.select("batch", "cam_id", "event_id", "gid", "dropped")


def drill_starts(spark, d):
    """Every twentieth event asks for a drill, with origins on some floors."""
    tracks = from_events(spark.read.parquet(f"{d}/events.parquet"))
    asked = tracks.where("event_id % 20 = 5").selectExpr(
        "event_id AS n", "ts_us AS at_us", "CASE WHEN event_id % 3 = 0 THEN ts_us + 1000 END AS alarm_us",
        "CASE WHEN event_id % 100 = 5 THEN array('f1') WHEN event_id % 100 = 25 THEN CAST(array() AS ARRAY<STRING>) ELSE array('f1', 'f0') END AS origins",
    )
    return life.drill_starts(asked, S.taking_part(), life.session_spans(lifecycle._commands(spark, d)))


QUERIES = {f.__name__: f for f in (live_speed, live_visits, live_tick_density, live_exit_counts, newest_frames, drill_starts)}
ORACLE = {
    "live_speed": crowd.ORACLE["window_speed"],
    "live_visits": crowd.ORACLE["lost_timeout_sessions"],
    "live_tick_density": crowd.ORACLE["tick_density"],
    "live_exit_counts": lifecycle.ORACLE["reloaded_exit_counts"],
    "newest_frames": f"""WITH {TRACKS_SQL}, sp AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events),
pt AS (SELECT t.*, least(2, (epoch_us(e.ts) - a) * 3 // (b - a)) AS batch FROM tracks t JOIN events e USING (event_id), sp)
SELECT CAST(batch AS INTEGER) AS batch, cam_id, arg_max(event_id, {{'t': ts_us, 'e': event_id}}) AS event_id, arg_max(gid, {{'t': ts_us, 'e': event_id}}) AS gid, count(*) - 1 AS dropped FROM pt GROUP BY batch, cam_id""",
    "drill_starts": f"""WITH {lifecycle._COMMANDS},
rq AS (SELECT event_id AS n, ts_us AS at_us, CASE WHEN event_id % 3 = 0 THEN ts_us + 1000 ELSE ts_us END AS alarm_us FROM tracks WHERE event_id % 20 = 5),
go AS (SELECT floor_id, at_us, n FROM main WHERE accepted AND command = 'start'), halt AS (SELECT floor_id, at_us, n FROM main WHERE accepted AND command = 'stop'),
sp AS (SELECT go.floor_id, go.at_us AS a, min(halt.at_us) AS b FROM go LEFT JOIN halt ON halt.floor_id = go.floor_id AND (halt.at_us > go.at_us OR (halt.at_us = go.at_us AND halt.n > go.n)) GROUP BY go.floor_id, go.at_us, go.n),
bz AS (SELECT rq.n, string_agg(DISTINCT floor_id, ',' ORDER BY floor_id) AS held FROM rq JOIN sp ON rq.at_us >= a AND (b IS NULL OR rq.at_us < b) GROUP BY rq.n)
SELECT n, n % 100 NOT IN (5, 25) AND held IS NULL AS accepted, CASE WHEN n % 100 IN (5, 25) THEN 'no_origin' WHEN held IS NOT NULL THEN 'busy' END AS reason,
  CASE WHEN n % 100 = 5 THEN 'f0' WHEN n % 100 = 25 THEN 'f0,f1' ELSE coalesce(held, '') END AS floors, CASE WHEN n % 100 NOT IN (5, 25) AND held IS NULL THEN alarm_us END AS alarm_us
FROM rq LEFT JOIN bz USING (n)""",
}
