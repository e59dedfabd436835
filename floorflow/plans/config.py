"""Registered queries on site and camera configuration, and the same in SQL.

Cameras are ``customer`` rows, floors ``nation`` rows, drawings and routes come
from ``supplier`` and ``part``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config, summary
from ..sources import tracks as src
from ..sources.tracks import TRACKS_SQL, from_events


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cameras(spark, d):
    return _read(spark, d, "customer").selectExpr(
        "concat('cam', lpad(c_custkey, greatest(2, length(c_custkey)), '0')) AS cam_id", "concat('f', c_nationkey % 7) AS floor_id",
        "CAST(1 + c_custkey % 25 AS DOUBLE) AS fps", "c_acctbal > 0 AS enabled", "c_custkey % 3 <> 0 AS mapped", "c_custkey AS n",
    )


def _changes(spark, d, unknown: int):
    rows = _cameras(spark, d).where("n % 5 = 0").selectExpr(
        "cam_id", "CASE WHEN n % 2 = 0 THEN 'f9' END AS floor_id", "CASE WHEN n % 3 = 0 THEN fps + 1 END AS fps", "'x' AS extra"
    )
    more = spark.range(unknown).selectExpr("concat('new', id) AS cam_id", "'f1' AS floor_id", "1D AS fps", "'x' AS extra")
    return rows.unionByName(more)


def camera_patch(spark, d):
    return config.patch(_cameras(spark, d), _changes(spark, d, 0), "cam_id")


def camera_patch_rejected(spark, d):
    return config.patch(_cameras(spark, d), _changes(spark, d, 1), "cam_id")


def _last_seen(spark, d):
    t = from_events(_read(spark, d, "events")).withColumn("cam_id", F.expr("concat('cam', lpad(event_id % 97, 2, '0'))"))
    now = t.agg(F.max("ts_us").alias("now")).first().now or 0
    return summary.windowed_rates(t, "cam_id", now)


def camera_states(spark, d):
    seen = _last_seen(spark, d)
    top = seen.agg(F.max("last_us").alias("now_us"))
    cams = _cameras(spark, d).select("cam_id", "enabled", "n").join(F.broadcast(top))
    return config.with_state(cams, seen, F.col("now_us"), 300_000).drop("now_us", "n")


def floor_camera_counts(spark, d):
    floors = _read(spark, d, "nation").selectExpr("concat('f', n_nationkey) AS floor_id")
    return config.floor_cameras(floors, _cameras(spark, d))


def next_camera_ids(spark, d):
    return config.next_ids(_cameras(spark, d).where("n < 95 OR n > 1000000"), 8)


def _routes(spark, d):
    return _read(spark, d, "supplier").selectExpr(
        "concat(CASE WHEN s_suppkey % 3 = 0 THEN 'auto-evac-' ELSE 'r' END, s_suppkey) AS route_id", "concat('f', s_nationkey % 3) AS floor_id", "s_acctbal AS length"
    )


def route_merge(spark, d):
    new = _read(spark, d, "nation").selectExpr("concat('auto-evac-', n_nationkey) AS route_id", "'f1' AS floor_id", "CAST(n_regionkey AS DOUBLE) AS length")
    return config.merge_routes(_routes(spark, d), new).withColumn("mode", F.lit("auto")).unionByName(
        config.merge_routes(_routes(spark, d), new, True).withColumn("mode", F.lit("all"))
    )


def _versions(spark, d):
    return _read(spark, d, "orders").selectExpr("concat('site', o_custkey % 50) AS site_id", "o_orderkey AS version", "o_totalprice AS body")


def site_versions(spark, d):
    """Every site's newest version after half of them are saved once more."""
    v = _versions(spark, d)
    changed = v.select("site_id").distinct().where("CAST(substring(site_id, 5) AS INT) % 2 = 0").withColumn("body", F.lit(-1.0))
    return config.latest(v.unionByName(config.saved(v, changed, "site_id")), "site_id", "version")


def floor_results(spark, d):
    floors = _read(spark, d, "nation").selectExpr("concat('f', n_nationkey) AS floor_id")
    live = _read(spark, d, "region").selectExpr("concat('f', r_regionkey) AS floor_id", "concat('live', r_regionkey) AS result")
    stored = _read(spark, d, "supplier").where("s_nationkey < 20").selectExpr(
        "concat('f', s_nationkey) AS floor_id", "concat('old', s_suppkey) AS result", "s_suppkey AS saved_us"
    )
    return config.live_or_stored(floors, live, stored)


def timeline_cap(spark, d):
    t = from_events(_read(spark, d, "events")).select("cam_id", "event_id")
    return config.capped(t, ["cam_id"], "event_id", 100)


def unit_codes(spark, d):
    p = _read(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 9 < 8 THEN CAST(p_size % 9 AS INT) END AS code", "p_retailprice AS w", "p_retailprice * 2 AS h")
    mm = p.withColumns({"mm": config.unit_mm("code"), "guessed": config.unit_mm("code", 1.0)})
    size = lambda c: F.col(c) * F.col("mm")
    return mm.select("p_partkey", "mm", "guessed", config.plausible(size("w"), size("h")).cast("int").alias("plausible"))


def drawing_bounds(spark, d):
    s = _read(spark, d, "lineitem").selectExpr(
        "l_orderkey % 100 AS drawing", "l_quantity AS x1", "l_extendedprice AS y1", "l_quantity + l_tax AS x2", "l_extendedprice - l_discount AS y2"
    )
    h = _read(spark, d, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS drawing", "0D AS minx", "0D AS miny", "CAST(n_regionkey AS DOUBLE) AS maxx", "CAST(n_nationkey AS DOUBLE) AS maxy"
    )
    return config.bounds(s, h, "drawing")


def map_scales(spark, d):
    c = _read(spark, d, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 1e4D END AS m_per_px", "CAST(c_custkey % 7 AS DOUBLE) AS x1", "0D AS y1",
        "CAST(c_custkey % 5 AS DOUBLE) AS x2", "CAST(c_custkey % 2 AS DOUBLE) AS y2", "CASE WHEN c_custkey % 11 > 0 THEN 12D END AS meters",
    )
    return config.map_scale(c).select("c_custkey", F.round("scale", 9).alias("scale"))


def worker_log_stats(spark, d):
    lines = _read(spark, d, "customer").selectExpr(
        "CASE WHEN c_custkey % 4 = 0 THEN 'started' ELSE concat('12:00 STATS cam=cam', c_custkey, ' fps=', c_custkey % 30, '.5 drop=', c_nationkey) END AS value"
    )
    return config.worker_stats(lines)


def camera_balance(spark, d):
    cams = _cameras(spark, d).where("enabled").select(F.col("floor_id").alias("site_id"), "cam_id", "fps")
    return config.balanced(cams, 4)


def _frames(spark, d):
    return from_events(_read(spark, d, "events")).select("cam_id", "ts_us", "event_id")


def frame_gate(spark, d):
    return config.rate_gate(_frames(spark, d), "cam_id", 200_000)


def frame_sample(spark, d):
    return config.sampled(_frames(spark, d), "cam_id", 500_000)


def deleted_entities(spark, d):
    """Entities of a drawing without those whose handles were deleted."""
    gone = _read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("handle"))
    entities = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("handle"), F.col("l_linenumber").alias("part"))
    return entities.join(gone, "handle", "left_anti")


def camera_csv_urls(spark, d):
    rows = _read(spark, d, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN concat(' rtsp://u:p@h', c_custkey, '/1 ') ELSE '' END AS rtsp", "concat('10.0.0.', c_custkey % 250) AS host",
        "CASE WHEN c_custkey % 3 = 0 THEN 8554 END AS port", "lower(c_mktsegment) AS user", "concat('p/', c_nationkey, ' w') AS password", "c_custkey % 16 + 1 AS channel",
    )
    return src.camera_urls(rows).select("c_custkey", "url", src.mask_credentials("url").alias("shown"))


def event_properties(spark, d):
    e = _read(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("p.k").alias("n"))


def session_ids(spark, d):
    """Ids of sessions by their start, and clock times."""
    t = from_events(_read(spark, d, "events"))
    return t.select(
        "event_id", F.concat(F.lit("sess-"), F.bround(F.col("ts_us") / F.lit(1000.0)).cast("long").cast("string")).alias("session"),
        F.date_format(F.timestamp_seconds(F.expr("ts_us div 1000000")), "HH:mm:ss").alias("clock"),
    )


def dump_sequences(spark, d):
    """Frame dumps whose names hold a number, and the numbers missing between."""
    names = _read(spark, d, "orders").select(F.concat(F.lit("/dump/frame_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".npz")).alias("path"))
    seq = names.select(F.regexp_extract("path", r"_([0-9]+)\.npz$", 1).cast("long").alias("seq"))
    return seq.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), (F.max("seq") - F.min("seq") + 1 - F.count("*")).alias("missing"))


def track_messages(spark, d):
    """Messages as a bridge sends them, a line each, and what is read back."""
    t = from_events(_read(spark, d, "events")).where("event_id % 7 <> 0")
    one = F.struct(F.col("event_id").alias("id"), "u", "v", "conf")
    lines = t.groupBy("cam_id", F.expr("ts_us div 1000000").alias("s")).agg(F.collect_list(one).alias("tracks")).select(
        F.to_json(F.struct("cam_id", F.col("s").cast("double").alias("ts"), "tracks")).alias("value")
    )
    junk = spark.range(5).select(F.concat(F.lit("{broken "), "id").alias("value"))
    back = src.read_messages(lines.unionByName(junk))
    return back.groupBy("cam_id", "ts_us").agg(F.count("*").alias("n"), F.sum("local_id").alias("ids"), F.sum("u").alias("u"))


def recorded_calls(spark, d):
    """Recorded rows regrouped by call (a camera's second), in call order."""
    t = from_events(_read(spark, d, "events"))
    return t.groupBy("session_id", "cam_id", F.expr("ts_us div 1000000").alias("call_seq")).agg(
        F.max("ts_us").alias("ts_us"), F.count("*").alias("tracks"), F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda v: v.cast("string")), ",").alias("ids")
    )


_CAM = "cams AS (SELECT 'cam' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(2, len(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS cam_id, 'f' || CAST(c_nationkey % 7 AS VARCHAR) AS floor_id, CAST(1 + c_custkey % 25 AS DOUBLE) AS fps, c_acctbal > 0 AS enabled, c_custkey % 3 <> 0 AS mapped, c_custkey AS n FROM customer)"
_SEEN = f"{TRACKS_SQL}, ls AS (SELECT 'cam' || lpad(CAST(event_id % 97 AS VARCHAR), 2, '0') AS cam_id, max(ts_us) AS last_us, round(count(*) FILTER (WHERE ts_us >= (SELECT max(ts_us) FROM tracks) - 10000000) / 10, 6) AS fps FROM tracks GROUP BY 1)"
_RT = "rts AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'auto-evac-' ELSE 'r' END || CAST(s_suppkey AS VARCHAR) AS route_id, 'f' || CAST(s_nationkey % 3 AS VARCHAR) AS floor_id, s_acctbal AS length FROM supplier), nw AS (SELECT 'auto-evac-' || CAST(n_nationkey AS VARCHAR) AS route_id, 'f1' AS floor_id, CAST(n_regionkey AS DOUBLE) AS length FROM nation)"

ORACLE = {
    "camera_patch": f"WITH {_CAM} SELECT cam_id, CASE WHEN n % 5 = 0 AND n % 2 = 0 THEN 'f9' ELSE floor_id END AS floor_id, CASE WHEN n % 15 = 0 THEN fps + 1 ELSE fps END AS fps, enabled, mapped, n FROM cams",
    "camera_patch_rejected": f"WITH {_CAM} SELECT * FROM cams",
    "camera_states": f"WITH {_SEEN}, {_CAM}, cs AS (SELECT c.cam_id, c.enabled, CASE WHEN NOT c.enabled THEN 'disabled' WHEN last_us IS NULL THEN 'disconnected' WHEN (SELECT max(last_us) FROM ls) - last_us < 300000 THEN 'running' ELSE 'reconnecting' END AS status, ls.fps FROM cams c LEFT JOIN ls USING (cam_id)) SELECT cam_id, enabled, status, CASE WHEN status = 'running' THEN fps ELSE 0 END AS fps FROM cs",
    "floor_camera_counts": f"WITH {_CAM} SELECT 'f' || CAST(n_nationkey AS VARCHAR) AS floor_id, count(cam_id) AS cameras, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE mapped) AS mapped FROM nation LEFT JOIN cams ON floor_id = 'f' || CAST(n_nationkey AS VARCHAR) GROUP BY n_nationkey",
    "next_camera_ids": "SELECT CASE WHEN i < 100 THEN printf('cam%02d', i) ELSE 'cam' || CAST(i AS VARCHAR) END AS cam_id FROM (SELECT unnest(range(m + 1, m + 9)) AS i FROM (SELECT max(c_custkey) AS m FROM customer WHERE c_custkey < 95 OR c_custkey > 1000000))",
    "route_merge": f"WITH {_RT} SELECT *, 'auto' AS mode FROM rts WHERE NOT starts_with(route_id, 'auto-evac-') UNION ALL SELECT *, 'auto' FROM nw UNION ALL SELECT *, 'all' FROM nw",
    "site_versions": "WITH v AS (SELECT o_custkey % 50 AS s, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS body FROM orders GROUP BY 1) SELECT 'site' || CAST(s AS VARCHAR) AS site_id, CASE WHEN s % 2 = 0 THEN version + 1 ELSE version END AS version, CASE WHEN s % 2 = 0 THEN -1 ELSE body END AS body FROM v",
    "floor_results": "SELECT 'f' || CAST(n_nationkey AS VARCHAR) AS floor_id, CASE WHEN n_nationkey < 5 THEN 'live' || CAST(n_nationkey AS VARCHAR) WHEN n_nationkey < 20 THEN 'old' || CAST((SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS VARCHAR) END AS result, n_nationkey < 5 AS is_live FROM nation",
    "timeline_cap": f"WITH {TRACKS_SQL} SELECT cam_id, event_id FROM tracks QUALIFY row_number() OVER (PARTITION BY cam_id ORDER BY event_id DESC) <= 100",
    "unit_codes": "WITH p AS (SELECT p_partkey, p_retailprice AS w, CASE p_size % 9 WHEN 1 THEN 25.4::DOUBLE WHEN 2 THEN 304.8::DOUBLE WHEN 4 THEN 1 WHEN 5 THEN 10 WHEN 6 THEN 1000 END AS mm FROM part) SELECT p_partkey, mm, coalesce(mm, 1) AS guessed, CAST(w * 2 * mm BETWEEN 3000 AND 3000000 AS INTEGER) AS plausible FROM p",
    "drawing_bounds": "WITH b AS (SELECT l_orderkey % 100 AS drawing, min(least(l_quantity, l_quantity + l_tax)) AS minx, min(least(l_extendedprice, l_extendedprice - l_discount)) AS miny, max(greatest(l_quantity, l_quantity + l_tax)) AS maxx, max(greatest(l_extendedprice, l_extendedprice - l_discount)) AS maxy FROM lineitem GROUP BY 1) SELECT coalesce(drawing, n_nationkey) AS drawing, CASE WHEN g THEN 0 ELSE minx END AS minx, CASE WHEN g THEN 0 ELSE miny END AS miny, CASE WHEN g THEN n_regionkey ELSE maxx END AS maxx, CASE WHEN g THEN n_nationkey ELSE maxy END AS maxy FROM b FULL JOIN (SELECT *, n_regionkey > 1 AND n_nationkey > 1 AS g FROM nation) ON drawing = n_nationkey",
    "map_scales": "SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 1e4 WHEN c_custkey % 7 <> c_custkey % 5 OR c_custkey % 2 <> 0 THEN CASE WHEN c_custkey % 11 > 0 THEN 12 END / sqrt((c_custkey % 5 - c_custkey % 7) * (c_custkey % 5 - c_custkey % 7) + c_custkey % 2) END, 9) AS scale FROM customer",
    "worker_log_stats": "SELECT 'cam' || CAST(c_custkey AS VARCHAR) AS cam_id, c_custkey % 30 + 0.5::DOUBLE AS fps, CAST(c_nationkey AS BIGINT) AS drops FROM customer WHERE c_custkey % 4 <> 0",
    "deleted_entities": "SELECT l_orderkey AS handle, l_linenumber AS part FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "camera_csv_urls": "WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'rtsp://u:p@h' || CAST(c_custkey AS VARCHAR) || '/1' ELSE 'rtsp://' || lower(c_mktsegment) || ':p%2F' || CAST(c_nationkey AS VARCHAR) || '%20w@10.0.0.' || CAST(c_custkey % 250 AS VARCHAR) || ':' || CASE WHEN c_custkey % 3 = 0 THEN '8554' ELSE '554' END || '/ch' || printf('%02d', c_custkey % 16 + 1) END AS url FROM customer) SELECT c_custkey, url, 'rtsp://***:***@' || split_part(url, '@', 2) AS shown FROM u",
    "event_properties": "SELECT event_type, CAST(sum(CAST(props->>'k' AS INTEGER)) AS BIGINT) AS k, count(props->>'k') AS n FROM events GROUP BY 1",
    "session_ids": f"WITH {TRACKS_SQL} SELECT event_id, 'sess-' || CAST(CAST(round_even(ts_us / 1000, 0) AS BIGINT) AS VARCHAR) AS session, strftime(make_timestamp(ts_us // 1000000 * 1000000), '%H:%M:%S') AS clock FROM tracks",
    "dump_sequences": "SELECT min(o_orderkey) AS first, max(o_orderkey) AS last, max(o_orderkey) - min(o_orderkey) + 1 - count(*) AS missing FROM orders",
    "track_messages": f"WITH {TRACKS_SQL} SELECT cam_id, ts_us // 1000000 * 1000000 AS ts_us, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, sum(u) AS u FROM tracks WHERE event_id % 7 <> 0 GROUP BY ALL",
    "recorded_calls": f"WITH {TRACKS_SQL} SELECT session_id, cam_id, ts_us // 1000000 AS call_seq, max(ts_us) AS ts_us, count(*) AS tracks, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM tracks GROUP BY 1, 2, 3",
}

QUERIES = {
    f.__name__: f
    for f in (
        camera_patch, camera_patch_rejected, camera_states, floor_camera_counts, next_camera_ids, route_merge, site_versions, floor_results,
        timeline_cap, unit_codes, drawing_bounds, map_scales, worker_log_stats, camera_balance, frame_gate, frame_sample, deleted_entities,
        camera_csv_urls, event_properties, session_ids, dump_sequences, track_messages, recorded_calls,
    )
}
