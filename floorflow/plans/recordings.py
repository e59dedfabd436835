"""Registered queries on recordings and dumps and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import recordings as rec
from ..sources.tracks import TRACKS_SQL, from_events
from ..streaming import live
from .evaluation import _read


def session_files(spark, d):
    """Recorded rows of all sessions but one, by call, written and read back."""
    t = from_events(_read(spark, d, "events"))
    path = live.fresh_folder(spark)
    rec.write_sessions(t.select("session_id", F.expr("ts_us div 250000").alias("call_seq"), (F.col("ts_us") / F.lit(1e6)).alias("ts"), "cam_id", F.col("event_id").alias("local_id"), "u", "v", "conf"), path)
    back = rec.read_sessions(spark, path, rows=1000).where("session_id <> 's1973' AND session_id >= 's'")
    return back.groupBy("session_id", "cam_id", "call_seq").agg(F.count("*").alias("tracks"), F.sum("local_id").alias("ids"), F.round(F.max("ts"), 6).alias("ts"))


def frame_files(spark, d):
    """Vectors as frames of ten, written and read back from the twentieth on."""
    v = _read(spark, d, "embeddings").where("embedding IS NOT NULL")
    path = live.fresh_folder(spark)
    one = v.select(F.expr("vec_id div 10").alias("seq"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.array(F.lit(1), F.size("embedding")).alias("shape"), F.col("embedding").cast("array<double>").alias("data"))
    rec.write_frames(one, path)
    back = rec.read_frames(spark, path).where("seq >= 20 AND seq < 40")
    return back.groupBy("seq").agg(F.count("*").alias("arrays"), F.sum(F.element_at("shape", 2)).alias("numbers"), F.round(F.sum(F.aggregate("data", F.lit(0.0), lambda s, x: s + x)), 5).alias("total"))


QUERIES = {f.__name__: f for f in (session_files, frame_files)}
ORACLE = {
    "session_files": f"WITH {TRACKS_SQL} SELECT session_id, cam_id, ts_us // 250000 AS call_seq, count(*) AS tracks, CAST(sum(event_id) AS BIGINT) AS ids, round(max(ts_us / 1e6), 6) AS ts FROM tracks WHERE session_id <> 's1973' GROUP BY ALL",
    "frame_files": "SELECT vec_id // 10 AS seq, count(*) AS arrays, CAST(sum(len(embedding)) AS BIGINT) AS numbers, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 5) AS total FROM embeddings WHERE vec_id >= 200 AND vec_id < 400 GROUP BY 1",
}
