"""Track observations: schemas, readers, and the adapter from ``events``.

One second of the site's clock is one day of ``events``, so a user's events,
hours apart, become a walk of observations seconds apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKS = (
    "session_id string, floor_id string, call_seq bigint, ts_us bigint, cam_id string, local_id bigint, "
    "u double, v double, conf double"
)
MOT = "frame int, id int, x double, y double, w double, h double, conf double, a double, b double, c double"

#: The same adapter for a SQL engine over the ``events`` table.
TRACKS_SQL = """tracks AS (
  SELECT event_id, epoch_us(ts) // 86400 AS ts_us, 's' || CAST(epoch_us(ts) // 864000000000 AS VARCHAR) AS session_id, 'cam' || CAST(user_id % 4 AS VARCHAR) AS cam_id,
         'f' || CAST(user_id % 2 AS VARCHAR) AS floor_id,
         'cam' || CAST(user_id % 4 AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) AS gid,
         CAST((event_id * 7919) % 1000 AS DOUBLE) AS u, CAST((event_id * 104729) % 1000 AS DOUBLE) AS v,
         value / (value + 25e0) AS conf
  FROM events)"""


def from_events(events: DataFrame) -> DataFrame:
    """event_id, ts_us, session_id (ten days of events, ten seconds of tracks),
    cam_id, floor_id, gid, u, v and conf."""
    user = F.col("user_id").cast("bigint")
    cam = F.concat(F.lit("cam"), (user % 4).cast("string"))
    since = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    return events.select(
        "event_id",
        F.expr(f"{since} div 86400").alias("ts_us"),
        F.expr(f"concat('s', {since} div 864000000000)").alias("session_id"),
        cam.alias("cam_id"),
        F.concat(F.lit("f"), (user % 2).cast("string")).alias("floor_id"),
        F.concat_ws(":", cam, user.cast("string")).alias("gid"),
        ((F.col("event_id") * 7919) % 1000).cast("double").alias("u"),
        ((F.col("event_id") * 104729) % 1000).cast("double").alias("v"),
        (F.col("value") / (F.col("value") + F.lit(25.0))).alias("conf"),
    )


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A recorded session, in parquet partitioned by session and floor."""
    return spark.read.schema(TRACKS).parquet(path)


def read_messages(lines: DataFrame) -> DataFrame:
    """Track messages, a JSON object a row in ``value``: {cam_id, ts, tracks:
    [{id, u, v, conf}]}.  Rows that are no such object are dropped."""
    kind = "cam_id string, ts double, tracks array<struct<id:bigint,u:double,v:double,conf:double>>"
    return (
        lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("m"))
        .where("m.cam_id is not null and m.ts is not null")
        .select("m.cam_id", F.round(F.col("m.ts") * 1e6).cast("bigint").alias("ts_us"), F.explode("m.tracks").alias("t"))
        .select("cam_id", "ts_us", F.col("t.id").alias("local_id"), "t.u", "t.v", "t.conf")
    )


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """MOT text files; the sequence is the file's name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    return spark.read.schema(MOT).csv(path).withColumn("seq", name).drop("a", "b", "c")


def camera_urls(cameras: DataFrame) -> DataFrame:
    """rtsp of each row of a camera list: as given, or assembled from host,
    port, user, password and channel, with escaped credentials."""
    quoted = lambda c: F.regexp_replace(F.url_encode(F.coalesce(F.col(c), F.lit(""))), r"\+", "%20")
    built = F.concat(
        F.lit("rtsp://"), quoted("user"), F.lit(":"), quoted("password"), F.lit("@"), F.col("host"), F.lit(":"),
        F.coalesce(F.col("port").cast("string"), F.lit("554")), F.lit("/ch"), F.lpad(F.col("channel").cast("string"), 2, "0"),
    )
    given = F.when(F.length(F.trim("rtsp")) > 0, F.trim("rtsp"))
    return cameras.withColumn("url", F.coalesce(given, built))


def mask_credentials(url: str):
    """rtsp://user:secret@host with both parts starred."""
    return F.regexp_replace(url, r"(?<=://)[^/@]+@", "***:***@")
