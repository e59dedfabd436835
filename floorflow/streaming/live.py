"""Track streams: visits and rates as Structured Streaming aggregations.

Each takes a streaming or a batch DataFrame of observations and gives the same
rows for the same input.  Rows later than the watermark are dropped in append
mode, in which state is bounded by the objects of the last ``late``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..sources.tracks import from_events


def event_tracks(spark: SparkSession, path: str) -> DataFrame:
    """The observations of an ``events`` table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    return from_events(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"))


def _timed(tracks: DataFrame, late: str) -> DataFrame:
    return tracks.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)


def visits(tracks: DataFrame, lost_us: int, late: str = "1 hour") -> DataFrame:
    """Visits of each object, which end when it is unseen for longer than the
    lost timeout."""
    by = F.session_window("at", f"{lost_us + 1} microseconds")
    return (
        _timed(tracks, late).groupBy("gid", by)
        .agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")).drop("session_window")
    )


def rates(tracks: DataFrame, seconds: int = 5, late: str = "1 hour") -> DataFrame:
    """Observations of each camera in windows of ``seconds``."""
    by = F.window("at", f"{seconds} seconds")
    n = _timed(tracks, late).groupBy("cam_id", by).agg(F.count("*").alias("n"))
    return n.select("cam_id", (F.unix_seconds("window.start") / seconds).cast("bigint").alias("w"), "n")


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.  Where that is unset, a
    local session gets a temporary one, and a cluster an error."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def newest(batch: DataFrame, key: str) -> DataFrame:
    """The newest row of each key; a backlog's older rows are dropped.  Equal
    times go by event_id."""
    rest = [c for c in batch.columns if c not in (key, "ts_us", "event_id")]
    last = batch.groupBy(key).agg(F.max(F.struct("ts_us", "event_id", *rest)).alias("r"), F.count("*").alias("backlog"))
    return last.select(key, "r.*", (F.col("backlog") - 1).alias("dropped"))


def follow_newest(stream: DataFrame, key: str, once: bool = True) -> DataFrame:
    """What a reader that only looks at the newest frame sees: of each trigger
    the newest row of each key, with the number of older ones dropped; batch is
    the trigger's number."""
    spark, at = stream.sparkSession, fresh_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        newest(batch, key).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{at}/state").foreachBatch(write)
    (query.trigger(availableNow=True) if once else query.trigger(processingTime="1 second")).start().awaitTermination()
    return spark.read.schema(newest(stream, key).schema.add("batch", IntegerType())).parquet(f"{at}/rows")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now; its result, read back from a
    table in the folder that the cluster shares.  Complete mode holds every
    group until the stream ends; append mode emits a group when the watermark
    has passed it and frees its state."""
    spark = stream.sparkSession
    at = fresh_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own rows
        where = at + ("/rows" if mode == "complete" else f"/rows/batch={number}")
        batch.write.mode("overwrite").parquet(where)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(write)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
