"""Recording a live session beside its metrics: two sinks of one stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SEATS = ["session_id", "floor_id"]


def record(stream: DataFrame, path: str, observe: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Write each batch of raw observations, before any filter, to
    ``path``/raw and ``observe``'s rows of it to ``path``/seen.  ``path`` is a
    folder that driver and executors share.  A batch that runs again overwrites
    its own folders and Spark commits a folder as a whole, so readers see every
    observation once.  ``once``: stop when all that is there now is written."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.write.mode("overwrite").partitionBy(*SEATS).parquet(f"{path}/raw/batch={number}")
            observe(batch).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        finally:
            batch.unpersist()

    query = stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(write)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="1 second")).start()


def recorded(spark: SparkSession, path: str, schema) -> DataFrame:
    """The raw observations of a recording."""
    return spark.read.schema(schema).option("basePath", f"{path}/raw").parquet(f"{path}/raw/batch=*")


def closing_counts(raw: DataFrame) -> DataFrame:
    """What a recording's end states of each session and floor: calls (a
    camera's observations of one moment; empty calls leave no row) and rows."""
    calls = raw.groupBy(*SEATS, "cam_id", "ts_us").agg(F.count("*").alias("n"))
    return calls.groupBy(*SEATS).agg(F.count("*").alias("call_count"), F.sum("n").alias("track_row_count"))
