"""Exit counts of a running stream under configuration that changes.

The versions of the exit lines are a table that is read again at each
micro-batch.  What a batch leaves to the next is a table too: the side of the
line on which each object was last seen, kept while the line's geometry stays
and forgotten when it changes.  Counts go on over new versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import lifecycle as life

SIDE = ["floor_id", "exit_id", "era", "run", "gid", "seg", "ts_us", "n", "t", "side"]
PASSED = "floor_id string, exit_id string, era bigint, gid string, direction string"


def follow(seen: DataFrame, versions: Callable[[SparkSession], DataFrame], path: str, margin: float, once: bool = True) -> StreamingQuery:
    """Run the counter over a stream of positions (floor_id, gid, seg, ts_us,
    n, x, y), in the order of time, and write to ``path``, a folder that driver
    and executors share.  ``versions`` reads the lines (as
    ``lifecycle.line_versions`` takes them) as they are now.  A batch that runs
    again writes the same rows in the same place.  ``once``: stop when all that
    is there now is counted; the next call goes on from there."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        lines = life.line_versions(versions(spark)).persist()
        clear = life.clear_sides(batch, lines, margin).select(*SIDE)
        if number:
            clear = clear.unionByName(spark.read.schema(clear.schema).parquet(f"{path}/sides/batch={number - 1}"))
        clear = clear.persist()
        try:
            life.flips(clear).select(F.col("floor_id"), "exit_id", F.col("era").cast("bigint").alias("era"), "gid", "direction").distinct().write.mode(
                "overwrite"
            ).parquet(f"{path}/passed/batch={number}")
            _left(clear, lines, batch).write.mode("overwrite").parquet(f"{path}/sides/batch={number}")
        finally:
            clear.unpersist()
            lines.unpersist()

    query = seen.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(write)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="1 second")).start()


def _left(clear: DataFrame, lines: DataFrame, batch: DataFrame) -> DataFrame:
    """The last side of each object at each line: only of geometries that
    still hold at the floor's newest row, and of the object's newest stay."""
    newest = batch.groupBy("floor_id").agg(F.max("ts_us").alias("now"))
    runs = lines.groupBy("floor_id", "exit_id", "run").agg(F.max(F.coalesce("until_us", F.lit(2**62))).alias("ends"))
    last = clear.groupBy("floor_id", "exit_id", "run", "gid", "seg").agg(F.max(F.struct("ts_us", "n", "era", "t", "side")).alias("s"))
    stay = F.max("seg").over(Window.partitionBy("floor_id", "gid"))
    kept = last.withColumn("stay", stay).where("seg = stay").join(runs, ["floor_id", "exit_id", "run"]).join(newest, "floor_id", "left")
    return kept.where("now IS NULL OR ends > now").select("floor_id", "exit_id", "s.era", "run", "gid", "seg", "s.ts_us", "s.n", "s.t", "s.side")


def counted(spark: SparkSession, path: str) -> DataFrame:
    """floor_id, exit_id, era, in_count, out_count of what was counted so far,
    each object once a direction."""
    told = spark.read.schema(PASSED).parquet(f"{path}/passed/batch=*")
    once = told.select("floor_id", "exit_id", "era", "gid", "direction").distinct()
    n = lambda way: F.sum((F.col("direction") == way).cast("bigint")).alias(f"{way}_count")
    return once.groupBy("floor_id", "exit_id", "era").agg(n("in"), n("out"))
