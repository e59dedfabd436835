"""Tables that are written once and read often, and sides of measured size."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.live import fresh_folder

#: Bytes of a side up to which it is sent to the other.
SENT_BYTES = 32 << 20


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that the cluster shares: what it was
    drawn from is not drawn again, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_together(**tables: DataFrame) -> dict[str, DataFrame]:
    """Tables that do not need one another, written at the same time: the jobs
    of small ones share the cluster instead of waiting in turn."""
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(len(tables)) as pool:
        jobs = {name: pool.submit(inheritable_thread_target(spark)(written), df) for name, df in tables.items()}
        return {name: job.result() for name, job in jobs.items()}


def sent(df: DataFrame, width: Column, most: int = SENT_BYTES) -> DataFrame:
    """A table marked for broadcast if its measured bytes (``width`` of each
    row) allow it; the join is left to Spark otherwise."""
    held = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if held <= most else df
