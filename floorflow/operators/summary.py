"""Summaries: roll-ups, quartiles, surges, thinning, exports, stream counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def index_quartiles(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Count, least, quartiles at positions n // 4 and 3n // 4 of the sorted
    values, interpolated median, largest and mean."""
    w = Window.partitionBy(*key)
    ranked = rows.where(F.col(value).isNotNull()).select(
        *key, F.col(value).alias("v"), F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy(value)) - 1).alias("i")
    )
    at = lambda e: F.max(F.expr(f"CASE WHEN i = {e} THEN v END"))
    return ranked.groupBy(*key).agg(
        F.max("n").alias("n"),
        F.round(F.min("v"), 2).alias("least"),
        F.round(at("n div 4"), 2).alias("p25"),
        F.round((at("(n - 1) div 2") + at("n div 2")) / 2, 2).alias("median"),
        F.round(at("(3 * n) div 4"), 2).alias("p75"),
        F.round(F.max("v"), 2).alias("largest"),
        F.round(F.avg("v"), 2).alias("mean"),
    )


def thin(rows: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """n rows of each key evenly spaced by position: those at int(i * count / n)."""
    w = Window.partitionBy(*key)
    placed = rows.withColumns({"p": F.row_number().over(w.orderBy(order)) - 1, "total": F.count("*").over(w)})
    wanted = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("total") / F.lit(n)) == F.col("p"))
    return placed.where((F.col("total") <= n) | wanted).drop("p", "total")


def histogram(rows: DataFrame, value: str, bins: int = 10, top: float = 100.0) -> DataFrame:
    """Counts of ``bins`` equal bins over 0..top, ends clamped, zeros kept."""
    each = rows.where(F.col(value).isNotNull()).groupBy(
        F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(value) / F.lit(top / bins)).cast("int"))).alias("bin")
    ).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(each, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n")
    )


def frame_rate(rows: DataFrame, key: str, frames: int = 25) -> DataFrame:
    """Rate over each row's last ``frames`` rows: (n - 1) over their span."""
    w = Window.partitionBy(key).orderBy("ts_us", "event_id").rowsBetween(-(frames - 1), 0)
    span = (F.col("ts_us") - F.min("ts_us").over(w)) / F.lit(1e6)
    n = F.count("*").over(w)
    return rows.withColumn("fps", F.round(F.when(span > 0, (n - 1) / span).otherwise(F.lit(0.0)), 6))


def latest_rates(rows: DataFrame, key: str, now_us: Column, frames: int = 25, stale_us: int = 10_000_000) -> DataFrame:
    """``frame_rate`` of each key's last row as it is told at ``now_us`` (a
    column of the rows): 0 if that row is older than ``stale_us``, is the only
    one, or no time lies between."""
    recent = rows.withColumn("now_us", now_us).where(F.col("ts_us") <= F.col("now_us"))
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts_us"), F.desc("event_id")))
    held = recent.withColumn("back", back).where(F.col("back") <= frames).groupBy(key).agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.max("now_us").alias("now_us")
    )
    span = (F.col("last") - F.col("first")) / F.lit(1e6)
    live = (F.col("now_us") - F.col("last") <= stale_us) & (span > 0)
    return held.select(key, F.round(F.when(live, (F.col("n") - 1) / span).otherwise(0.0), 6).alias("fps"))


def windowed_rates(rows: DataFrame, key: str, now_us: int, window_us: int = 10_000_000) -> DataFrame:
    """key, last_us and fps: rows of the last ten seconds before ``now_us``, a
    second; keys without any have a rate of 0."""
    recent = F.count(F.when((F.col("ts_us") <= now_us) & (F.lit(now_us) - F.col("ts_us") <= window_us), 1))
    return rows.groupBy(key).agg(F.max("ts_us").alias("last_us"), F.round(recent / F.lit(window_us / 1e6), 6).alias("fps"))


def dropped_oldest(rows: DataFrame, key: str, size: int, batch: Column) -> DataFrame:
    """What a bounded queue that drops its oldest rows keeps of each batch."""
    queued = rows.withColumn("batch", batch)
    w = Window.partitionBy(key, "batch").orderBy(F.desc("ts_us"), F.desc("event_id"))
    return (
        queued.withColumn("back", F.row_number().over(w))
        .groupBy(key, "batch")
        .agg(F.count("*").alias("n"), F.sum(F.when(F.col("back") > size, 1).otherwise(0)).alias("dropped"))
    )


#: Logarithm of a visitor sketch's registers.
REGISTERS = 12


def sketch_error(registers: int = REGISTERS) -> float:
    """One standard error of an estimate, as a share of it."""
    return 1.04 / 2 ** (registers / 2)


def visitor_sketches(rows: DataFrame, by: list[str], who: str, registers: int = REGISTERS) -> DataFrame:
    """``by`` (such as floor and window) and a sketch of those seen there: a few
    kilobytes, however many they are.  Null names are nobody."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(who, F.lit(registers)).alias("seen"))


def visitors(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and visitors: how many different ones the merged sketches have
    seen, each counted once over all windows and floors."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("seen")).alias("visitors"))
