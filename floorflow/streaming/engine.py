"""The live engine: one stateful operator over a stream of observations.

State is kept by session and floor: the clock, the last place of each object on
the floor, each object's last second of positions, and the next sample.  What
it gives equals the batch functions of ``operators`` on the rows read so far,
however the rows are divided into micro-batches, if those come in the order of
time; the clock never goes back for a late row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from ..operators import observations as obs
from ..operators.observations import KEY
from ..operators.session import TICK
from ..plans.site import Site
from .live import drain, fresh_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = (
    "session_id string, floor_id string, kind string, gid string, event_id bigint, ts_us bigint, seg bigint, x double, y double, "
    "speed double, hx double, hy double, first_us bigint, n bigint, k bigint, version bigint"
)
FIELDS = [f.split()[0] for f in OUT.split(", ")]


class FloorEngine(StatefulProcessor):
    """Motion, visits and samples of one session and floor.

    * ``motion``: speed and heading of each observation on its floor;
    * ``visit``: an object's stay so far, once more whenever it changed;
    * ``tick``: the objects at sample k (and a row without an object); samples
      that a later call may still change come again with a higher version;
    * ``closed``: no row came for the idle time, and the state is gone.
    """

    def __init__(self, site: Site, idle_us: int):
        self.window, self.lost, self.idle = site.window_us, site.lost_us, idle_us
        self.scale, self.least = site.m_per_px, site.min_move_m

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "t0 bigint, t1 bigint, call bigint, k bigint, version bigint")
        #: every object of the session: how often it was dropped, and its last row
        self.objects = handle.getMapState("objects", "gid string", "seg bigint, inside boolean, last bigint, first bigint, n bigint")
        #: the objects that are on the floor
        self.present = handle.getMapState("present", "gid string", "ts bigint, x double, y double")
        #: their positions of the last window
        self.past = handle.getMapState("past", "gid string", "ts array<bigint>, x array<double>, y array<double>")

    def _motion(self, hist: tuple) -> tuple:
        ts, xs, ys = hist
        dx, dy, dt = xs[-1] - xs[0], ys[-1] - ys[0], (ts[-1] - ts[0]) / 1e6
        size = (dx * dx + dy * dy) ** 0.5
        speed = None if self.scale is None else 0.0 if dt <= 0 or size * self.scale < self.least else size * self.scale / dt
        return (speed, dx / size, dy / size) if size > 1e-9 else (speed, 0.0, 0.0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["ts_us", "event_id"], kind="stable")
        t0, t1, call, k, version = self.clock.get() if self.clock.exists() else (None, None, None, 1, 0)
        present = {g[0]: tuple(v) for g, v in self.present.iterator()}
        there, objects, past, out = set(present), {}, {}, []

        def give(kind, **values):
            out.append({"session_id": key[0], "floor_id": key[1], "kind": kind, "version": version, **values})

        def sample(number):
            give("tick", k=number)
            for gid, (ts, x, y) in present.items():
                if call - ts <= self.lost:
                    give("tick", k=number, gid=gid, ts_us=ts, x=x, y=y)

        for ts, event, gid, x, y, inside, mapped, sure in rows[["ts_us", "event_id", "gid", "x", "y", "in_roi", "is_mapped", "is_sure"]].itertuples(index=False):
            t0, t1 = (ts, ts) if t0 is None else (min(t0, ts), max(t1, ts))
            if not mapped:
                continue
            if sure:
                if gid not in objects:
                    known = self.objects.getValue((gid,))
                    objects[gid] = known and tuple(known)
                    hist = self.past.getValue((gid,))
                    past[gid] = tuple(list(c) for c in hist) if hist else ([], [], [])
                seg, was_in, last, first, n = objects[gid] or (0, None, None, None, 0)
                fresh = inside and was_in is not None and (not was_in or (call is not None and call - last > self.lost))
                if fresh:
                    seg, first, n, past[gid] = seg + 1, None, 0, ([], [], [])
                if inside:
                    first, n = ts if first is None else first, n + 1
                    hist = past[gid]
                    for held, value in zip(hist, (ts, x, y)):
                        held.append(value)
                    while ts - hist[0][0] > self.window:
                        for held in hist:
                            held.pop(0)
                    present[gid] = (ts, x, y)
                    speed, hx, hy = self._motion(hist)
                    give("motion", gid=gid, event_id=event, ts_us=ts, seg=seg, x=x, y=y, speed=speed, hx=hx, hy=hy)
                else:
                    present.pop(gid, None)
                objects[gid] = (seg, bool(inside), ts, first, n)
                if inside:
                    give("visit", gid=gid, seg=seg, first_us=first, ts_us=ts, n=n)
            call = ts if call is None else max(call, ts)
            while t0 + k * TICK <= call:
                sample(k)
                k += 1
        if call is not None:
            # what the next call may settle otherwise: samples due by unmapped rows, and the begun one
            for number in range(k, (t1 - t0) // TICK + (2 if (t1 - t0) % TICK else 1)):
                sample(number)
        for gid, (ts, _, _) in list(present.items()):
            if call - ts > self.lost:
                del present[gid]
                past[gid] = ([], [], [])
        for gid in there - present.keys():
            self.present.removeKey((gid,))
            self.past.removeKey((gid,))
        for gid, value in present.items():
            self.present.updateValue((gid,), value)
        for gid, value in objects.items():
            self.objects.updateValue((gid,), value)
            if past[gid][0] and gid in present:
                self.past.updateValue((gid,), past[gid])
        self.clock.update((t0, t1, call, k, version + 1))
        self.handle.registerTimer((t1 + self.idle) // 1000 + 1)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.clock.exists():
            _, t1, _, _, version = self.clock.get()
            if (t1 + self.idle) // 1000 < expiredTimerInfo.getExpiryTimeInMs():  # no row came since
                for state in (self.clock, self.objects, self.present, self.past):
                    state.clear()
                yield _frame([{"session_id": key[0], "floor_id": key[1], "kind": "closed", "ts_us": t1, "version": version}])

    def close(self) -> None:
        pass


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=FIELDS)
    whole = ("event_id", "ts_us", "seg", "first_us", "n", "k", "version")
    return frame.astype({c: "Int64" if c in whole else "float64" if c in ("x", "y", "speed", "hx", "hy") else "object" for c in FIELDS})


def engine(tracks: DataFrame, site: Site, idle_us: int = 60_000_000, late: str = "10 seconds") -> DataFrame:
    """The engine's rows over a stream of observations (session_id, gid,
    event_id, ts_us, cam_id, u, v, conf).  A session and floor without rows for
    ``idle_us`` of the stream's time is closed and its state freed; rows later
    than ``late`` are dropped.  Rows without a session, id or time are no
    observations."""
    known = tracks.where("session_id IS NOT NULL AND gid IS NOT NULL AND ts_us IS NOT NULL AND event_id IS NOT NULL")
    rows = obs.placed(obs.routed(known, site), site).select(
        *KEY, "gid", "event_id", "ts_us", "x", "y", F.coalesce("in_roi", F.lit(False)).alias("in_roi"),
        F.col("cam_id").isin([c.name for c in site.cameras]).alias("is_mapped"),
        F.coalesce(F.expr(obs.is_confident(site)), F.lit(False)).alias("is_sure"), F.timestamp_micros("ts_us").alias("at"),
    )
    return rows.withWatermark("at", late).groupBy(*KEY).transformWithStateInPandas(FloorEngine(site, idle_us), OUT, "Update", "EventTime")


def run(stream: DataFrame) -> DataFrame:
    """Everything that an engine gives for all that is there now."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        return drain(stream, "update")
    finally:
        spark.conf.set(name, before)


def motion(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'motion'").select(*KEY, "gid", "event_id", "ts_us", "seg", "x", "y", "speed", "hx", "hy")


def visits(rows: DataFrame) -> DataFrame:
    """KEY, gid, seg, first_us, last_us, n of each visit as it was last told."""
    told = rows.where("kind = 'visit'").groupBy(*KEY, "gid", "seg").agg(F.max(F.struct("n", "first_us", "ts_us")).alias("v"))
    return told.select(*KEY, "gid", "seg", "v.first_us", F.col("v.ts_us").alias("last_us"), "v.n")


def samples(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The samples (KEY, k) and the objects at them (KEY, k, gid, x, y), each
    as it was last told."""
    told = rows.where("kind = 'tick'")
    newest = told.withColumn("last", F.max("version").over(Window.partitionBy(*KEY, "k"))).where("version = last")
    return newest.where("gid IS NULL").select(*KEY, "k"), newest.where("gid IS NOT NULL").select(*KEY, "k", "gid", "x", "y")


def replayed(spark: SparkSession, rows: DataFrame, at: str, parts: int) -> DataFrame:
    """``rows`` as a stream of ``parts`` micro-batches, divided by the time
    column ``at`` into equal spans and written in that order."""
    path = fresh_folder(spark)
    span = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    for part in range(parts):
        inside = F.lit(True)
        if span.a is not None:
            low, high = (span.a + (span.b - span.a) * p / parts for p in (part, part + 1))
            inside = (F.col(at) >= F.lit(low)) & ((F.col(at) < F.lit(high)) if part + 1 < parts else F.lit(True))
        rows.where(inside).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
