"""The live engine and the counter with changing lines against their batch forms."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from floorflow.operators import lifecycle as life
from floorflow.operators import observations as obs
from floorflow.operators import session
from floorflow.operators.observations import KEY
from floorflow.plans.site import SITE
from floorflow.streaming import engine, live, reload

TRACKS = "event_id bigint, session_id string, ts_us bigint, cam_id string, gid string, u double, v double, conf double"

#: A stream's watermark begins at 0, which is too late for rows of that time.
BEGIN = 1_000_000_000_000


@pytest.fixture(scope="module")
def tracks(spark):
    """Two sessions of walks with gaps, doubtful rows, rows outside the ROI,
    of cameras without a mapping, and several rows of one moment."""
    rng = random.Random(6)
    rows, event = [], 0
    for name, start in (("a", BEGIN), ("b", BEGIN + 20_000_000)):
        for person in range(14):
            cam = rng.choice(["cam0", "cam1", "cam2", "cam3"])
            t, u, v = start + rng.randrange(3) * 500_000, rng.uniform(0, 1000), rng.uniform(0, 1000)
            while t < start + 14_000_000:
                rows.append((event, name, t, cam, f"{cam}:{person}", u, v, rng.choice([0.9, 0.9, 0.9, 0.1, 0.5])))
                event += 1
                t += rng.choice([0, 250_000, 250_000, 500_000, 900_000, 3_000_000, 4_500_000])
                u, v = u + rng.uniform(-60, 60), v + rng.uniform(-60, 60)
    rows.append((event, "a", BEGIN + 15_300_000, "cam3", "cam3:99", 1.0, 1.0, 0.9))  # the last row is of a camera without a mapping
    rows += [(event + 1, None, 1, "cam0", "x", 1.0, 1.0, 0.9), (event + 2, "b", BEGIN + 20_000_001, None, "y", 1.0, 1.0, 0.9), (event + 3, "b", BEGIN + 20_000_002, "cam0", "z", 1.0, 1.0, None)]
    return spark.createDataFrame(rows, TRACKS)


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(("parts", "site"), [(1, SITE), (4, SITE), (3, replace(SITE, m_per_px=None))])
def test_engine_equals_batch(spark, tracks, parts, site):
    told = engine.run(engine.engine(engine.replayed(spark, tracks, "ts_us", parts), site))
    known = tracks.where("session_id IS NOT NULL")
    seen = obs.observed(known, site)
    fields = (*KEY, "event_id", "gid", "seg", F.round("speed", 9), F.round("hx", 9), F.round("hy", 9))
    assert _rows(engine.motion(told), *fields) == _rows(obs.kinematics(seen, site), *fields)
    stays = seen.groupBy(*KEY, "gid", "seg").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"))
    fields = (*KEY, "gid", "seg", "first_us", "last_us", "n")
    assert _rows(engine.visits(told), *fields) == _rows(stays, *fields)
    grid, states = engine.samples(told)
    ticks = session.ticks(known, site)
    assert _rows(grid, *KEY, "k") == _rows(ticks, *KEY, "k")
    fields = (*KEY, "k", "gid", F.round("x", 6), F.round("y", 6))
    want = session.tick_states(seen.select(*KEY, "gid", "ts_us", "event_id", "until", "x", "y"), ticks, site)
    assert _rows(states, *fields) == _rows(want, *fields)


def test_idle_floors_are_closed(spark, tracks):
    # session b begins 4.7 seconds after the last row of a; its first row of the last micro-batch closes a
    told = engine.run(engine.engine(engine.replayed(spark, tracks, "ts_us", 6), SITE, idle_us=2_000_000, late="1 second"))
    closed = _rows(told.where("kind = 'closed'"), *KEY, "ts_us")
    assert {r[0] for r in closed} == {"a"}
    last = {(r.floor_id): r.t for r in obs.sessions(tracks.where("session_id = 'a'"), SITE).selectExpr("floor_id", "t1 AS t").collect()}
    assert all(last[floor] == ts for _, floor, ts in closed)


def test_counts_outlive_new_versions_between_runs(spark):
    versions = "floor_id string, exit_id string, from_us bigint, ax double, ay double, bx double, by double, ix double, iy double"
    line = lambda t, x, e="e": ("f", e, t, x, 0.0, x, 100.0, 1000.0, 50.0)
    early = [line(0, 50.0), line(0, 500.0, "other")]
    late = [line(10_000, 50.0), line(20_000, 70.0), ("f", "other", 10_000, *[None] * 6)]
    seen = "floor_id string, gid string, seg int, ts_us bigint, n bigint, x double, y double"
    rng = random.Random(2)
    rows = [("f", f"g{rng.randrange(9)}", 0, 97 * k, k, rng.choice([20.0, 48.0, 60.0, 90.0, 490.0, 520.0]), 50.0) for k in range(300)]
    path = live.fresh_folder(spark)
    spark.createDataFrame(early, versions).write.parquet(f"{path}/versions")
    for part in range(3):
        now = [r for r in rows if 10_000 * part <= r[3] < 10_000 * (part + 1)]
        spark.createDataFrame(now, seen).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if part == 1:  # the lines change while the stream is down, and it goes on from its checkpoint
            spark.createDataFrame(late, versions).write.mode("append").parquet(f"{path}/versions")
        stream = spark.readStream.schema(seen).parquet(f"{path}/in")
        reload.follow(stream, lambda s: s.read.parquet(f"{path}/versions"), path, 5.0).awaitTermination()
    want = life.reloaded_counts(spark.createDataFrame(rows, seen), spark.createDataFrame(early + late, versions), 5.0)
    fields = ("floor_id", "exit_id", "era", "in_count", "out_count")
    assert _rows(reload.counted(spark, path), *fields) == _rows(want, *fields) and want.count() == 2
    # sides of the first geometry are gone, those of the present one are kept
    assert {r.run for r in spark.read.parquet(f"{path}/sides/batch=2").select("run").distinct().collect()} == {2}


def test_drill_preconditions(spark):
    asked = [(1, 10, None, ["f0", "f1"]), (2, 20, 25, ["f1", "f0", "x"]), (3, 20, None, ["f1"]), (4, 20, None, None), (5, 99, None, ["f0", "f1"])]
    requests = spark.createDataFrame(asked, "n bigint, at_us bigint, alarm_us bigint, origins array<string>")
    spans = spark.createDataFrame([("f1", 5, 15), ("f0", 90, None), ("f9", 0, None)], "floor_id string, start_us bigint, stop_us bigint")
    got = {r.n: tuple(r)[1:] for r in life.drill_starts(requests, ["f0", "f1"], spans).collect()}
    assert got == {
        1: (False, "busy", "f1", None), 2: (True, None, "", 25), 3: (False, "no_origin", "f0", None), 4: (False, "no_origin", "f0,f1", None),
        5: (False, "busy", "f0", None),
    }
    assert {r.reason for r in life.drill_starts(requests, [], spans).collect()} == {"no_floors"}
