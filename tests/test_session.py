"""Session indicators with closed-form expectations, and SQL agreement."""

from dataclasses import replace

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from floorflow.operators import digest, observations as obs, session
from floorflow.plans.site import Camera, Exit, Route, Site, Zone
from floorflow.sources import tracks

MAP = ((0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0))
SQUARE = ((100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0))
CAM = Camera("cam01", (1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0), MAP)
SITE = Site(
    zones=(Zone("z", SQUARE),), bottlenecks=(Zone("b", SQUARE, 1.0, 2.0),), cameras=(CAM,),
    routes=(Route("r", ((100.0, 500.0), (900.0, 500.0))),),
    exits=(Exit("e", (500.0, 400.0), (500.0, 600.0), (400.0, 500.0), 60),),
)


SCHEMA = "event_id long, session_id string, ts_us long, cam_id string, floor_id string, gid string, u double, v double, conf double"


def _tracks(spark, rows, cam="cam01"):
    """rows: object, seconds, x, y, confidence."""
    data = [(k, "s", int(t * 1e6), cam, "f", f"{cam}:{g}", float(x), float(y), float(c)) for k, (g, t, x, y, c) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def _seen(spark, rows, site=SITE):
    return obs.observed(_tracks(spark, rows), site)


def _congestion(spark, rows, site=SITE):
    tracks = _tracks(spark, rows)
    grid = session.ticks(tracks, site)
    states = session.tick_states(obs.observed(tracks, site), grid, site)
    return session.congestion(session.tick_counts(states, grid, site, site.bottlenecks), site).first()


def _onset(spark, rows, site=SITE):
    tracks = _tracks(spark, rows)
    states = session.tick_states(session.with_motion(obs.observed(tracks, site), site), session.ticks(tracks, site), site)
    return session.onset(session.zone_conditions(states, site), site)


def test_zone_density_and_its_null_without_a_scale(spark):
    tracks = _tracks(spark, [(1, 100, 150, 150, 0.9), (2, 100, 250, 250, 0.9), (3, 100, 800, 800, 0.9)])
    base = obs.sessions(tracks, SITE).select(*obs.KEY)
    n = obs.counted(obs.snapshot(tracks, SITE), base, SITE, SITE.zones, obs.KEY)
    assert [(r.zone, r.n, r.rho) for r in session.counted_density(n, SITE, SITE.zones).collect()] == [("z", 2, 0.5)]
    bare = replace(SITE, m_per_px=None)
    assert session.counted_density(n, bare, bare.zones).first().rho is None


def test_crossings_and_round_trip(spark):
    path = [(1, 100 + k, x, 500, 0.9) for k, x in enumerate((560, 440, 560, 440, 560))]
    seen = _seen(spark, path)
    assert [r.direction for r in obs.all_crossings(seen, SITE).orderBy("event_id").collect()] == ["in", "out", "in", "out"]
    base = obs.sessions(_tracks(spark, path), SITE)
    assert [(r.n_in, r.n_out) for r in session.exit_counts(seen, base, SITE).collect()] == [(1, 1)]


def test_leaving_the_roi_drops_the_object(spark):
    site = replace(SITE, cameras=(replace(CAM, roi=((0.0, 0.0), (600.0, 0.0), (600.0, 1000.0), (0.0, 1000.0))),))
    path = [(1, 100, 560, 500, 0.9), (1, 100.5, 700, 500, 0.9), (1, 101, 440, 500, 0.9), (1, 101.5, 430, 500, 0.9)]
    seen = _seen(spark, path, site)
    assert [(r.event_id, r.seg) for r in seen.orderBy("event_id").collect()] == [(0, 0), (2, 1), (3, 1)]
    assert obs.all_crossings(seen, site).count() == 0  # its side was forgotten
    assert obs.kinematics(seen, site).where("event_id = 2").first().speed == 0
    gone = _tracks(spark, path[:2])
    assert obs.snapshot(gone, site).count() == 0
    # fidelity goes on over the gap
    assert session.fidelity(session.deviations(seen, site), site).count() == 1


def test_an_object_is_lost_only_if_another_call_finds_it_so(spark):
    alone = _seen(spark, [(1, 100, 10, 10, 0.9), (1, 107, 10, 10, 0.9)])
    assert [r.seg for r in alone.orderBy("event_id").collect()] == [0, 0]
    watched = _seen(spark, [(1, 100, 10, 10, 0.9), (2, 104, 20, 20, 0.9), (1, 107, 10, 10, 0.9)])
    assert [r.seg for r in watched.where("gid like '%:1'").orderBy("event_id").collect()] == [0, 1]
    early = _seen(spark, [(1, 100, 10, 10, 0.9), (2, 102, 20, 20, 0.9), (1, 107, 10, 10, 0.9)])
    assert [r.seg for r in early.where("gid like '%:1'").orderBy("event_id").collect()] == [0, 0]


def test_floors_and_sessions_do_not_mix(spark):
    site = replace(SITE, floors=("f0", "f1"), cameras=(CAM, replace(CAM, name="cam02", floor="f1"), replace(CAM, name="cam03", floor="gone")))
    tracks = _tracks(spark, [(1, 100, 150, 150, 0.9)])
    for cam in ("cam02", "cam03"):
        tracks = tracks.unionByName(_tracks(spark, [(1, 100, 150, 150, 0.9)], cam))
    base = obs.sessions(tracks, site).select(*obs.KEY)
    assert {(r.floor_id, r.zone, r.n) for r in obs.counted(obs.snapshot(tracks, site), base, site, site.zones, obs.KEY).collect()} == {("f0", "z", 2)}
    assert site.taking_part() == ["f0", "f1"] and site.floor_view("f1").zones == ()
    assert replace(site, cameras=(replace(CAM, floor=None),)).floor_of("cam01") == "f0"


def test_speed_and_alignment(spark):
    seen = _seen(spark, [(1, 100.0, 500, 500, 0.9), (1, 100.2, 520, 500, 0.9)])
    last = session.with_motion(seen, SITE).orderBy("event_id").collect()[-1]
    assert last.speed == pytest.approx(1.0) and last.align == pytest.approx(1.0)
    back = session.with_motion(_seen(spark, [(1, 100.0, 520, 500, 0.9), (1, 100.2, 500, 500, 0.9)]), SITE)
    assert back.orderBy("event_id").collect()[-1].align == pytest.approx(-1.0)
    no_route = session.with_motion(seen, replace(SITE, routes=())).collect()
    assert all(r.align is None for r in no_route)


@pytest.mark.parametrize("y,want", [(500, 100.0), (600, 50.0)])
def test_fidelity(spark, y, want):
    seen = _seen(spark, [(1, 100 + k, 200 + 50 * k, y, 0.9) for k in range(5)])
    assert session.fidelity(session.deviations(seen, SITE), SITE).first().epfi == pytest.approx(want)


def test_fidelity_needs_two_seconds_and_a_route(spark):
    seen = _seen(spark, [(1, 100, 200, 500, 0.9), (1, 101, 250, 500, 0.9)])
    assert session.fidelity(session.deviations(seen, SITE), SITE).first().epfi is None
    bare = replace(SITE, routes=())
    seen = _seen(spark, [(1, 100 + k, 200, 500, 0.9) for k in range(5)], bare)
    assert session.fidelity(session.deviations(seen, bare), bare).first().epfi is None


def test_congestion(spark):
    got = _congestion(spark, [(g, 100 + t, 150 + g, 150, 0.9) for t in range(11) for g in range(8)])
    assert (got.cbs, got.over_sec, got.peak, got.risk) == (18.0, 9.0, 2.0, "high")
    under = _congestion(spark, [(g, 100 + t, 150 + g, 150, 0.9) for t in range(11) for g in range(3)])
    assert (under.cbs, under.peak, under.risk) == (0.0, 0.75, "low")


def test_congestion_counts_the_last_part_of_a_second(spark):
    got = _congestion(spark, [(g, 100 + t, 150 + g, 150, 0.9) for t in (0, 1, 2, 2.5) for g in range(8)])
    assert (got.cbs, got.over_sec) == (3.0, 1.5)  # density 2 against 1, weight 2, held from the first sample


def test_response_starts_with_the_run_that_holds(spark):
    site = replace(SITE, zones=(Zone("z", ((100.0, 100.0), (900.0, 100.0), (900.0, 900.0), (100.0, 900.0))),), origins=((100.0, 500.0),))
    still = [(1, 100 + t / 2, 200, 500, 0.9) for t in range(11)]
    walk = [(1, 105 + t / 2, 200 + 50 * t, 500, 0.9) for t in range(1, 11)]
    got = _onset(spark, still + walk, site).first()
    assert (got.start_us, got.delay_sec, got.participants) == (106_000_000, 6.0, 1.0)
    short = [(1, 100 + t / 2, 200 + 50 * t, 500, 0.9) for t in range(4)] + [(1, 102 + t / 2, 350, 500, 0.9) for t in range(10)]
    assert _onset(spark, short, site).count() == 0


@pytest.mark.parametrize("passed,want", [((6, 4), 100.0), ((10, 0), 60.0), ((0, 0), None)])
def test_exit_balance(spark, passed, want):
    site = replace(SITE, exits=tuple(Exit(n, SITE.exits[0].a, SITE.exits[0].b, SITE.exits[0].within, c) for n, c in (("e1", 60), ("e2", 40), ("e3", None))))
    rows = [("s", "f0", n, 0, k) for n, k in zip(("e1", "e2", "e3"), (*passed, 5))]
    counts = spark.createDataFrame(rows, "session_id string, floor_id string, exit_id string, n_in long, n_out long")
    assert session.exit_balance(session.exit_shares(counts, site)).first().sei == want


def test_dropped_share(spark):
    got = session.quality(_tracks(spark, [(1, 100, 10, 10, 0.9)]).unionByName(_tracks(spark, [(1, 100, 10, 10, 0.9)], "other")), SITE).first()
    assert (got.dropped_ratio, got.cameras, got.tracks, got.warnings) == (0.5, "cam01", 1, "")


def test_overrides_reach_only_what_exists(spark):
    rows = [("s", "f0", k, 100 + k, 100, 1.0, "b", 4) for k in range(1, 4)]
    counts = spark.createDataFrame(rows, "session_id string, floor_id string, k long, tick_us long, t0 long, dt double, zone string, n long")
    variants = {"base": {}, "low": {"rho_crit": 0.5}, "own": {"rho_crit": 0.5, "bottlenecks": {"b": {"rho_crit": 0.25, "weight": 1.0}, "x": {"weight": 7.0}}}}
    got = {r.variant: r.cbs for r in digest.congestion_variants(counts, SITE, variants).collect()}
    assert got == {"base": 0.0, "low": 2.0, "own": 1.5}


def test_min_conf_override(spark):
    rows = [(k, 100, 10, 10, c) for k, c in enumerate((0.3, 0.6, 0.7))]
    kept = lambda least: obs.confident(_tracks(spark, rows), replace(SITE, min_conf=0.5, cameras=(replace(CAM, min_conf=least),))).count()
    assert [kept(0.65), kept(None), kept(0.2)] == [1, 2, 3]


def test_camera_urls_and_mask(spark):
    rows = [("rtsp://u:p@h/1", None, None, None, None, 1), (None, "1.2.3.4", None, "a b", "p/w", 7)]
    frame = spark.createDataFrame(rows, "rtsp string, host string, port int, user string, password string, channel int")
    out = tracks.camera_urls(frame)
    assert [r.url for r in out.collect()] == ["rtsp://u:p@h/1", "rtsp://a%20b:p%2Fw@1.2.3.4:554/ch07"]
    assert out.select(tracks.mask_credentials("url").alias("m")).first().m == "rtsp://***:***@h/1"


def test_messages_skip_what_is_no_object(spark):
    lines = spark.createDataFrame([('{"cam_id":"c","ts":1.5,"tracks":[{"id":3,"u":1,"v":2,"conf":0.5}]}',), ("junk",)], "value string")
    assert [(r.cam_id, r.ts_us, r.local_id) for r in tracks.read_messages(lines).collect()] == [("c", 1_500_000, 3)]


NAMES = ("zone_occupancy", "window_speed", "exit_counts_debounced", "sei_score", "epfi_person", "cbs_bottleneck", "idr_zone",
         "digest_quartiles", "reid_map", "track_gap_interp", "drill_rollup", "id_jaccard")


@pytest.mark.parametrize("name", NAMES)
def test_queries_agree_with_sql(spark, name):
    where = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for table in ("events", "embeddings"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{where}/{table}.parquet'")
    want = base.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, where).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: "" if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else repr(float(v))
    rows = lambda f: sorted(tuple(map(plain, r)) for r in f[columns].itertuples(index=False))
    assert rows(got) == rows(want)
