"""The configuration store, floor resets, real speeds, map bounds and truth."""

import json

import pytest

from floorflow.operators import agreement as agr
from floorflow.operators import calibration as cal
from floorflow.operators import config
from floorflow.sources import store


def _rows(df):
    return sorted((r.site_id, r.kind, r.name, r.body) for r in df.collect())


def test_files_are_scanned_in_order(spark, tmp_path):
    for name, body in {
        "b/site.json": '{"site_id": "b"}', "a/site.json": '{"site_id": "a"}', "a/cameras/cam02.json": '{"n": 2}', "a/cameras/cam01.json": '{"n": 1}',
        "a/cameras/torn.json": '{"n": ', "a/floor.json": '{"f": 1}', "nosite/cameras/x.json": "{}", "a/sessions.txt": "no",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = [(r.site_id, r.kind, r.name) for r in store.scan(spark, str(tmp_path)).collect()]
    assert got == [("a", "camera", "cam01"), ("a", "camera", "cam02"), ("a", "other", "floor"), ("a", "site", "site"), ("b", "site", "site")]


def test_versions_are_whole_or_not_there(spark, tmp_path):
    root = str(tmp_path)
    table = lambda *rows: spark.createDataFrame(list(rows), store.BODY)
    assert store.load(spark, root).count() == 0 and store.bootstrap(spark, root, table()) == []
    seed = table(("s", "site", "site", '{"a":1}'), ("s", "camera", "c1", "{}"), ("t", "site", "site", "{}"), ("stray", "camera", "c9", "{}"))
    assert store.bootstrap(spark, root, seed) == ["s", "t"] and store.bootstrap(spark, root, seed) == []
    (tmp_path / "sessions").mkdir()
    (tmp_path / "sessions" / "sess-1.json").write_text("{}")
    assert store.save(spark, root, table(("s", "camera", "c2", '{"x":1}'), ("s", "site", "site", '{"a":2,"list":[1,{"q":"\\""}],"version":9}'))) == 2
    saved = _rows(store.load(spark, root))
    assert json.loads(saved[2][3]) == {"a": 2, "list": [1, {"q": '"'}], "version": 1} and [r[2] for r in saved] == ["c1", "c2", "site", "site"]
    store.save(spark, root, table(("s", "site", "site", '{"a":3}')))
    assert json.loads(_rows(store.load(spark, root))[2][3]) == {"a": 3, "version": 2}
    # a writer that dies leaves files without a mark of completion
    torn = tmp_path / "versions" / "4"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half")
    before = _rows(store.load(spark, root))
    assert len(before) == 4
    assert store.reset(spark, root, seed, "s") and not store.reset(spark, root, seed, "stray")
    assert _rows(store.load(spark, root)) == sorted(r for r in _rows(seed) if r[0] in "st")  # c2 is gone, t is as it was
    assert (tmp_path / "sessions" / "sess-1.json").read_text() == "{}"


def test_floor_reset_touches_one_floor(spark):
    kinds = ("route", "exit", "zone", "bottleneck")
    rows = [(f, k, i, "old") for f in ("f0", "f1") for k in kinds for i in (("auto-evac-1", "r1") if k == "route" else ("e1",))]
    table = spark.createDataFrame(rows, "floor_id string, kind string, id string, body string")
    fresh = spark.createDataFrame([("n", "new")], "id string, body string")
    got = lambda **k: {tuple(r)[1:] for r in config.floor_reset(table, "f1", **k).where("floor_id = 'f1'").collect()}
    old = {r[1:] for r in rows if r[0] == "f1"}
    assert got() == old
    assert got(routes=fresh) == old - {("route", "auto-evac-1", "old")} | {("route", "n", "new")}
    assert got(routes=fresh, replace="all") == {r for r in old if r[0] != "route"} | {("route", "n", "new")}
    assert got(exits=fresh, clear_bottlenecks=True) == {r for r in old if r[0] in ("route", "zone")} | {("exit", "n", "new")}
    assert got(routes=fresh.limit(0), clear_zones=True) == old - {("route", "auto-evac-1", "old"), ("zone", "e1", "old")}
    assert config.floor_reset(table, "f1", fresh, fresh, "all", True, True).where("floor_id = 'f0'").count() == 5
    with pytest.raises(ValueError):
        config.floor_reset(table, "f1", replace="none")


def test_speeds_and_bounds(spark):
    h = [0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0]
    move = "h array<double>, units_per_px double, px_per_m double, dt double, u0 double, v0 double, u1 double, v1 double, least_px double"
    line = (0.0, 0.0, 30.0, 40.0, 5.0)
    rows = [(h, 0.2, 10.0, 2.0, *line), (h, None, None, 2.0, *line), (None, None, 10.0, 2.0, *line), (None, None, None, 2.0, *line), (None, None, 0.0, 2.0, *line), (h, None, None, 0.0, *line), (h, None, None, None, *line), (h, None, None, 1.0, 0.0, 0.0, 3.0, 3.9, 5.0)]
    got = [(round(r.speed, 9), r.unit) for r in cal.real_speeds(spark.createDataFrame(rows, move).coalesce(1)).collect()]
    assert got == [(9.0, "km/h"), (45.0, "km/h"), (9.0, "km/h"), (25.0, "px/s"), (25.0, "px/s"), (0.0, "km/h"), (0.0, "km/h"), (0.0, "km/h")]
    kind = "cam_id string, map_w int, map_h int, h array<double>, roi array<struct<u: double, v: double>>, width int, height int"
    roi = [(2.0, 4.0), (8.0, -2.0)]
    cams = [("map", 5, 6, h, roi, 100, 50), ("roi", None, None, h, roi, 100, 50), ("bare", None, None, h, None, 100, 50), ("px", None, None, None, roi, 100, 50)]
    assert {r.cam_id: tuple(r)[1:] for r in cal.map_bounds(spark.createDataFrame(cams, kind)).collect()} == {
        "map": (0.0, 0.0, 5.0, 6.0), "roi": (1.0, -1.0, 4.0, 2.0), "bare": (None,) * 4, "px": (0.0, 0.0, 100.0, 50.0),
    }


def test_truth_by_frame(spark):
    rows = [("a", 1, 0.0, 0.0, 1.0), ("b", 1, 2.0, 2.0, 3.0), ("c", 1, None, None, None), ("a", 2, 9.0, 9.0, 8.0), ("c", 3, None, None, None), ("a", 3, -1.0, 1.0, 1.0), ("d", 1, 5.0, 1.0, 0.5), ("d", 3, -5.0, 1.0, 0.5)]
    table = spark.createDataFrame(rows, "agent string, frame int, x double, y double, speed double")
    square = ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))
    assert {r.frame: (r.n, r.density, r.speed) for r in agr.truth_counts(table, square, 8.0).collect()} == {1: (2, 0.25, 2.0), 2: (0, 0.0, None), 3: (0, 0.0, None)}
    line = ((0.0, -10.0), (0.0, 10.0))
    assert agr.truth_summary(table, square, 8.0, line).first().asDict() == {"peak_speed": 2.0, "peak_count": 2, "peak_density": 0.25, "unique_exits": 2}
    far = ((50.0, 50.0), (51.0, 50.0), (51.0, 51.0))
    assert agr.truth_summary(table.limit(0), far, 8.0, line).first().asDict() == {"peak_speed": None, "peak_count": None, "peak_density": None, "unique_exits": 0}
