"""Lifecycles, line versions, recordings, smoothing and written exits against
brute force and hand-made cases."""

import json
import random

import numpy as np

from floorflow.operators import lifecycle as life
from floorflow.operators import smoothing
from floorflow.sources import drawings as dxf
from floorflow.streaming import recorder


def test_commands_follow_a_state_machine(spark):
    rng = random.Random(5)
    rows = [("f%d" % rng.randrange(2), rng.randrange(40), n, rng.choice(["start", "stop", "reset", "pause", None])) for n in range(200)]
    rows += [(None, 1, 900, "start"), ("f0", None, 901, "start")]
    got = life.decided(spark.createDataFrame(rows, "floor_id string, at_us long, n long, command string"))
    want, running, epoch = set(), {}, {}
    for f, _, n, c in sorted((r for r in rows[:200] if r[3] in ("start", "stop", "reset")), key=lambda r: (r[1], r[2])):
        on = running.get(f, False)
        passes = {"start": not on, "stop": on, "reset": True}[c]
        if c != "reset":
            running[f] = c == "start"
        if passes and c != "stop":
            epoch[f] = epoch.get(f, 0) + 1
        want.add((n, passes, epoch.get(f, 0)))
    assert {(r.n, r.accepted, r.epoch) for r in got.collect()} == want


def test_sessions_end_at_the_next_stop(spark):
    rows = [("a", 1000, 0, "start"), ("a", 2000, 1, "start"), ("a", 3000, 2, "reset"), ("a", 4000, 3, "stop"), ("a", 5000, 4, "stop"), ("a", 6000, 5, "start")]
    got = life.session_spans(spark.createDataFrame(rows, "floor_id string, at_us long, n long, command string")).collect()
    assert sorted((r.session_id, r.start_us, r.stop_us) for r in got) == [("sess-1", 1000, 4000), ("sess-6", 6000, None)]
    none = spark.createDataFrame([], "floor_id string, at_us long, n long, command string")
    assert life.session_spans(none).collect() == []


def _versions(spark, rows):
    return spark.createDataFrame(rows, "floor_id string, exit_id string, from_us long, ax double, ay double, bx double, by double, ix double, iy double")


def test_a_side_outlives_a_version_of_the_same_line_only(spark):
    line, moved, gone = (0.0, 0.0, 10.0, 0.0, 5.0, 5.0), (0.0, 1.0, 10.0, 1.0, 5.0, 5.0), (None,) * 6
    step = lambda n, y: ("f", "p", 0, n * 10, n, 5.0, y)
    seen = spark.createDataFrame([step(0, -4.0), step(1, 0.2), step(2, 4.0), step(3, -4.0), step(4, 4.0)], "floor_id string, gid string, seg int, ts_us long, n int, x double, y double")

    def counts(*more):
        rows = [("f", "e", 0, *line), *(("f", "e", t, *g) for t, g in more)]
        return sorted(tuple(r)[2:] for r in life.reloaded_counts(seen, _versions(spark, rows), 0.5).collect())

    assert counts() == [(0, 1, 1)]
    assert counts((15, line)) == [(0, 1, 1)]
    # outside at 0, near the line at 10, another line from 15 on: no entry at 20, but one at 40
    assert counts((15, moved)) == [(0, 1, 1)]
    assert counts((15, moved), (35, line)) == [(0, 0, 1)]
    assert counts((25, gone), (28, line)) == [(0, 1, 0), (1, 1, 0)]
    assert life.reloaded_counts(seen, _versions(spark, [("f", "e", 0, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0)]), 0.5).collect() == []


def _tree(t, y, depth):
    """Least squares tree by trying every cut."""
    best = None
    if depth and len(t) >= 6:
        for i in range(1, len(t)):
            if t[i] > t[i - 1]:
                gain = (y[:i].mean() - y[i:].mean()) ** 2 * i * (len(t) - i) / len(t)
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, i
    if best is None:
        return np.full(len(t), y.mean())
    i = best[1]
    return np.concatenate([_tree(t[:i], y[:i], depth - 1), _tree(t[i:], y[i:], depth - 1)])


def test_smoothing_equals_plain_boosting(spark):
    rng = np.random.default_rng(3)
    for n in (1, 5, 6, 40):
        t = np.sort(rng.integers(0, 60, n))
        y = rng.normal(size=(2, n)) * 20 + t
        fit = np.repeat(y.mean(axis=1, keepdims=True), n, axis=1)
        for _ in range(smoothing.TREES):
            for k in range(2):
                fit[k] += smoothing.RATE * _tree(t, y[k] - fit[k], smoothing.DEEPEST)
        assert np.allclose(smoothing.boosted(t, y), fit, atol=1e-6)
    rows = [("s", i % 2, f, float(f), 3.0, 1.0, None if f == 4 else 2.0) for f in range(12) for i in range(2)]
    table = spark.createDataFrame(rows, "seq string, id int, frame int, x double, y double, w double, h double")
    got = smoothing.smoothed(table).collect()
    assert len(got) == 22 and all(abs(r.y - 3) < 1e-9 and abs(r.h - 2) < 1e-9 for r in got)
    assert all(abs(r.x - r.frame) < 1.5 for r in got)
    assert smoothing.smoothed(table.limit(0)).collect() == []


def test_a_recording_holds_what_the_metrics_drop(spark, tmp_path):
    kind = "session_id string, floor_id string, cam_id string, ts_us long, conf double"
    for part in ([("s", "f", "c", 1, 0.9), ("s", "f", "c", 1, 0.1)], [("s", "f", "c", 2, None), ("s", "g", "c", 2, 0.7)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # a second start finds nothing new
        recorder.record(stream, out, lambda rows: rows.where("conf >= 0.5")).awaitTermination()
    raw = recorder.recorded(spark, out, kind)
    assert sorted(tuple(r) for r in recorder.closing_counts(raw).collect()) == [("s", "f", 2, 3), ("s", "g", 1, 1)]
    assert spark.read.parquet(f"{out}/seen").count() == 2


def test_exits_are_written_into_drawings(spark):
    body = "  0\r\nSECTION\r\n  2\r\nBLOCKS\r\n  0\r\nENDSEC\r\n  0\r\nSECTION\r\n  2\r\nENTITIES\r\n  0\r\nLINE\r\n  8\r\nwalls\r\n 10\r\n1\r\n 20\r\n2\r\n 11\r\n3\r\n 21\r\n4\r\n  0\r\nENDSEC\r\n  0\r\nEOF"
    texts = spark.createDataFrame([("a", body), ("b", body), ("c", "none"), ("d", None)], "drawing string, value string")
    exits = spark.createDataFrame([("a", 10.5, 2.0), ("a", -3.0, 0.125), ("c", 1.0, 1.0), ("a", None, 1.0)], "drawing string, x double, y double")
    out = dxf.with_exits(texts, exits)
    found = dxf.placed(dxf.entities(out))
    assert sorted((r.drawing, r.mark, r.x, r.y) for r in dxf.marks(found).collect()) == [("a", "exit", -3.0, 0.125), ("a", "exit", 10.5, 2.0)]
    assert sorted(r.drawing for r in dxf.segments(found).where("layer = 'walls'").collect()) == ["a", "b"]
    assert {r.drawing: r.value for r in out.where("drawing <> 'a'").collect()} == {"b": body, "c": "none", "d": None}
    lists = dxf.exit_list(exits.where("x IS NOT NULL"))
    assert json.loads(lists.where("drawing = 'a'").first().value) == {"exits_m": [[-3.0, 0.13], [10.5, 2.0]]}
    assert dxf.exit_points(lists).count() == 3


def test_drill_starts_equal_a_loop_however_many_spans_a_stretch_has(spark):
    rng = np.random.default_rng(7)
    begun = rng.integers(0, 200_000_000, 1500)
    spans = [(f"f{k % 3}", int(a), None if k % 400 == 0 and a > 150_000_000 else int(a + rng.integers(0, 150_000))) for k, a in enumerate(begun)]
    spans.append(("f1", 20_000_000, 90_000_000))  # over other spans and many stretches
    asked = [(k, int(t), ["f0", "f1"]) for k, t in enumerate(np.append(rng.integers(0, 210_000_000, 400), begun[:50]))]
    requests = spark.createDataFrame([(n, t, None, o) for n, t, o in asked] + [(-1, None, None, ["f0", "f1"])], "n long, at_us long, alarm_us long, origins array<string>")
    out = life.drill_starts(requests, ["f0", "f1"], spark.createDataFrame(spans, "floor_id string, start_us long, stop_us long"))
    busy = lambda t: ",".join(f for f in ("f0", "f1") if any(g == f and a <= t and (b is None or t < b) for g, a, b in spans))
    assert {r.n: r.floors for r in out.collect()} == {-1: ""} | {n: busy(t) for n, t, _ in asked}
    # a request meets no span by span: rows between stretches grow as both tables, not as their product
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "start_us" not in "".join(x for x in plan.splitlines() if "Join" in x)
