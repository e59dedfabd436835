import heapq
import math
import time

import numpy as np
import pytest

from floorflow.operators import calibration as cal
from floorflow.sources import drawings as dxf


def test_four_pairs_are_met_exactly_and_more_by_least_squares():
    h = np.array([[1.2, 0.1, 30.0], [-0.05, 0.9, 7.0], [1e-4, 2e-4, 1.0]])
    src = np.random.default_rng(1).uniform(0, 1000, (9, 2))
    p = np.column_stack([src, np.ones(9)]) @ h.T
    dst = p[:, :2] / p[:, 2:]
    assert np.allclose(cal.fit_plane(src[:4], dst[:4]), h, atol=1e-6)
    assert np.allclose(cal.fit_plane(src, dst), h, atol=1e-6)


@pytest.mark.parametrize(
    "src",
    [[(0, 0), (1, 1), (2, 2), (3, 3)], [(0, 0), (1, 0), (1, 1)], [(0, 0)] * 5, [(0, 0), (1, 0), (1, 1), (0, math.nan)]],
)
def test_pairs_that_leave_it_open_give_none(src):
    src = np.array(src, float)
    assert cal.fit_plane(src, np.array([(0, 0), (5, 0), (5, 5), (0, 5), (1, 2)], float)[: len(src)]) is None


def test_empty_pairs(spark):
    none = spark.createDataFrame([], "cam_id string, u double, v double, x double, y double")
    assert cal.plane_fits(none).count() == 0
    assert cal.fit_errors(none, cal.plane_fits(none)).count() == 0


def test_graph_distances_equal_a_heap_search(spark):
    rng = np.random.default_rng(7)
    xy = {f"n{i}": tuple(map(float, rng.uniform(0, 100, 2))) for i in range(25)}
    edges = {tuple(f"n{i}" for i in rng.choice(25, 2, replace=False)) for _ in range(28)}
    nodes = spark.createDataFrame([("g", k, *p) for k, p in xy.items()] + [("h", "n0", 0.0, 0.0)], "graph_id string, node_id string, x double, y double")
    links = spark.createDataFrame([("g", a, b) for a, b in edges] + [("g", "n0", "gone")], "graph_id string, a string, b string")
    asked = spark.createDataFrame([("g", "n0"), ("g", "n3"), ("h", "n0"), ("g", "gone")], "graph_id string, node_id string")
    got = {(r.graph_id, r.source, r.node_id): r.distance for r in cal.graph_distances(nodes, links, asked).collect()}
    want = {("h", "n0", "n0"): 0.0}
    for source in ("n0", "n3"):
        heap, done = [(0.0, source)], set()
        while heap:
            d, k = heapq.heappop(heap)
            if k in done:
                continue
            done.add(k)
            want["g", source, k] = d
            for a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == k:
                        heapq.heappush(heap, (d + math.dist(xy[p], xy[q]), q))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_graph_or_straight_needs_a_scale(spark):
    nodes = spark.createDataFrame([("g", "a", 0.0, 0.0), ("g", "b", 0.0, 8.0), ("g", "c", 6.0, 8.0)], "graph_id string, node_id string, x double, y double")
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c")], "graph_id string, a string, b string")
    kind = "graph_id string, zone string, ox double, oy double, zx double, zy double, node string"
    trips = spark.createDataFrame([("g", "z", 0.0, 1.0, 6.0, 7.0, None), ("g", "own", 0.0, 1.0, 6.0, 7.0, "b"), ("none", "line", 0.0, 0.0, 3.0, 4.0, None)], kind)
    got = {r.zone: (r.metres, r.by_graph) for r in cal.graph_or_straight(trips, nodes, edges, 0.5).collect()}
    assert got == {"z": (7.0, True), "own": (4.0, True), "line": (2.5, False)}
    assert {r.metres for r in cal.graph_or_straight(trips, nodes, edges, None).collect()} == {None}


def _text(*tags):
    return "\r\n".join(str(t) for t in tags)


def test_a_drawing_by_hand(spark):
    line = lambda layer, *at: (0, "LINE", 5, "A" + layer, 8, layer, 10, at[0], 20, at[1], 11, at[2], 21, at[3])
    blocks = (0, "SECTION", 2, "BLOCKS", 0, "BLOCK", 2, "B", 10, 0, 20, 0, *line("walls", 0, 0, 1, 0), *line(dxf.EXIT, 0, 0, 0, 2), 0, "ENDBLK", 0, "ENDSEC")
    insert = lambda layer, *more: (0, "INSERT", 5, "I" + layer, 8, layer, 2, "B", 10, 10, 20, 20, *more)
    body = (
        0, "SECTION", 2, "ENTITIES", *line("walls", 0, 0, 3, 4), *line(dxf.WORST, 0, 0, 9, 9), *line(dxf.OCCUPANT, 1, 2, 3, 4), *insert("0", 50, 90),
        *insert(dxf.PASS), 0, "INSERT", 5, "X", 8, "0", 2, "gone", 0, "HATCH", 8, "walls", 10, 0, 20, 0, 0, "ARC", 5, "C", 8, "walls", 10, 0, 20, 0,
        40, 1, 50, 270, 51, 90, 0, "ENDSEC", 0, "EOF",
    )
    rows = [("d", _text(*blocks, *body)), ("empty", ""), ("junk", "no tags\nat all"), ("null", None)]
    lying = dxf.placed(dxf.entities(spark.createDataFrame(rows, "drawing string, value string")))
    walls = sorted((r.handle, *(round(v, 6) + 0.0 for v in r[3:])) for r in dxf.segments(lying).collect())
    assert walls == [("Awalls", 0, 0, 3, 4), ("C", 0, -1, 1, 0), ("C", 1, 0, 0, 1), ("I0", 10, 20, 10, 21)]
    marks = sorted((r.mark, round(r.x, 6), round(r.y, 6)) for r in dxf.marks(lying).collect())
    assert marks == [("exit", 9, 20), ("occupant", 1, 2), ("occupant", 3, 4)]


def test_header_extents(spark):
    text = _text(9, "$EXTMIN", 10, -1.5, 20, 2, 30, 0, 9, "$EXTMAX", 10, 7, 20, 8, 30, 0)
    got = dxf.extents(spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "drawing string, value string")).collect()
    assert [tuple(r) for r in got] == [("a", -1.5, 2.0, 7.0, 8.0), ("b", None, None, None, None), ("c", None, None, None, None)]


def test_a_long_drawing_is_split_once(spark):
    one = "0\nLINE\n5\n{k}\n8\nwalls\n10\n{k}\n20\n1\n11\n2\n21\n3"
    text = "\n".join(["0", "SECTION", "2", "ENTITIES", *(one.format(k=k) for k in range(2500)), "0", "ENDSEC", "0", "EOF"])
    began = time.monotonic()
    got = dxf.entities(spark.createDataFrame([("d", text), ("none", "0"), ("null", None)], "drawing string, value string")).where("kind = 'LINE'").collect()
    assert sorted((r.drawing, float(r.handle), r.xs[0], r.x2) for r in got) == [("d", float(k), float(k), 2.0) for k in range(2500)]
    assert time.monotonic() - began < 30  # split again for each line it takes minutes
