import heapq
import math

import numpy as np

from floorflow.operators import routing
from floorflow.streaming import live


def _by_heap(blocked, starts):
    far, heap = {}, [(0.0, p) for p in starts if not blocked[p]]
    while heap:
        d, p = heapq.heappop(heap)
        if p in far:
            continue
        far[p] = d
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                q = (p[0] + i, p[1] + j)
                if (i or j) and 0 <= q[0] < blocked.shape[0] and 0 <= q[1] < blocked.shape[1] and not blocked[q]:
                    heapq.heappush(heap, (d + math.hypot(i, j), q))
    return far


def test_walking_distance_equals_a_heap_search():
    rng = np.random.default_rng(3)
    blocked = rng.random((17, 23)) < 0.35
    start = np.zeros_like(blocked)
    for p in ((0, 0), (9, 11), (16, 22)):
        start[p] = True
    got = routing.walking_distance(blocked, start)
    want = _by_heap(blocked, [tuple(p) for p in np.argwhere(start)])
    assert {tuple(p) for p in np.argwhere(np.isfinite(got))} == set(want)
    assert all(abs(got[p] - d) < 1e-9 for p, d in want.items())


def test_walls_block_and_exits_stay_free(spark):
    walls = spark.createDataFrame([(0.0, 25.0, 50.0, 25.0), (500.0, 500.0, 500.0, 500.0)], "ax double, ay double, bx double, by double")
    exits = spark.createDataFrame([(25.0, 25.0)], "x double, y double")
    rows = routing.obstacle_grid(walls, exits, 5, 5, 10.0, 4.0).collect()
    assert len(rows) == 25 and {(r.r, r.c) for r in rows if r.blocked} == {(2, 0), (2, 1), (2, 3), (2, 4)}
    shapes = spark.createDataFrame(
        [("open", "rect", [0.0, 0.0, 15.0, 45.0], None), ("block", "rect", [0.0, 41.0, 5.0, 49.0], None), ("block", "line", [5.0, 5.0, 5.0, 5.0], 8.0),
         ("block", "poly", [20.0, 0.0, 40.0, 0.0, 40.0, 20.0, 20.0, 20.0], None), ("block", "poly", [0.0, 0.0], None), ("block", "star", [1.0] * 9, None)],
        "op string, kind string, pts array<double>, w double",
    )
    cells = spark.createDataFrame(rows)
    edited = routing.apply_shapes(cells, shapes, 5, 5, 10.0).where("blocked").collect()
    assert {(r.r, r.c) for r in edited} == {(2, 3), (2, 4), (4, 0), (0, 0), (0, 2), (0, 3), (1, 2), (1, 3)}
    free = routing.apply_shapes(cells, shapes, 5, 5, 10.0, spark.createDataFrame([(5.0, 45.0)], "x double, y double"))
    assert not free.where("r = 4 AND c = 0").first().blocked
    assert not routing.obstacle_grid(walls.limit(0), exits.limit(0), 5, 5, 10.0, 4.0).where("blocked").count()


def _plan(rng, share=0.3):
    blocked = rng.random((20, 20)) < share
    start = np.zeros_like(blocked)
    for p in ((0, 0), (13, 7)):
        blocked[p], start[p] = False, True
    return blocked, start, routing.walking_distance(blocked, start)


def test_ways_out_are_as_long_as_the_distance():
    blocked, start, dist = _plan(np.random.default_rng(5))
    for p in map(tuple, np.argwhere(np.isfinite(dist))):
        path = routing.way_out(dist, p)
        assert path[0] == p and start[path[-1]] and not any(blocked[q] for q in path)
        steps = [math.dist(a, b) for a, b in zip(path, path[1:])]
        assert max(steps, default=0) < 1.5 and abs(sum(steps) - dist[p]) < 1e-6
        corners = routing.pulled(blocked, path)
        assert corners[0] == p and corners[-1] == path[-1] and all(routing.visible(blocked, a, b) for a, b in zip(corners, corners[1:]) if math.dist(a, b) > 1.5)
        assert sum(math.dist(a, b) for a, b in zip(corners, corners[1:])) <= dist[p] + 1e-9


def test_sight_stops_at_walls_and_closed_corners():
    blocked = np.zeros((5, 5), bool)
    assert routing.visible(blocked, (0, 0), (4, 3)) and routing.visible(blocked, (2, 2), (2, 2))
    blocked[2, 2] = True
    assert not routing.visible(blocked, (0, 0), (4, 4)) and routing.visible(blocked, (0, 4), (4, 4))
    corner = np.zeros((2, 2), bool)
    corner[0, 1] = True
    assert routing.visible(corner, (0, 0), (1, 1))
    corner[1, 0] = True
    assert not routing.visible(corner, (0, 0), (1, 1))


def test_starts_in_walls_move_to_the_nearest_open_cell():
    blocked, _, dist = _plan(np.random.default_rng(6))
    for p in map(tuple, np.argwhere(blocked)):
        got = routing.nearest_open(blocked, dist, p, 3)
        near = [q for q in map(tuple, np.argwhere(np.isfinite(dist))) if max(abs(q[0] - p[0]), abs(q[1] - p[1])) <= 3]
        rings = [max(abs(q[0] - p[0]), abs(q[1] - p[1])) for q in near]
        assert (got is None) == (not near) and (got is None or max(abs(got[0] - p[0]), abs(got[1] - p[1])) == min(rings))


def test_worst_cells_are_far_and_apart():
    blocked, _, dist = _plan(np.random.default_rng(7), 0.1)
    got = routing.worst_cells(blocked, dist, 4, 6.0, 1.0)
    assert len(got) == 4 and dist[got[0]] == dist[np.isfinite(dist)].max()
    assert min(math.dist(a, b) for i, a in enumerate(got) for b in got[:i]) >= 6.0 * 0.7**4


def test_regions_of_rooms():
    rooms = np.zeros((6, 7), bool)
    rooms[:, 3] = True
    assert len(np.unique(routing.regions(rooms))) == 3
    rooms[2, 3] = False
    got = routing.regions(rooms)
    assert set(np.unique(got)) == {0, 1} and (got > 0).sum() == 37
    corner = np.array([[False, True], [True, False]])
    assert routing.regions(corner).max() == 2


def test_paths_by_floor(spark):
    cells = [(f, r, c, (c == 3 and not (f == "b" and r == 0)), (r, c) == (5, 6)) for f in "ab" for r in range(6) for c in range(7)]
    frame = spark.createDataFrame(cells, "floor_id string, r int, c int, blocked boolean, start boolean")
    starts = spark.createDataFrame([("a", 1, 5.0, 5.0), ("b", 1, 5.0, 5.0), ("b", 2, 65.0, 55.0), ("b", 3, 55.0, 55.0)], "floor_id string, start_id long, x double, y double")
    got = {(r.floor_id, r.start_id): r for r in routing.evacuation_paths(frame, starts, 10.0, 3.0, 50.0).collect()}
    assert [got[k].status for k in (("a", 1), ("b", 1), ("b", 2), ("b", 3))] == ["unreachable", "fail", "at_exit", "pass"]
    assert got[("b", 1)].points[0] == (5.0, 5.0) and got[("b", 1)].points[-1] == (65.0, 55.0)
    assert {(r.floor_id, r.regions) for r in routing.connectivity(frame).collect()} == {("a", 2), ("b", 1)}
    route = routing.map_routes(routing.evacuation_paths(frame, starts, 10.0, 3.0, 50.0), 70.0, 60.0, 700.0, 600.0).where("route_id = 'auto-evac-1'").first()
    assert route.points[0] == (50.0, 550.0)


def _tracks(spark, times):
    return spark.createDataFrame([(g, "cam0", t) for g, t in times], "gid string, cam_id string, ts_us long")


def test_streams_equal_batches(spark, tmp_path):
    s = 1_000_000
    first = [("a", 0), ("a", 2 * s), ("b", 1 * s), ("a", 6 * s)]
    second = [("a", 7 * s), ("b", 30 * s)]
    for k, part in enumerate((first, second)):
        _tracks(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("gid string, cam_id string, ts_us long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    both = _tracks(spark, first + second)
    for make in (lambda t: live.visits(t, 3 * s), lambda t: live.rates(t)):
        got, want = live.drain(make(stream)).collect(), make(both).collect()
        assert sorted(got) == sorted(want)
    visits = {(r.gid, r.first_us, r.n) for r in live.visits(both, 3 * s).collect()}
    assert visits == {("a", 0, 2), ("a", 6 * s, 2), ("b", s, 1), ("b", 30 * s, 1)}


def test_append_mode_emits_what_the_watermark_closed(spark, tmp_path):
    s = 1_000_000
    for part in ([("a", 0), ("a", s)], [("b", 100 * s)], [("b", 101 * s)]):
        _tracks(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("gid string, cam_id string, ts_us long").parquet(str(tmp_path / "in"))
    closed = live.drain(live.visits(stream, 3 * s, late="5 seconds"), "append").select("gid", "first_us", "n").collect()
    assert [tuple(r) for r in closed] == [("a", 0, 2)]
