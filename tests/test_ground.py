"""Hulls, regions, focal lengths and ground planes against numpy and brute force."""

import random

import numpy as np
import pytest

from floorflow.functions.geometry import convex_hull
from floorflow.operators import ground, hull
from floorflow.plans.site import Camera


def _outside(hull_, points):
    """Points that lie to the right of an edge of a counter-clockwise hull."""
    edges = list(zip(hull_, hull_[1:] + hull_[:1]))
    return [p for p in points if any((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) < -1e-9 for a, b in edges)]


def test_hulls_merge_over_tasks(spark, monkeypatch):
    rng = random.Random(4)
    groups = {f"g{k}": [(float(rng.randrange(-50, 50)), float(rng.randrange(-50, 50))) for _ in range(rng.randrange(3, 400))] for k in range(12)}
    groups |= {"one": [(3.0, 4.0)] * 5, "line": [(float(k), 2.0 * k) for k in range(30)], "two": [(0.0, 0.0), (1.0, 0.0)]}
    rows = [(g, *p) for g, points in groups.items() for p in points] + [(None, 1.0, 1.0), ("g1", None, 1.0), ("g1", float("nan"), 1.0), ("g1", 1.0, float("inf"))]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    got = {r.g: [(p.x, p.y) for p in r.polygon] for r in hull.hulls(table, "g").collect()}
    assert got == {g: convex_hull(points) for g, points in groups.items()}
    assert got["one"] == [(3.0, 4.0)] and got["line"] == [(0.0, 0.0), (29.0, 58.0)]
    for g, points in groups.items():
        assert set(got[g]) <= set(points) and (len(got[g]) < 3 or not _outside(got[g], points))
    assert hull.hulls(table.limit(0), "g").count() == 0


def test_regions_fall_back_to_the_hull(spark):
    roi = [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)]
    cameras = spark.createDataFrame([("a", roi), ("b", None), ("c", []), ("d", None)], f"cam_id string, roi {hull.POLYGON}")
    pairs = [(c, x, y) for c in "abc" for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0))]
    got = {r.cam_id: [(p.x, p.y) for p in r.polygon] for r in hull.regions(cameras, spark.createDataFrame(pairs, "cam_id string, x double, y double")).collect()}
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert got == {"a": roi, "b": square, "c": square}
    h = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    assert Camera("b", h, (), points=tuple(square + [(1.0, 1.0)])).region == tuple(square) and Camera("a", h, tuple(roi)).region == tuple(roi)


W, H, FOCAL = 120, 90, 110.0
PLANES = {1: ((0.05, 0.95, 0.3), 1.6), 2: ((-0.2, 0.9, 0.25), 2.4), 3: ((0.0, 1.0, 0.1), 1.2)}


@pytest.fixture(scope="module")
def scene(spark):
    """Noisy floors, a fifth of the pixels off them, and people who hide some."""
    rng = np.random.default_rng(5)
    depths, people = [], []
    for image, (n, d) in PLANES.items():
        n = np.array(n) / np.linalg.norm(n)
        for v in range(H):
            for u in range(0, W, 2):
                slope = n @ np.array([(u - W / 2) / FOCAL, (v - H / 2) / FOCAL, 1.0])
                z = d / slope + rng.normal(0, 0.01) if slope > 0.05 else 0.0
                depths.append((image, u, v, float(rng.uniform(0.3, 6)) if rng.random() < 0.2 else float(z)))
        people += [(image, 10.0 * k, 20.0, 10.0 * k + 8, 60.0 + k) for k in range(4)] + [(image, 0.0, 0.0, 9.0, 9.0)]
    depths += [(4, u, 80, 1.0) for u in range(20)] + [(1, 0, 0, None)]
    return (
        spark.createDataFrame(depths, "image long, u int, v int, z double"), spark.createDataFrame(people, "image long, x1 double, y1 double, x2 double, y2 double"),
        spark.createDataFrame([(k, W, H) for k in (1, 2, 3, 4)], "image long, width int, height int"), depths, people,
    )


def test_focal_lengths_match_brute_force(scene):
    depths, people, _, rows, boxes = scene
    got = {r.image: r.focal for r in ground.focal_lengths(depths, people).collect()}
    table, want = {(i, u, v): z for i, u, v, z in rows}, {}
    for image in PLANES:
        found = []
        for i, x1, y1, x2, y2 in boxes:
            h, cx = y2 - y1, int((x1 + x2) / 2)
            if i == image and h >= 15:
                z = [table[i, u, v] for u in range(max(0, cx - 6), cx + 6) for v in range(max(0, int(y2 - 0.12 * h)), int(y2) + 1) if (i, u, v) in table]
                if z and np.median(z) > 0:
                    found.append(h * np.median(z) / 1.7)
        want[image] = np.median(found)
    assert got == pytest.approx(want)


def test_planes_are_found_among_outliers(spark, scene):
    depths, people, sizes, rows, boxes = scene
    focal = spark.createDataFrame([(k, FOCAL) for k in (1, 2, 3, 4)], "image long, focal double")
    points = ground.floor_points(depths, people, sizes, focal)
    kept = {(i, u, v) for i, u, v, z in rows if z and z > 0 and v >= int(H * 0.45) and not any(i == j and int(x1) <= u < int(x2) and int(y1) <= v < int(y2) for j, x1, y1, x2, y2 in boxes)}
    assert points.count() == len(kept)
    planes = {r.image: r for r in ground.ground_planes(points).collect()}
    assert planes.keys() == PLANES.keys()  # 20 points are no plane
    for image, (n, d) in PLANES.items():
        size, r = np.linalg.norm(n), planes[image]
        assert abs(np.array(n) / size @ [r.nx, r.ny, r.nz]) > 0.9999 and r.d == pytest.approx(d, abs=0.02) and 0.75 < r.inlier < 0.95
    assert {r.image: r.d for r in ground.ground_planes(points).collect()} == {k: r.d for k, r in planes.items()}
    shown = {r.image: [r[f"h{k}"] for k in range(9)] for r in ground.ground_projections(ground.ground_planes(points), sizes, focal).collect()}
    for image, r in planes.items():
        n, m = np.array([r.nx, r.ny, r.nz]), np.array(shown[image]).reshape(3, 3)
        ax = np.cross(n, [1.0, 0, 0])
        ax /= np.linalg.norm(ax)
        for u, v in ((30, 60), (90, 85), (60, 70)):
            ray = np.array([(u - W / 2) / FOCAL, (v - H / 2) / FOCAL, 1.0])
            place = r.d / (n @ ray) * ray - n * r.d
            w = m @ [u, v, 1.0]
            assert (w[:2] / w[2]).tolist() == pytest.approx([place @ ax, place @ np.cross(n, ax)], abs=1e-6)
