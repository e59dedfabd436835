"""Geometry strings and kernels by hand."""

import itertools

import numpy as np
import pytest

from floorflow.functions import geometry as g
from floorflow.operators import assignment

SQUARE = ((100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0))


def _value(spark, text, **columns):
    row = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in columns.items())
    return spark.sql(f"SELECT {text} AS v FROM (SELECT {row})").first().v


@pytest.mark.parametrize("point,want", [((100, 200), True), ((99, 200), False), ((300, 300), True), ((200, 150), True)])
def test_inside_holds_the_boundary(spark, point, want):
    assert _value(spark, g.inside("x", "y", SQUARE), x=point[0], y=point[1]) is want


@pytest.mark.parametrize("point,want", [((5, 3), 3.0), ((12, 5), 2.0), ((-3, 4), 5.0), ((7, 0), 0.0)])
def test_polyline_distance(spark, point, want):
    parts = [g.segment_distance2("x", "y", a, b) for a, b in (((0, 0), (10, 0)), ((10, 0), (10, 10)))]
    assert _value(spark, f"sqrt(least({', '.join(parts)}))", x=point[0], y=point[1]) == pytest.approx(want)


def test_area_hull_and_projection(spark):
    assert g.area(SQUARE) == 40000
    assert g.convex_hull([*SQUARE, (200.0, 200.0), (200.0, 100.0)]) == [(100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0)]
    x, y = g.homography("x", "y", (2.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0))
    assert _value(spark, x, x=3, y=4) == 3.5 and _value(spark, y, x=3, y=4) == 2.0


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (2, 7)]:
        for _ in range(20):
            c = rng.random((n, m))
            pairs = assignment.solve(c)
            assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
            small, large = (c, c.shape[1]) if n <= m else (c.T, c.shape[0])
            best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(large), len(small)))
            assert sum(c[i, j] for i, j in pairs) == pytest.approx(best)
    assert assignment.solve(np.zeros((0, 3))) == []
