"""Geometry as SQL expressions over constant shapes.

Site geometry is configuration: a few polygons, lines and routes.  Unrolled
into arithmetic over their coordinates, tests against them need no join and
stay inside generated code; the strings hold standard SQL only.
"""

from __future__ import annotations

from collections.abc import Sequence

Point = tuple[float, float]


def num(value: float | None) -> str:
    """A double literal (an exponent keeps it from being a decimal)."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"


def _edges(polygon: Sequence[Point]):
    return list(zip(polygon, [*polygon[1:], polygon[0]]))


def even_odd(x: str, y: str, polygon: Sequence[Point]) -> str:
    """Inside by crossing parity, half open."""
    hits = []
    for (x1, y1), (x2, y2) in _edges(polygon):
        if y1 == y2:
            continue
        at = f"({num(x2 - x1)} * ({y} - {num(y1)}) / {num(y2 - y1)} + {num(x1)})"
        hits.append(f"CASE WHEN (({num(y1)} > {y}) <> ({num(y2)} > {y})) AND {x} < {at} THEN 1 ELSE 0 END")
    return f"((({' + '.join(hits) or '0'}) % 2) = 1)"


def guarded(x: str, y: str, polygon: Sequence[Point]) -> str:
    """Inside by crossing parity as the simulations' truth has it: half open,
    edges lengthened by a hair upwards so that level ones divide by it."""
    hits = [
        f"CASE WHEN (({num(y1)} > {y}) <> ({num(y2)} > {y})) AND {x} < ({num(x2 - x1)} * ({y} - {num(y1)}) / {num(y2 - y1 + 1e-12)} + {num(x1)}) THEN 1 ELSE 0 END"
        for (x2, y2), (x1, y1) in _edges(polygon)
    ]
    return f"((({' + '.join(hits)}) % 2) = 1)"


def on_edge(x: str, y: str, polygon: Sequence[Point]) -> str:
    tests = []
    for (x1, y1), (x2, y2) in _edges(polygon):
        cross = f"({num(x2 - x1)} * ({y} - {num(y1)}) - {num(y2 - y1)} * ({x} - {num(x1)}))"
        tests.append(
            f"({cross} = 0e0 AND {x} BETWEEN {num(min(x1, x2))} AND {num(max(x1, x2))}"
            f" AND {y} BETWEEN {num(min(y1, y2))} AND {num(max(y1, y2))})"
        )
    return f"({' OR '.join(tests)})"


def inside(x: str, y: str, polygon: Sequence[Point]) -> str:
    """Inside or on the boundary."""
    return f"({even_odd(x, y, polygon)} OR {on_edge(x, y, polygon)})"


def area(polygon: Sequence[Point]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in _edges(polygon))) / 2


def centroid(polygon: Sequence[Point]) -> Point:
    """Mean of the vertices."""
    return sum(p[0] for p in polygon) / len(polygon), sum(p[1] for p in polygon) / len(polygon)


def convex_hull(points: Sequence[Point]) -> list[Point]:
    """Counter-clockwise hull without collinear points."""

    def chain(ordered):
        out: list[Point] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ordered = sorted(set(points))
    return ordered if len(ordered) < 3 else chain(ordered) + chain(reversed(ordered))


def homography(u: str, v: str, h: Sequence[float]) -> tuple[str, str]:
    """x and y of a plane projection, row-major 3 x 3."""
    w = f"({num(h[6])} * {u} + {num(h[7])} * {v} + {num(h[8])})"
    return (
        f"(({num(h[0])} * {u} + {num(h[1])} * {v} + {num(h[2])}) / {w})",
        f"(({num(h[3])} * {u} + {num(h[4])} * {v} + {num(h[5])}) / {w})",
    )


def segment_part(x: str, y: str, a: Point, b: Point) -> str:
    """Position along a segment, clamped to 0..1 (0 if it has no length)."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    if size == 0:
        return "0e0"
    return f"least(1e0, greatest(0e0, (({x} - {num(a[0])}) * {num(dx)} + ({y} - {num(a[1])}) * {num(dy)}) / {num(size)}))"


def segment_distance2(x: str, y: str, a: Point, b: Point) -> str:
    t = segment_part(x, y, a, b)
    ex = f"({x} - ({num(a[0])} + {t} * {num(b[0] - a[0])}))"
    ey = f"({y} - ({num(a[1])} + {t} * {num(b[1] - a[1])}))"
    return f"({ex} * {ex} + {ey} * {ey})"


def line_distance(x: str, y: str, a: Point, b: Point, within: Point) -> str:
    """Signed distance from the line a-b, positive on the side of ``within``."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = (dx * dx + dy * dy) ** 0.5
    side = dx * (within[1] - a[1]) - dy * (within[0] - a[0])
    sign = 1.0 if side >= 0 else -1.0
    return f"({num(sign * dx / size)} * ({y} - {num(a[1])}) - {num(sign * dy / size)} * ({x} - {num(a[0])}))"


def line_part(x: str, y: str, a: Point, b: Point) -> str:
    """Unclamped position along a-b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    return f"((({x} - {num(a[0])}) * {num(dx)} + ({y} - {num(a[1])}) * {num(dy)}) / {num(dx * dx + dy * dy)})"


def iou(a: str, b: str) -> str:
    """Overlap of boxes a and b, each with x1, y1, x2, y2."""
    w = f"greatest(0e0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"greatest(0e0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    size = lambda c: f"({c}.x2 - {c}.x1) * ({c}.y2 - {c}.y1)"
    return f"({w} * {h} / ({size(a)} + {size(b)} - {w} * {h}))"


def box_grown(box: str, part: str) -> dict[str, str]:
    """A box's sides moved out by ``part`` of its width and height."""
    w, h = f"({box}.x2 - {box}.x1)", f"({box}.y2 - {box}.y1)"
    return {
        "x1": f"{box}.x1 - {w} * {part}",
        "y1": f"{box}.y1 - {h} * {part}",
        "x2": f"{box}.x2 + {w} * {part}",
        "y2": f"{box}.y2 + {h} * {part}",
    }
