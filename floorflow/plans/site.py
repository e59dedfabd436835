"""The site that the registered queries evaluate: geometry and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.geometry import Point, area, convex_hull


@dataclass(frozen=True)
class Zone:
    name: str
    polygon: tuple[Point, ...]
    rho_crit: float = 1.0
    weight: float = 1.0
    floor: str = "f0"


@dataclass(frozen=True)
class Exit:
    name: str
    a: Point
    b: Point
    within: Point
    capacity: int | None
    floor: str = "f0"


@dataclass(frozen=True)
class Camera:
    name: str
    h: tuple[float, ...]
    #: Empty: the hull of the calibration points is the camera's region.
    roi: tuple[Point, ...]
    min_conf: float | None = None
    floor: str | None = "f0"
    points: tuple[Point, ...] = ()

    @property
    def region(self) -> tuple[Point, ...]:
        return self.roi or tuple(convex_hull(self.points))


@dataclass(frozen=True)
class Route:
    name: str
    points: tuple[Point, ...]
    floor: str = "f0"


@dataclass(frozen=True)
class Site:
    width: float = 1000.0
    height: float = 1000.0
    m_per_px: float | None = 0.01
    floors: tuple[str, ...] = ("f0",)
    zones: tuple[Zone, ...] = ()
    bottlenecks: tuple[Zone, ...] = ()
    exits: tuple[Exit, ...] = ()
    routes: tuple[Route, ...] = ()
    cameras: tuple[Camera, ...] = ()
    #: Cameras without a mapping, and their floors.
    unmapped: tuple[tuple[str, str | None], ...] = ()
    origins: tuple[Point, ...] = ()
    v_th: float = 0.5
    a_th: float = 0.7
    r_th: float = 0.5
    dt_hold: float = 3.0
    d_allow: float = 2.0
    min_conf: float = 0.35
    window_us: int = 1_000_000
    min_move_m: float = 0.05
    lost_us: int = 3_000_000
    #: Metres from an exit's line within which an object is on neither side.
    margin_m: float = 0.1
    cell: float = 200.0
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def margin(self) -> float:
        """``margin_m`` on the plan; 0 without a scale."""
        return self.margin_m / self.m_per_px if self.m_per_px else 0.0

    def area_m2(self, zone: Zone) -> float | None:
        return None if self.m_per_px is None else area(zone.polygon) * self.m_per_px**2

    def floor_of(self, camera: str) -> str:
        """A camera's floor: ``default`` if it names none, and the first floor
        if that floor is not in the site."""
        known = {c.name: c.floor for c in self.cameras} | dict(self.unmapped)
        floor = known.get(camera) or "default"
        return floor if floor in self.floors else self.floors[0]

    def floor_view(self, floor: str) -> Site:
        """The site with one floor's elements only."""
        own = lambda items: tuple(x for x in items if x.floor == floor)
        cameras = tuple(c for c in self.cameras if self.floor_of(c.name) == floor)
        return replace(
            self, floors=(floor,), zones=own(self.zones), bottlenecks=own(self.bottlenecks), exits=own(self.exits),
            routes=own(self.routes), cameras=cameras,
        )

    def taking_part(self) -> list[str]:
        """Floors with a mapped camera, in the site's order."""
        seen = {self.floor_of(c.name) for c in self.cameras}
        return [f for f in self.floors if f in seen]


def _square(x1, y1, x2, y2):
    return ((x1, y1), (x2, y1), (x2, y2), (x1, y2))


SITE = Site(
    floors=("f0", "f1"),
    zones=(
        Zone("z1", _square(100.0, 100.0, 300.0, 300.0)),
        Zone("z2", _square(200.0, 200.0, 800.0, 700.0)),
        Zone("z3", ((100.0, 600.0), (400.0, 600.0), (250.0, 950.0)), floor="f1"),
    ),
    bottlenecks=(
        Zone("b1", _square(100.0, 100.0, 300.0, 300.0), 0.5, 2.0),
        Zone("b2", _square(450.0, 450.0, 650.0, 650.0), 0.25, 1.0),
        Zone("b3", _square(600.0, 100.0, 900.0, 400.0), 0.125, 1.0, "f1"),
    ),
    exits=(
        Exit("e1", (500.0, 400.0), (500.0, 600.0), (400.0, 500.0), 60),
        Exit("e2", (300.0, 100.0), (300.0, 900.0), (250.0, 500.0), 40),
        Exit("e3", (100.0, 800.0), (900.0, 800.0), (500.0, 700.0), None),
        Exit("e4", (500.0, 200.0), (500.0, 800.0), (400.0, 500.0), 30, "f1"),
        Exit("e5", (200.0, 500.0), (800.0, 500.0), (500.0, 400.0), 70, "f1"),
    ),
    routes=(
        Route("r1", ((100.0, 500.0), (900.0, 500.0))),
        Route("r2", ((200.0, 900.0), (200.0, 200.0), (800.0, 200.0))),
        Route("r3", ((100.0, 300.0), (900.0, 300.0)), "f1"),
    ),
    cameras=(
        Camera("cam0", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), _square(0.0, 0.0, 1000.0, 1000.0)),
        Camera("cam1", (1.0, 0.0, 5.0, 0.0, 1.0, -3.0, 0.0, 0.0, 1.0), _square(50.0, 50.0, 950.0, 950.0), 0.6, "f1"),
        Camera("cam2", (0.9, 0.1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0001, 1.0), ((0.0, 0.0), (1000.0, 0.0), (500.0, 1000.0)), 0.2, "gone"),
    ),
    unmapped=(("cam3", "f1"),),
    origins=((100.0, 500.0), (900.0, 100.0)),
)
