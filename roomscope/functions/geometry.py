"""Scalar geometry as column expressions (G1 to G11, G15, G18 to G25). A box is six columns with a common prefix."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def col(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}" if prefix else name)


def lo(p: str, k: str) -> Column:
    return col(p, f"l{k}")


def hi(p: str, k: str) -> Column:
    return col(p, f"h{k}")


def mid(p: str, k: str) -> Column:
    return col(p, f"c{k}")


def square(c: Column) -> Column:
    return c * c


def distance(a: str, b: str, axes: tuple[str, ...] = AXES) -> Column:
    """Euclidean distance of centroids."""
    return F.sqrt(sum((square(mid(a, k) - mid(b, k)) for k in axes[1:]), square(mid(a, axes[0]) - mid(b, axes[0]))))


def box_gap(a: str, b: str) -> Column:
    """Distance of two boxes' surfaces; 0 where they touch or overlap."""
    gaps = [F.greatest(F.lit(0.0), lo(a, k) - hi(b, k), lo(b, k) - hi(a, k)) for k in AXES]
    return F.sqrt(square(gaps[0]) + square(gaps[1]) + square(gaps[2]))


def point_plane(x: Column, y: Column, z: Column, s: str) -> Column:
    return col(s, "a") * x + col(s, "b") * y + col(s, "c") * z + col(s, "d")


def corner_distances(e: str, s: str) -> tuple[Column, Column]:
    """Least and greatest signed distance of the eight corners to the plane."""
    all8 = [point_plane(x, y, z, s) for x in (lo(e, "x"), hi(e, "x")) for y in (lo(e, "y"), hi(e, "y")) for z in (lo(e, "z"), hi(e, "z"))]
    return F.least(*all8), F.greatest(*all8)


def box_plane(e: str, s: str) -> Column:
    """Distance of a box to a plane; 0 where it straddles."""
    low, high = corner_distances(e, s)
    return F.when((low <= 0) & (high >= 0), 0.0).when(low > 0, low).otherwise(-high)


def in_plane_gap(e: str, s: str) -> Column:
    """Gap of the box's shadow and an axis-aligned rectangular polygon, within the polygon's plane."""
    normal = {"x": "a", "y": "b", "z": "c"}
    gaps = [F.when(F.abs(col(s, normal[k])) > 0.5, 0.0).otherwise(F.greatest(F.lit(0.0), col(s, f"pl{k}") - hi(e, k), lo(e, k) - col(s, f"ph{k}"))) for k in AXES]
    return F.sqrt(square(gaps[0]) + square(gaps[1]) + square(gaps[2]))


def box_surface(e: str, s: str) -> Column:
    """Distance to the polygon where there is one, else to the plane."""
    plane, gap = box_plane(e, s), in_plane_gap(e, s)
    return F.when(col(s, "plx").isNull(), plane).otherwise(F.sqrt(square(plane) + square(gap)))


def failed(clauses: list[tuple[str, Column]]) -> Column:
    """The names of clauses that do not hold, in their order."""
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in clauses]), lambda x: x.isNotNull())


def rest_clauses(e: str, s: str, contact: float = 0.02, penetration: float = 0.03, tilt: float = 30.0) -> list[tuple[str, Column]]:
    """Standing on a surface whose normal points up (gravity is -z)."""
    low, _ = corner_distances(e, s)
    return [
        ("support_capable", col(s, "c") >= math.cos(math.radians(tilt))),
        ("centroid_on_support_side", point_plane(mid(e, "x"), mid(e, "y"), mid(e, "z"), s) >= 0),
        ("contact", (low <= contact) & (low >= -penetration)),
        ("footprint_ok", in_plane_gap(e, s) <= 0),
    ]


def wall_clauses(e: str, s: str, contact: float = 0.02, penetration: float = 0.02, tilt: float = 30.0) -> list[tuple[str, Column]]:
    low, _ = corner_distances(e, s)
    return [
        ("wall_capable", F.abs(col(s, "c")) <= math.sin(math.radians(tilt))),
        ("on_interior_side", point_plane(mid(e, "x"), mid(e, "y"), mid(e, "z"), s) >= 0),
        ("contact", (low <= contact) & (low >= -penetration)),
        ("footprint_ok", in_plane_gap(e, s) <= 0),
    ]


def volume(p: str) -> Column:
    return (hi(p, "x") - lo(p, "x")) * (hi(p, "y") - lo(p, "y")) * (hi(p, "z") - lo(p, "z"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes; 0 where they are disjoint or flat."""
    parts = [F.greatest(F.lit(0.0), F.least(hi(a, k), hi(b, k)) - F.greatest(lo(a, k), lo(b, k))) for k in AXES]
    both = parts[0] * parts[1] * parts[2]
    whole = volume(a) + volume(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def footprint(p: str) -> Column:
    return (hi(p, "x") - lo(p, "x")) * (hi(p, "y") - lo(p, "y"))


def room_scale_flat(e: str, area: Column, share: float = 0.60, height: float = 0.20) -> Column:
    """A thing nearly as wide as the room and nearly flat (a rug); never where the room's area is unknown."""
    return F.coalesce((footprint(e) / area >= share) & (hi(e, "z") - lo(e, "z") <= height), F.lit(False))


def depth_along_normal(e: str, s: str) -> Column:
    return F.abs(col(s, "a")) * (hi(e, "x") - lo(e, "x")) + F.abs(col(s, "b")) * (hi(e, "y") - lo(e, "y")) + F.abs(col(s, "c")) * (hi(e, "z") - lo(e, "z"))


def point_box(x: Column, y: Column, z: Column, box: str) -> Column:
    """Distance from a point to a box, 0 inside."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{box}.l{k}") - v, v - F.col(f"{box}.h{k}")) for k, v in zip("xyz", (x, y, z), strict=True)]
    return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))


def diagonal(box: str) -> Column:
    return F.sqrt(sum(((F.col(f"{box}.h{k}") - F.col(f"{box}.l{k}")) * (F.col(f"{box}.h{k}") - F.col(f"{box}.l{k}")) for k in "xyz"), F.lit(0.0)))


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def normalize(a: list[Column]) -> list[Column]:
    """Unit vector; the zero vector is an error."""
    n = F.sqrt(dot(a, a))
    return [F.when(n > 0, x / n).otherwise(F.raise_error(F.lit("cannot normalise a zero vector")).cast("double")) for x in a]


def plane_error(n: list[Column], d: Column, m: list[Column], e: Column) -> tuple[Column, Column]:
    """Angle in degrees between two planes, whichever way their normals point, and the difference of their offsets."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(n, m)))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(c)))), F.abs(F.when(c < 0, -d).otherwise(d) - e)


def aligned(p: list[Column], g: list[Column]) -> list[Column]:
    """A point turned so that gravity ``g`` (any length but 0) points down the z axis, by the shortest turn."""
    u = normalize(g)
    # Rodrigues with the axis u x (0, 0, -1): cosine -u_z; opposite directions turn about x.
    ax, ay, c = -u[1], u[0], -u[2]
    k = 1.0 / (1.0 + c)
    turned = [
        (c + ax * ax * k) * p[0] + ax * ay * k * p[1] + ay * p[2], ax * ay * k * p[0] + (c + ay * ay * k) * p[1] - ax * p[2], -ay * p[0] + ax * p[1] + c * p[2],
    ]
    flat = c <= -1.0 + 1e-12
    return [F.when(flat, [p[0], -p[1], -p[2]][i]).otherwise(turned[i]) for i in range(3)]
