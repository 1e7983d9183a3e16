"""General planar polygons (G12 to G17): Arrow-batched functions over arrays of 2-D points, for surfaces that are not axis-aligned.

Each works on whole columns in NumPy; one polygon has a handful of corners.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without collinear corners."""
    pts = np.unique(np.asarray(points, dtype=float), axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in seq:
            while len(out) > 1 and _turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def inside(point: np.ndarray, polygon: np.ndarray) -> bool:
    """Whether a point is in a polygon of any shape; its edge belongs to it."""
    a, b = np.asarray(polygon, dtype=float), np.roll(np.asarray(polygon, dtype=float), -1, axis=0)
    if _gaps(np.asarray(point, dtype=float)[None, :], a, b).min() <= 1e-12:
        return True
    x, y = point
    over = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((over & (x < at)).sum() % 2)


def _gaps(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points to segments a-b."""
    d = b - a
    n = np.maximum((d * d).sum(axis=1), 1e-300)
    t = np.clip(((points[:, None, :] - a[None, :, :]) * d[None, :, :]).sum(axis=2) / n[None, :], 0, 1)
    return np.sqrt((((a[None, :, :] + t[:, :, None] * d[None, :, :]) - points[:, None, :]) ** 2).sum(axis=2))


def segments_meet(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> bool:
    """Whether segments p-q and r-s cross or touch."""
    a, b, c, d = _turn(p, q, r), _turn(p, q, s), _turn(r, s, p), _turn(r, s, q)
    if a * b < 0 and c * d < 0:
        return True
    return bool(min(_gaps(np.array([p, q]), np.array([r]), np.array([s])).min(), _gaps(np.array([r, s]), np.array([p]), np.array([q])).min()) <= 1e-12)


def polygon_gap(one: np.ndarray, other: np.ndarray) -> float:
    """Distance of two polygons in their plane; 0 where they overlap or touch."""
    one, other = np.asarray(one, dtype=float), np.asarray(other, dtype=float)
    if inside(one[0], other) or inside(other[0], one):
        return 0.0
    n, m = np.roll(one, -1, axis=0), np.roll(other, -1, axis=0)
    if any(segments_meet(one[i], n[i], other[j], m[j]) for i in range(len(one)) for j in range(len(other))):
        return 0.0
    return float(min(_gaps(one, other, m).min(), _gaps(other, one, n).min()))


def area(polygon: np.ndarray) -> float:
    p = np.asarray(polygon, dtype=float)
    q = np.roll(p, -1, axis=0)
    return float(abs((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum()) / 2)


def plane_basis(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two axes within a plane: from the world axis least along the normal, ties x, y, z."""
    n = np.asarray(n, dtype=float)
    t = np.zeros(3)
    t[int(np.argmin(np.abs(n)))] = 1.0
    u = np.cross(n, t)
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def box_polygon_gap(lo: np.ndarray, hi: np.ndarray, normal: np.ndarray, polygon: np.ndarray) -> float:
    """In-plane gap of a box's shadow and a polygon of 3-D points."""
    u, v = plane_basis(normal)
    corners = np.array([[x, y, z] for x in (lo[0], hi[0]) for y in (lo[1], hi[1]) for z in (lo[2], hi[2])])
    flat = np.stack((u, v))
    return polygon_gap(hull(corners @ flat.T), np.asarray(polygon, dtype=float) @ flat.T)


@F.pandas_udf(T.DoubleType())
def in_plane_gap_general(lo: pd.Series, hi: pd.Series, normal: pd.Series, polygon: pd.Series) -> pd.Series:
    """Column form of box_polygon_gap over arrays; null polygons give null."""
    return pd.Series([None if p is None else box_polygon_gap(a, b, n, np.array([list(x) for x in p])) for a, b, n, p in zip(lo, hi, normal, polygon, strict=True)], dtype="float64")
