"""Convex polygons as arrays of points (x, y) in order, either way round.

Pairs of polygons are worked out by numpy for a batch at once: as nested expressions each of their corners
would be an object that the JVM makes and interprets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Corners of polygons, a row each, filled up with zeros: x, y and their number.
Corners = tuple[np.ndarray, np.ndarray, np.ndarray]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(x1: Column, y1: Column, x2: Column, y2: Column, cos: Column, sin: Column) -> Column:
    """The corners of a box turned about its centre."""
    cx, cy, w, h = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / 2, (y2 - y1) / 2
    return F.array(*[point(cx + cos * (i * w) - sin * (j * h), cy + sin * (i * w) + cos * (j * h)) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def quads(box: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> Corners:
    """The corners of quad for many boxes, rows x1 to y2 of an array."""
    cx, cy, w, h = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, (box[2] - box[0]) / 2, (box[3] - box[1]) / 2
    corners = [(cx + cos * (i * w) - sin * (j * h), cy + sin * (i * w) + cos * (j * h)) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    x, y = (np.stack(c, 1) for c in zip(*corners, strict=True))
    return x, y, np.full(len(cx), 4)


def edges(p: Column) -> Column:
    """(a, b) of each side, the last back to the first point."""
    return F.transform(p, lambda a, i: F.struct(a.alias("a"), F.get(p, (i + 1) % F.size(p)).alias("b")))


def signed_area(p: Column) -> Column:
    return F.aggregate(edges(p), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def area(p: Column) -> Column:
    return F.abs(signed_area(p))


def _corners(p: pa.Array) -> Corners:
    """The corners of polygons."""
    n = np.asarray(pc.fill_null(pc.list_value_length(p), 0))
    at, flat = np.arange(n.max(initial=0)) < n[:, None], p.flatten()
    x, y = np.zeros(at.shape), np.zeros(at.shape)
    x[at], y[at] = (np.asarray(flat.field(c)) for c in "xy")
    return x, y, n


def _next(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What follows each corner, the first after the last."""
    k = np.arange(v.shape[1]) + 1
    return np.take_along_axis(v, np.where(k < n[:, None], k, 0), 1)


def _signed_areas(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    part, sums = (x * _next(y, n) - _next(x, n) * y) / 2, np.zeros(len(n))
    for k in range(x.shape[1]):  # in order, as an aggregate in the JVM adds them
        sums += np.where(k < n, part[:, k], 0.0)
    return sums


def _clipped(x: np.ndarray, y: np.ndarray, n: np.ndarray, qx: np.ndarray, qy: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of each polygon lies inside another: for each side of that the half plane that it is in, corners inside kept and sides that cross it cut."""
    sign, nx, ny = np.where(_signed_areas(qx, qy, m) < 0, -1.0, 1.0)[:, None], _next(qx, m), _next(qy, m)
    for j in range(qx.shape[1]):
        ax, ay, bx, by = (v[:, j, None] for v in (qx, qy, nx, ny))
        own, side = np.arange(x.shape[1]) < n[:, None], (j < m)[:, None]
        d = sign * ((bx - ax) * (y - ay) - (by - ay) * (x - ax))
        e, ex, ey = _next(d, n), _next(x, n), _next(y, n)
        cross = own & side & ((d >= 0) != (e >= 0))
        t = d / np.where(cross, d - e, 1.0)
        kept = np.stack([own & ((d >= 0) | ~side), cross], 2).reshape(len(n), 2 * x.shape[1])
        cut = [np.stack([v, v + t * (w - v)], 2).reshape(kept.shape) for v, w in ((x, ex), (y, ey))]
        n = kept.sum(1)
        at = np.arange(n.max(initial=0)) < n[:, None]
        x, y = np.zeros(at.shape), np.zeros(at.shape)
        x[at], y[at] = (c[kept] for c in cut)
    return x, y, n


def shared(p: Corners, q: Corners) -> np.ndarray:
    """Area that each polygon shares with another, from their corners as (x, y, number)."""
    (x, y, n), (qx, qy, m) = p, q
    low, high = (lambda v, k, f=f, z=z: f(np.where(np.arange(v.shape[1]) < k[:, None], v, z), axis=1, initial=z) for f, z in ((np.min, np.inf), (np.max, -np.inf)))
    meet = (n > 0) & (m > 0) & (low(x, n) <= high(qx, m)) & (low(qx, m) <= high(x, n)) & (low(y, n) <= high(qy, m)) & (low(qy, m) <= high(y, n))
    out = np.zeros(len(n))
    out[meet] = np.abs(_signed_areas(*_clipped(*(v[meet] for v in (x, y, n, qx, qy, m)))))
    return out


@F.arrow_udf(DoubleType())
def _overlap(p: pa.Array, q: pa.Array) -> pa.Array:
    return pa.array(shared(_corners(p), _corners(q)))


def _least_squares(x: np.ndarray, y: np.ndarray, n: np.ndarray, qx: np.ndarray, qy: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least squared distance of any corner of a polygon from any side of another."""
    least, own = np.full(len(n), np.inf), np.arange(x.shape[1]) < n[:, None]
    nx, ny = _next(qx, m), _next(qy, m)
    for j in range(qx.shape[1]):
        ax, ay, bx, by = (v[:, j, None] for v in (qx, qy, nx, ny))
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = np.where(size > 0, np.maximum(0.0, np.fmin(1.0, ((x - ax) * dx + (y - ay) * dy) / np.where(size > 0, size, 1.0))), 0.0)
        px, py = ax + t * dx - x, ay + t * dy - y
        least = np.fmin(least, np.where(own & (j < m)[:, None], px * px + py * py, np.inf).min(axis=1, initial=np.inf))
    return least


def apart(p: Corners, q: Corners) -> np.ndarray:
    """Distance of each polygon from another that it shares no area with, from their corners."""
    return np.sqrt(np.fmin(_least_squares(*p, *q), _least_squares(*q, *p)))


@F.arrow_udf(DoubleType())
def _distance(p: pa.Array, q: pa.Array) -> pa.Array:
    a, b = _corners(p), _corners(q)
    return pa.array(apart(a, b), mask=(a[2] == 0) | (b[2] == 0))


def overlap(p: Column, q: Column) -> Column:
    """Area that two convex polygons share."""
    return _overlap(p, q)


def distance(p: Column, q: Column) -> Column:
    """Distance of two convex polygons that share no area: the least of any corner of one from any side of the other."""
    return _distance(p, q)


def bounds(p: Column) -> tuple[Column, Column, Column, Column]:
    of = lambda f, c: f(F.transform(p, lambda v: v[c]))
    return of(F.array_min, "x"), of(F.array_min, "y"), of(F.array_max, "x"), of(F.array_max, "y")
