"""3-D geometry as column expressions: rotations, cameras, Gaussians, colours."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def let(values: Vec, names: Sequence[str], f) -> Column:
    """A struct of what f makes of the values, each evaluated once.

    Plans that merge projections would otherwise repeat the values' expressions at every use.
    """
    given = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(values)])
    return F.transform(F.array(given), lambda v: F.struct(*[c.alias(n) for n, c in zip(names, f([v[f"v{i}"] for i in range(len(values))]), strict=True)]))[0]


def unit(q: Vec) -> tuple[Column, ...]:
    """A quaternion over its length; one of length 0 stays 0, which rotation() takes for none."""
    n = F.greatest(F.sqrt(sum((c * c for c in q), F.lit(0.0))), F.lit(1e-12))
    return tuple(c / n for c in q)


def rotation(q: Vec) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion(m: Sequence[Sequence[Column]]) -> tuple[Column, ...]:
    """Quaternion with w >= 0 of a rotation matrix, from its largest component."""
    t = [1 + m[0][0] + m[1][1] + m[2][2], 1 + m[0][0] - m[1][1] - m[2][2], 1 - m[0][0] + m[1][1] - m[2][2], 1 - m[0][0] - m[1][1] + m[2][2]]
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[1][0] + m[0][1], m[0][2] + m[2][0], m[2][1] + m[1][2]
    rows = [(t[0], a, b, c), (a, t[1], d, e), (b, d, t[2], f), (c, e, f, t[3])]
    top = F.greatest(*t)
    picks = []
    for k in range(4):
        value = F.when(t[0] == top, rows[0][k])
        for i in (1, 2, 3):
            value = value.when(t[i] == top, rows[i][k])
        picks.append(value)
    n = F.sqrt(sum((p * p for p in picks), F.lit(0.0)))
    sign = F.when(picks[0] < 0, -1.0).otherwise(1.0)
    return tuple(p / n * sign for p in picks)


def apply(m: Sequence[Sequence[Column]], v: Vec) -> tuple[Column, ...]:
    return tuple(sum((a * b for a, b in zip(row, v, strict=True)), F.lit(0.0)) for row in m)


def camera_centre(m: Sequence[Sequence[Column]], t: Vec) -> tuple[Column, ...]:
    """Position of a camera whose world-to-view transform is (m, t): minus the transpose of m times t."""
    return tuple(-(m[0][i] * t[0] + m[1][i] * t[1] + m[2][i] * t[2]) for i in range(3))


def shifted_centre(m: Sequence[Sequence[Column]], t: Vec, shift: Sequence[float], scale: float) -> tuple[Column, ...]:
    """The centre of a camera in a world that is moved and then scaled."""
    return tuple((c + float(d)) * float(scale) for c, d in zip(camera_centre(m, t), shift, strict=True))


def projected(matrix: Sequence[Sequence[float]], v: Vec) -> tuple[Column, ...]:
    """Homogeneous transform and division by w + 1e-7."""
    x, y, z, w = (row[0] * v[0] + row[1] * v[1] + row[2] * v[2] + row[3] for row in matrix)
    return x / (w + 1e-7), y / (w + 1e-7), z / (w + 1e-7)


def projection_matrix(near: float, far: float, fov_x: float, fov_y: float) -> list[list[float]]:
    return [[1 / math.tan(fov_x / 2), 0, 0, 0], [0, 1 / math.tan(fov_y / 2), 0, 0], [0, 0, far / (far - near), -far * near / (far - near)], [0, 0, 1, 0]]


def focal_of_fov(fov: Column, pixels: float) -> Column:
    return F.lit(float(pixels)) / (2 * F.tan(fov / 2))


def fov_of_focal(focal: Column, pixels: float) -> Column:
    return 2 * F.atan(F.lit(float(pixels)) / (2 * focal))


def ndc_to_pixel(v: Column, size: float) -> Column:
    return ((v + 1.0) * size - 1.0) * 0.5


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(x: Column) -> Column:
    return F.ln(x / (1 - x))


def covariance(scale: Vec, m: Sequence[Sequence[Column]]) -> tuple[Column, ...]:
    """xx, xy, xz, yy, yz, zz of (R S)(R S)^T for the rotation m."""
    rs = [[m[i][k] * scale[k] for k in range(3)] for i in range(3)]
    return tuple(sum((rs[i][k] * rs[j][k] for k in range(3)), F.lit(0.0)) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))


def covariance_2d(view: Vec, cov: Vec, focal: float, tan_fov: float) -> tuple[Column, ...]:
    """a, b, c of the screen covariance of a Gaussian at a place in view space; a view that does not turn."""
    x, y, z = view
    limit = 1.3 * tan_fov
    tx, ty = (F.greatest(F.lit(-limit), F.least(F.lit(limit), v / z)) * z for v in (x, y))
    j = [[F.lit(focal) / z, F.lit(0.0), -(focal * tx) / (z * z)], [F.lit(0.0), F.lit(focal) / z, -(focal * ty) / (z * z)]]
    s = [[cov[0], cov[1], cov[2]], [cov[1], cov[3], cov[4]], [cov[2], cov[4], cov[5]]]
    half = [apply(s, row) for row in j]
    at = lambda i, k: sum((half[i][n] * j[k][n] for n in range(3)), F.lit(0.0))
    return at(0, 0) + 0.3, at(0, 1), at(1, 1) + 0.3


def conic(a: Column, b: Column, c: Column) -> tuple[Column, ...]:
    """Inverse covariance and the radius in pixels of three deviations; null where it has no inverse."""
    det = a * c - b * b
    ok = F.when(det != 0, det)
    mid = (a + c) * 0.5
    root = F.sqrt(F.greatest(F.lit(0.1), mid * mid - det))
    return c / ok, -b / ok, a / ok, F.ceil(3 * F.sqrt(F.greatest(mid + root, mid - root)) + ok * 0)


# The shifts and masks that put two free bits after each bit of ten.
MORTON_STEPS = ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249))


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three coordinates of ten bits."""

    def spread(v: Column) -> Column:
        for shift, mask in MORTON_STEPS:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


# Fixed value: the golden ratio as far as it is used.
GOLDEN = 1.6180339887


def id_colour(i: Column) -> tuple[Column, ...]:
    """A colour from an id: hue by the golden ratio, saturation by parity, black for 0."""
    hue = i * GOLDEN - F.floor(i * GOLDEN)
    s = 0.5 + 0.5 * (i % 2)
    chroma = s  # at lightness a half
    h6 = hue * 6
    x = chroma * (1 - F.abs(h6 % 2 - 1))
    low = 0.5 - chroma / 2
    sector = F.floor(h6).cast("int")
    table = {"r": (chroma, x, 0, 0, x, chroma), "g": (x, chroma, chroma, x, 0, 0), "b": (0, 0, x, chroma, chroma, x)}
    out = []
    for k in "rgb":
        value = F.when(i == 0, F.lit(0.0))
        for n, v in enumerate(table[k]):
            value = value.when(sector == n, v + low if isinstance(v, Column) else low + 0.0)
        out.append(F.floor(value.otherwise(F.lit(0.0)) * 255).cast("long"))
    return tuple(out)


def legendre(degree: int, order: int, z: Column) -> Column:
    """The associated Legendre polynomial of z over (1 - z^2)^(order / 2), by the recurrence in the degree."""
    below, now = F.lit(0.0), F.lit(float(math.prod(range(1, 2 * order, 2))))
    for n in range(order + 1, degree + 1):
        below, now = now, (z * float(2 * n - 1) * now - float(n + order - 1) * below) / float(n - order)
    return now


def harmonic(degree: int, order: int, d: Vec) -> Column:
    """A real spherical harmonic in a unit direction, with the sign (-1)^order."""
    x, y, z = d
    m = abs(order)
    scale = math.sqrt((2 * degree + 1) / (4 * math.pi) * math.factorial(degree - m) / math.factorial(degree + m)) * (math.sqrt(2) if m else 1) * (-1) ** m
    real, imaginary = F.lit(1.0), F.lit(0.0)  # of (x + iy)^m
    for _ in range(m):
        real, imaginary = real * x - imaginary * y, real * y + imaginary * x
    return scale * legendre(degree, m, z) * (imaginary if order < 0 else real)


def harmonics(c: Vec, d: Vec, degree: int = 2) -> Column:
    """Colour in a unit direction from (degree + 1)^2 coefficients, by degree and order, half added, not under 0."""
    basis = [harmonic(n, m, d) for n in range(degree + 1) for m in range(-n, n + 1)]
    return F.greatest(sum((a * b for a, b in zip(c, basis, strict=True)), F.lit(0.0)) + 0.5, F.lit(0.0))


def exponential_rate(step: Column, first: float, last: float, delay_steps: int, delay_mult: float, steps: int) -> Column:
    """Log-linear from first to last, slower at the start by a quarter of a sine."""
    t = F.least(F.greatest(step / float(steps), F.lit(0.0)), F.lit(1.0))
    value = F.exp(math.log(first) * (1 - t) + math.log(last) * t)
    if delay_steps:
        value = value * (delay_mult + (1 - delay_mult) * F.sin(0.5 * math.pi * F.least(F.greatest(step / float(delay_steps), F.lit(0.0)), F.lit(1.0))))
    return value


def oriented_corners(centre: Vec, extent: Vec, m: Sequence[Sequence[Column]]) -> list[tuple[Column, ...]]:
    """Eight corners of an oriented box whose axes are the columns of m, x fastest."""
    out = []
    for sz in (-1, 1):
        for sy in (-1, 1):
            for sx in (-1, 1):
                h = (extent[0] * (0.5 * sx), extent[1] * (0.5 * sy), extent[2] * (0.5 * sz))
                out.append(tuple(centre[i] + m[i][0] * h[0] + m[i][1] * h[1] + m[i][2] * h[2] for i in range(3)))
    return out


def slerp(a: Vec, b: Vec, t: Column) -> tuple[Column, ...]:
    """Between two unit quaternions along the shorter arc."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    near = F.sin(angle) < 1e-6
    wa = F.when(near, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * angle), F.sin(angle)))
    wb = F.when(near, t).otherwise(F.try_divide(F.sin(t * angle), F.sin(angle))) * sign
    return tuple(wa * x + wb * y for x, y in zip(a, b, strict=True))
