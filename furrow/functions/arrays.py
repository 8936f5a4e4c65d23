"""Arrays as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def linspace(first: float, last: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + (last - first) * i / (n - 1))


def arg_max(a: Column) -> Column:
    """Place of the first greatest entry, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def interpolated(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear, constant beyond both ends."""
    out = F.when(x <= xs[0], float(ys[0]))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=False), strict=False):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return out.otherwise(float(ys[-1]))


def ema(values: Column, rate: float = 0.4) -> Column:
    """The last value of an exponential moving average that starts at 0."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: rate * x + (1 - rate) * a)


def any_positive(channels: Column) -> Column:
    """Whether a pixel is on: any of its channels is over 0."""
    return F.exists(channels, lambda c: c > 0)


def repeated(row: Column, times: Column) -> Column:
    """An array of a value as often as times says, none for 0."""
    return F.array_repeat(row, times.cast("int"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a Gaussian filter that sums to one, cut at truncate deviations."""
    reach = int(truncate * sigma + 0.5)
    g = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [(k - reach, v / sum(g)) for k, v in enumerate(g)]


def reflected(i: Column, n: Column) -> Column:
    """A place beyond the ends of n values, mirrored at the ends so that the end values repeat."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)
