"""Smoothing splines of many groups of points at once.

A cubic spline is fitted by least squares; while its residual is over the smoothing value, knots are
added where the residual is largest, and then the roughness of the last spline is weighed against its
residual so that this is the smoothing value. All that a fit needs of the points are their moments
between knots, which Spark sums; what is solved for a group has the size of its knots.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, written
from .shapes import percentiles, ranked

#: A residual this near to the smoothing value, as a part of it, is near enough to add no more knots.
NEAR = 1e-3
#: Places of a group that are summed at once.
BLOCK = 8_192
AT = np.array([-1.0, -1 / 3, 1 / 3, 1.0])
POWERS = np.linalg.inv(np.vander(AT, increasing=True))


def bases(t: np.ndarray, x: np.ndarray, span: int | np.ndarray) -> np.ndarray:
    """The four cubic B-splines over knots t that are not zero between t[span] and t[span + 1], at x; span may be an array of the shape of x."""
    out = np.ones((*x.shape, 1))
    for k in range(1, 4):
        grown = np.zeros((*x.shape, k + 1))
        for i in range(k):
            right, left = t[span + 1 + i], t[span + 1 + i - k]
            share = out[..., i] / (right - left)
            grown[..., i] += (right - x) * share
            grown[..., i + 1] += (x - left) * share
        out = grown
    return out


def pieces_of(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(spans that are not empty, the power series of their four bases, one array of four by four each)."""
    spans = np.flatnonzero(t[4:-3] > t[3:-4]) + 3
    a, b = t[spans, None], t[spans + 1, None]
    return spans, POWERS @ bases(t, (a + b) / 2 + (b - a) / 2 * AT, np.repeat(spans[:, None], 4, 1))


def system(t: np.ndarray, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(normal matrix by its diagonals, right side, spans that are not empty, power series of their bases) from the moments of each span.

    Moments are the sums of u^0 to u^6, of u^0 y to u^3 y and of y^2, u going from -1 to 1 in a span.
    Each basis meets three others, so that row k of the diagonals, which holds what stands k below the
    main one, has as many places as there are bases.
    """
    spans, series = pieces_of(t)
    bands, right = np.zeros((5, len(t) - 4)), np.zeros(len(t) - 4)
    m = moments[spans - 3]
    own = series.transpose(0, 2, 1) @ m[:, np.add.outer(range(4), range(4))] @ series
    side = (series.transpose(0, 2, 1) @ m[:, 7:11, None])[:, :, 0]
    for a in range(4):
        right[spans - 3 + a] += side[:, a]
        for b in range(a, 4):
            bands[b - a, spans - 3 + a] += own[:, a, b]
    return bands, right, spans, series


def jumps(t: np.ndarray) -> np.ndarray:
    """For each inner knot the jump of the third derivative there, as a row over the coefficients."""
    n = len(t) - 4
    third = np.zeros((n, len(t) - 1))
    for span in range(3, n):
        a, b = t[span], t[span + 1]
        if b > a:
            third[span - 3 : span + 1, span] = (POWERS @ bases(t, (a + b) / 2 + (b - a) / 2 * AT, span))[3] * 6 / ((b - a) / 2) ** 3
    inner = range(4, n)
    return np.array([third[:, k] - third[:, k - 1] for k in inner]).reshape(len(inner), n)


def roughness(t: np.ndarray) -> np.ndarray:
    """The products of the columns of jumps, by diagonals as in system."""
    n = len(t) - 4
    third = np.zeros((len(t), 4))
    spans, series = pieces_of(t)
    third[spans] = series[:, 3] * 6 / ((t[spans + 1] - t[spans])[:, None] / 2) ** 3
    inner = np.arange(4, n)
    rows = np.zeros((len(inner), 5))  # over the coefficients from inner - 4 to inner
    rows[:, 1:] += third[inner]
    rows[:, :4] -= third[inner - 1]
    bands = np.zeros((5, n))
    for a in range(5):
        for b in range(a, 5):
            bands[b - a, inner - 4 + a] += rows[:, a] * rows[:, b]
    return bands


def solved(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system of five diagonals; what depends on what was solved before it, to the last bits, is 0.

    A step for each unknown goes through its four neighbours, so that time and memory grow with the unknowns.
    """
    n = len(right)
    a0, a1, a2, a3, a4 = ([*row, 0.0, 0.0, 0.0, 0.0] for row in bands.tolist())
    r, least = [*right.tolist(), 0.0, 0.0, 0.0, 0.0], (bands[0] * 1e-13).tolist()
    for j in range(n):
        d = a0[j]
        if d <= least[j]:
            a1[j] = a2[j] = a3[j] = a4[j] = r[j] = 0.0
            continue
        p, q, u, v, z = a1[j], a2[j], a3[j], a4[j], r[j]
        a, b, c, e = p / d, q / d, u / d, v / d
        a0[j + 1] -= a * p
        a1[j + 1] -= a * q
        a2[j + 1] -= a * u
        a3[j + 1] -= a * v
        a0[j + 2] -= b * q
        a1[j + 2] -= b * u
        a2[j + 2] -= b * v
        a0[j + 3] -= c * u
        a1[j + 3] -= c * v
        a0[j + 4] -= e * v
        r[j + 1] -= a * z
        r[j + 2] -= b * z
        r[j + 3] -= c * z
        r[j + 4] -= e * z
        a1[j], a2[j], a3[j], a4[j], r[j] = a, b, c, e, z / d
    for j in range(n - 1, -1, -1):
        r[j] -= a1[j] * r[j + 1] + a2[j] * r[j + 2] + a3[j] * r[j + 3] + a4[j] * r[j + 4]
    return np.array(r[:n])


def product(bands: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A symmetric matrix by its diagonals times a vector."""
    out = bands[0] * c
    for k in range(1, min(len(bands), len(c))):
        out[k:] += bands[k, :-k] * c[:-k]
        out[:-k] += bands[k, :-k] * c[k:]
    return out


def smooth(bands: np.ndarray, right: np.ndarray, squares: float, penalty: np.ndarray, value: float) -> np.ndarray:
    """Coefficients of the spline with the least sum of squared jumps whose residual is value."""
    scale = bands[0].sum() / max(penalty[0].sum(), 1e-300)
    low, high = -40.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        c = solved(bands + scale * np.exp(mid) * penalty, right)
        if mid in (low, high):
            break
        low, high = (mid, high) if squares - 2 * c @ right + c @ product(bands, c) < value else (low, mid)
    return c


def more_knots(ranks: list[int], last: int, residuals: list[float], count: int) -> list[int]:
    """Places of count more knots: each halves the points of the interval with the largest residual, which it shares out."""
    bounds, new = [0, *ranks, last], []
    heap = [(-own, a, b) for own, a, b in zip(residuals, bounds, bounds[1:], strict=False) if b - a > 1]
    heapq.heapify(heap)
    while heap and len(new) < count and heap[0][0] < 0:
        less, a, b = heapq.heappop(heap)
        inside = b - a - 1
        half = inside // 2 + 1
        new.append(a + half)
        for c, d, n in ((a, a + half, half - 1), (a + half, b, inside - half)):
            if n:
                heapq.heappush(heap, (less * n / inside, c, d))
    return new


STATE = "n long, low double, high double, kinds long, ranks array<long>, knots array<double>, ys array<double>, before double, adds long"
STEP = "done boolean, pieces array<array<double>>, found array<long>, next_before double, next_adds long"


def _step(by: str, value: float):
    def run(group: pa.Table, state: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        moments = np.zeros((len(row["knots"]) + 1, 12))
        np.add.at(moments, group["span"].to_numpy(), np.stack(group["m"].to_numpy(zero_copy_only=False)))
        squares = float(moments[:, 11].sum())
        knots, ranks = list(row["knots"]), list(row["ranks"])
        out = {"done": True, "found": [], "next_before": 0.0, "next_adds": 0}
        if row["kinds"] < 4:  # a polynomial through the means
            m, d = moments[0], int(row["kinds"])
            c = np.zeros(4)
            c[:d] = np.linalg.lstsq(m[np.add.outer(range(d), range(d))], m[7 : 7 + d], rcond=None)[0]
            pieces = [[row["low"], row["high"], *c]]
        else:
            t = np.array([row["low"]] * 4 + sorted(knots) + [row["high"]] * 4)
            bands, right, spans, series = system(t, moments)
            c = solved(bands, right)
            own = lambda c: (series @ c[spans[:, None] - 3 + np.arange(4)][:, :, None])[:, :, 0]
            p, m, left = own(c), moments[spans - 3], np.zeros(len(t) - 7)
            left[spans - 3] = m[:, 11] - 2 * (p * m[:, 7:11]).sum(1) + (p[:, None] @ m[:, np.add.outer(range(4), range(4))] @ p[:, :, None])[:, 0, 0]
            residual = float(left.sum())
            pairs = np.array(sorted(zip(knots, row["ys"], strict=True))).reshape(-1, 2)
            at = np.flatnonzero(np.isin(np.arange(4, len(pairs) + 4), spans))  # the point at a knot counts half on either side
            f = np.searchsorted(spans, at + 4)
            a, b = t[at + 4], t[at + 5]
            u = 2 * (pairs[at, 0] - a) / (b - a) - 1
            miss = (((p[f, 3] * u + p[f, 2]) * u + p[f, 1]) * u + p[f, 0] - pairs[at, 1]) ** 2 / 2
            left[at] += miss
            left[at + 1] -= miss
            over, adds = residual - value, row["adds"]
            if over > NEAR * value:
                if adds:
                    fell = row["before"] - residual
                    wanted = int(adds * over / fell) if fell > NEAR * value else adds * 2
                    adds = min(adds * 2, max(wanted, adds // 2, 1))
                found = more_knots(sorted(ranks), row["n"] - 1, left.tolist(), adds or 1)
                out |= {"done": not found, "found": found, "next_before": residual, "next_adds": adds or 1}
            elif over < -NEAR * value and knots:
                c = smooth(bands, right, squares, roughness(t), value)
            pieces = np.column_stack((t[spans], t[spans + 1], own(c))).tolist()
        out["pieces"] = [list(map(float, p)) for p in pieces] if out["done"] else []
        kinds = {"done": pa.bool_(), "pieces": pa.list_(pa.list_(pa.float64())), "found": pa.list_(pa.int64()), "next_before": pa.float64(), "next_adds": pa.int64()}
        return pa.table({by: group[by][:1], **{k: pa.array([out[k]], kind) for k, kind in kinds.items()}})

    return run


def _moments(by: str):
    def run(sites: pa.Table, known: pa.Table) -> pa.Table:
        schema = pa.schema([(by, sites.schema.field(by).type), ("span", pa.int64()), ("m", pa.list_(pa.float64()))])
        if not (sites.num_rows and known.num_rows):  # the group is done
            return schema.empty_table()
        x, n, y, yy = (sites[c].to_numpy() for c in ("x", "n", "y", "yy"))
        t, first = np.array(known["t"][0].as_py()), known["first"][0].as_py()
        span = np.searchsorted(t[1:-1], x, "right")
        a, b = t[span], t[span + 1]
        u = np.where(b > a, (2 * x - a - b) / np.where(b > a, b - a, 1), 0.0)
        sums = [u**k * n for k in range(7)] + [u**k * y for k in range(4)] + [yy]
        spans, at = np.unique(span, return_inverse=True)
        m = np.stack([np.bincount(at, v, len(spans)) for v in sums], 1)
        return pa.Table.from_arrays([pa.array([sites[by][0].as_py()] * len(spans), schema[0].type), pa.array(spans + first), pa.array(m.tolist(), schema[2].type)], schema=schema)

    return run


def smoothed(placed: DataFrame, by: str, value: float) -> DataFrame:
    """(by, pieces) of the smoothing spline of y over x in each group, its residual being value at most; placed is (by, x, y, rank).

    A piece is [from, to, c0, c1, c2, c3]: a cubic in a variable that goes from -1 to 1. Groups of fewer
    than four different x get a polynomial through their means. Rounds end when no group's residual is
    over value, after about twice the logarithm of the knots it takes.
    """
    kind = dict(placed.dtypes)[by]
    sizes = placed.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.least(F.count_distinct("x"), F.lit(4)).cast("long").alias("kinds"))
    sites = placed.groupBy(by, "x").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    sites = cut(sites.select(by, F.floor(F.col("rank") / BLOCK).alias("block"), "x", "n", "y", "yy"))
    blocks = cut(sites.groupBy(by, "block").agg(F.min("x").alias("from"), F.max("x").alias("to")))
    none = F.array().cast("array<double>")
    state, out = cut(sizes.select(by, "n", "low", "high", "kinds", F.array().cast("array<bigint>").alias("ranks"), none.alias("knots"), none.alias("ys"), F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("adds"))), None
    names = [c.split()[0] for c in STATE.split(", ")]
    while True:
        if state.isEmpty():
            return out if out is not None else state.select(by, F.array().cast("array<array<double>>").alias("pieces"))
        # a block of sites gets the knots from the last before it to the first after it, and how many there are before
        t = F.concat(F.array("low"), F.array_sort("knots"), F.array("high"))
        known = blocks.join(state.select(by, t.alias("t")), by).withColumn("first", F.size(F.filter(F.slice("t", F.lit(2), F.size("t") - 2), lambda k: k < F.col("from"))))
        within = F.size(F.filter(F.slice("t", F.col("first") + 2, F.size("t") - F.col("first") - 2), lambda k: k <= F.col("to")))
        known = known.select(F.col(by).alias(by), F.col("block").alias("block"), "first", F.slice("t", F.col("first") + 1, within + 2).alias("t"))
        moments = sites.groupBy(by, "block").cogroup(known.groupBy(by, "block")).applyInArrow(_moments(by), f"{by} {kind}, span long, m array<double>")
        own = state.select(*[F.col(c).alias(c) for c in (by, *names)])
        told = cut(moments.groupBy(by).cogroup(own.groupBy(by)).applyInArrow(_step(by, value), f"{by} {kind}, {STEP}"))
        done = told.filter("done").select(by, "pieces")
        out = done if out is None else out.unionByName(done)
        wanted = told.filter("not done").select(by, F.explode("found").alias("rank"))
        found = wanted.join(placed, [by, "rank"]).groupBy(by).agg(*[F.collect_list(c).alias("new_" + c) for c in ("rank", "x", "y")])
        grown = state.join(told.filter("not done"), by).join(found, by)
        grown = grown.select(by, "n", "low", "high", "kinds", F.concat("ranks", "new_rank").alias("ranks"), F.concat("knots", "new_x").alias("knots"), F.concat("ys", "new_y").alias("ys"), F.col("next_before").alias("before"), F.col("next_adds").alias("adds")).select(by, *names)
        state = written(grown)


def evaluated(pieces: list[list[float]], x: np.ndarray) -> np.ndarray:
    p = np.array(pieces)
    at = np.clip(np.searchsorted(p[:, 0], x, "right") - 1, 0, len(p) - 1)
    a, b = p[at, 0], p[at, 1]
    u = np.where(b > a, (2 * x - a - b) / np.where(b > a, b - a, 1), 0)
    return ((p[at, 5] * u + p[at, 4]) * u + p[at, 3]) * u + p[at, 2]


def axis_lengths(points: DataFrame, by: str, value: float = 1.0, samples: int = 1000, ends: tuple[float, float] = (0.005, 0.995)) -> DataFrame:
    """(by, length, curvature) of the smoothing spline of y over x between two percentiles of x: its length, and that over its chord."""
    kind = dict(points.dtypes)[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ratios = [], []
            for pieces, (low, high) in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.linspace(low, high, samples)
                y = evaluated(pieces, x)
                lengths.append(float(np.hypot(np.diff(x), np.diff(y)).sum()))
                chord = float(np.hypot(x[-1] - x[0], y[-1] - y[0]))
                ratios.append(lengths[-1] / chord if chord else float("nan"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.float64()), pa.array(ratios, pa.float64())], names=[by, "length", "curvature"])

    placed = cut(ranked(points.select(by, "x", "y"), [by], F.col("x"), F.col("y")))
    found = smoothed(placed, by, value).join(percentiles(placed, [by], "x", ends, placed), by)
    return found.select(by, "pieces", "p").mapInArrow(run, f"{by} {kind}, length double, curvature double")

