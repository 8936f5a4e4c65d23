"""Shapes of point clouds as aggregates: axes, boxes, percentiles, hulls."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

XYZ = ("x", "y", "z")
#: Sweeps of rotations after which a symmetric 3 by 3 matrix is diagonal to the last bit.
SWEEPS = 8
#: Points of a cloud from which hulls are taken at once.
CHUNK = 20_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _times(a: Column, b: Column) -> Column:
    """The product of two 3 by 3 matrices as arrays of nine, row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: sum((F.get(a, i - i % 3 + k) * F.get(b, i % 3 + 3 * k) for k in range(1, 3)), F.get(a, i - i % 3) * F.get(b, i % 3)))


def eigen(matrix: Column) -> Column:
    """(values, axes) of a symmetric 3 by 3 matrix, an array of nine: by falling value, each axis a row that points to its largest component.

    Rotations that clear one place off the diagonal each, in turn.
    """
    start = F.struct(matrix.alias("a"), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("v"))
    turns = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in ((0, 1), (0, 2), (1, 2))] * SWEEPS)

    def turned(state: Column, turn: Column) -> Column:
        p, q = turn["p"], turn["q"]
        at = lambda i, j: F.get(state["a"], 3 * i + j)
        theta = (at(q, q) - at(p, p)) / (2 * at(p, q))
        t = F.when(at(p, q) == 0, 0.0).otherwise(_let(theta, lambda x: F.when(x < 0, -1.0).otherwise(1.0) / (F.abs(x) + F.sqrt(x * x + 1))))

        def rotated(t: Column) -> Column:
            c = 1 / F.sqrt(t * t + 1)
            j = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.when((i == 4 * p) | (i == 4 * q), c).when(i == 3 * p + q, t * c).when(i == 3 * q + p, -t * c).when(i % 4 == 0, 1.0).otherwise(0.0))
            back = lambda j: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.get(j, 3 * (i % 3) + F.floor(i / 3).cast("int")))
            return _let(j, lambda j: _let(_times(back(j), state["a"]), lambda left: F.struct(_times(left, j).alias("a"), _times(state["v"], j).alias("v"))))

        return _let(t, rotated)

    def sorted_axes(state: Column) -> Column:
        axis = lambda k: F.array(*[state["v"][3 * i + k] for i in range(3)])
        pairs = F.array_sort(F.array(*[F.struct((-state["a"][4 * k]).alias("less"), axis(k).alias("axis")) for k in range(3)]))
        long = lambda v: F.array_max(F.transform(v, lambda x, i: F.struct(F.abs(x).alias("size"), (-i).alias("i"), x.alias("x"))))["x"]
        faced = F.transform(pairs, lambda s: _let(F.when(long(s["axis"]) < 0, -1.0).otherwise(1.0), lambda g: F.transform(s["axis"], lambda x: x * g)))
        return F.struct(F.transform(pairs, lambda s: -s["less"]).alias("values"), F.flatten(faced).alias("axes"))

    return _let(F.aggregate(turns, start, turned), sorted_axes)


def frames(points: DataFrame, by: str) -> DataFrame:
    """(by, n, centre, values, axes): count, centroid and principal axes of each cloud, from sums."""
    c = [F.col(a) for a in XYZ]
    cov = [F.coalesce(F.covar_samp(c[min(i, j)], c[max(i, j)]), F.lit(0.0)) for i in range(3) for j in range(3)]
    sums = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.avg, c)).alias("centre"), F.array(*cov).alias("cov"))
    return sums.withColumn("e", eigen(F.col("cov"))).select(by, "n", "centre", "e.values", "e.axes")


def local(points: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """points with their coordinates u1, u2, u3 along the axes of their cloud, from its centroid."""
    u = [sum(((F.col(a) - F.col("centre")[i]) * F.col("axes")[3 * k + i] for i, a in enumerate(XYZ)), F.lit(0.0)).alias(f"u{k + 1}") for k in range(3)]
    return points.join(found.select(by, "centre", "axes"), by).select(by, *XYZ, *u)


def oriented_boxes(points: DataFrame, by: str) -> DataFrame:
    """Box of each cloud along its principal axes: centre, extent, axes (rows).

    Sums give the axes, and the least and greatest coordinates along them the box.
    """
    found = cut(frames(points, by))
    ends = local(points, found, by).groupBy(by).agg(*[f(f"u{k}").alias(f"{n}{k}") for n, f in (("a", F.min), ("b", F.max)) for k in (1, 2, 3)])
    mid = [F.col("centre")[i] + sum(((F.col(f"a{k + 1}") + F.col(f"b{k + 1}")) / 2 * F.col("axes")[3 * k + i] for k in range(3)), F.lit(0.0)) for i in range(3)]
    return found.join(ends, by).select(by, F.array(*mid).alias("center"), F.array(*[F.col(f"b{k}") - F.col(f"a{k}") for k in (1, 2, 3)]).alias("extent"), "axes")


def ranked(rows: DataFrame, by: Sequence[str], *order: Column, name: str = "rank") -> DataFrame:
    """rows with their place from 0 in an order within by.

    Rows are dealt to ranges of by and order; places are counted in each and start from the counts
    of the ranges before, so that no task holds a whole group.
    """
    dealt = cut(rows.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(dealt.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("rows")).select(*by, "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first")))
    own = F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(starts, [*by, "part"]).withColumn(name, (F.col("own") + F.col("first")).cast("long")).drop("own", "first", "part")


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], placed: DataFrame | None = None) -> DataFrame:
    """(by, p): exact percentiles of a column within by, linear between the two places around, as an array in the order of shares.

    placed, if given, is rows as ranked by that column first.
    """
    placed = ranked(rows.select(*by, value), by, F.col(value)) if placed is None else placed
    last = placed.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("last"))
    wanted = last.withColumn("w", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * F.col("last")).alias("at")) for i, s in enumerate(shares)])))
    ends = wanted.select(*by, "w.i", "w.at", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("rank"))
    met = ends.join(placed, [*by, "rank"]).groupBy(*by, "i").agg((F.min(value) + (F.max(value) - F.min(value)) * (F.first("at") - F.min("rank"))).alias("p"))
    return met.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("p"))


def hull(p: np.ndarray) -> np.ndarray:
    """Triangles of the convex hull of distinct points, as rows of three places, seen from outside; none of flat clouds.

    Starts from four points that are far apart. Each triangle holds the points outside it; the
    farthest of one becomes a corner, all triangles that it sees make way for those from their rim to
    it, and their points go to the new ones. So a step goes through faces and points as arrays, and
    there are as many steps as corners.
    """
    none = np.zeros((0, 3), np.int64)
    if len(p) < 4:
        return none
    a = int(p[:, 0].argmin())
    b = int(((p - p[a]) ** 2).sum(1).argmax())
    c = int((np.cross(p - p[a], p[b] - p[a]) ** 2).sum(1).argmax())
    side = (p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.abs(side).argmax())
    size = float(np.abs(p - p.mean(0)).max())
    if abs(side[d]) <= 1e-12 * max(size, 1e-300) ** 3:
        return none
    inside, near = p[[a, b, c, d]].mean(0), 1e-12 * size**3

    def made(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        normal = np.cross(p[corners[:, 1]] - p[corners[:, 0]], p[corners[:, 2]] - p[corners[:, 0]])
        turned = ((p[corners[:, 0]] - inside) * normal).sum(1) < 0
        corners = np.where(turned[:, None], corners[:, [0, 2, 1]], corners)
        normal = np.where(turned[:, None], -normal, normal)
        return corners, normal, (normal * p[corners[:, 0]]).sum(1)

    faces, normal, level = made(np.array([[a, b, c], [a, b, d], [a, c, d], [b, c, d]]))
    live = np.ones(4, bool)
    owner = np.full(len(p), -1)

    def given(points: np.ndarray, first: int) -> None:
        """Gives points to the new face, from first on, that they are farthest outside of."""
        for i in range(0, len(points), 4096):
            some = points[i : i + 4096]
            out = p[some] @ normal[first:].T - level[first:]
            best = out.argmax(1)
            owner[some] = np.where(out[np.arange(len(some)), best] > near, best + first, -1)

    given(np.setdiff1d(np.arange(len(p)), [a, b, c, d]), 0)
    left = np.flatnonzero(owner >= 0)
    while len(left):
        f = owner[left[0]]
        own = left[owner[left] == f]
        top = int(own[(p[own] @ normal[f]).argmax()])
        seen = live & (normal @ p[top] - level > near)
        seen[f] = True
        edges = faces[seen][:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)
        code = edges[:, 0] * len(p) + edges[:, 1]
        rim = edges[~np.isin(code, edges[:, 1] * len(p) + edges[:, 0])]
        live[seen] = False
        new = made(np.column_stack((rim, np.full(len(rim), top))))
        first = len(faces)
        faces, normal, level = (np.concatenate(x) for x in zip((faces, normal, level), new, strict=True))
        live = np.concatenate((live, np.ones(len(rim), bool)))
        moved = left[seen[owner[left]]]
        owner[top] = -1
        given(moved[moved != top], first)
        left = left[owner[left] >= 0]
        if len(faces) > 64 and live.sum() * 2 < len(faces):  # faces that are gone are forgotten
            at = np.cumsum(live) - 1
            owner[left] = at[owner[left]]
            faces, normal, level, live = faces[live], normal[live], level[live], live[live]
    return faces[live]


def volume(p: np.ndarray) -> float:
    """Volume of the convex hull, 0 of flat clouds."""
    p = np.unique(p, axis=0)
    faces = hull(p)
    if not len(faces):
        return 0.0
    inside = p.mean(0)
    a, b, c = (p[faces[:, i]] - inside for i in range(3))
    return float(np.abs((a * np.cross(b, c)).sum()) / 6)


def corners(p: np.ndarray) -> np.ndarray:
    """The points that span the hull; of flat clouds, which may be part of a cloud that is not, all."""
    p = np.unique(p, axis=0)
    faces = hull(p)
    return p[np.unique(faces)] if len(faces) else p


def hull_volumes(points: DataFrame, by: str, chunk: int = CHUNK) -> DataFrame:
    """(by, volume) of the convex hull of each cloud.

    Hulls merge: a cloud's hull is that of the corners of its parts' hulls. Batches are brought down to
    their corners where they are read, the rest is dealt to chunks and brought down again as
    long as that helps, and only then a cloud's corners meet.
    """
    kind = dict(points.dtypes)[by]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode()
            keys, at = code.dictionary, code.indices.to_numpy(zero_copy_only=False)
            xyz = np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)], 1)
            order = np.argsort(at, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                kept = corners(xyz[own])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.full(len(kept), at[own[0]]))), *(pa.array(kept[:, i]) for i in range(3))], names=[by, *XYZ])

    def whole(group: pa.Table) -> pa.Table:
        kept = corners(np.stack([group[c].to_numpy() for c in XYZ], 1))
        return pa.table({by: pa.array([group[by][0].as_py()] * len(kept), group.schema.field(by).type), **{c: pa.array(kept[:, i]) for i, c in enumerate(XYZ)}})

    def done(group: pa.Table) -> pa.Table:
        return pa.table({by: group[by][:1], "volume": pa.array([volume(np.stack([group[c].to_numpy() for c in XYZ], 1))])})

    schema = f"{by} {kind}, x double, y double, z double"
    kept = cut(points.select(by, *[F.col(c).cast("double").alias(c) for c in XYZ]).mapInArrow(part, schema))
    most = kept.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    while most > chunk:
        kept = cut(kept.withColumn("c", F.pmod(F.xxhash64(*XYZ), F.lit(-(-most // chunk)))).groupBy(by, "c").applyInArrow(lambda g: whole(g.drop(["c"])), schema))
        before, most = most, kept.groupBy(by).count().agg(F.max("count")).first()[0]
        if most > 0.9 * before:  # nearly all points are corners
            break
    return kept.groupBy(by).applyInArrow(done, f"{by} {kind}, volume double")


def inclination(axes: Column) -> Column:
    """Degrees between the first axis and the vertical."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), axes[2]))))


def widths(flat: DataFrame, by: str, percentile: float = 95.0) -> DataFrame:
    """(by, width): twice a percentile of the distance from the plane of the first two axes."""
    return percentiles(flat.select(by, F.abs("u3").alias("off")), [by], "off", [percentile / 100]).select(by, (2 * F.col("p")[0]).alias("width"))
