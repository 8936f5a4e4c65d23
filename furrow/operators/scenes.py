"""Label maps, image similarity, anchors and the morphology run."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import hierarchy as H
from . import points as P
from . import traits as T


def composed_labels(pixels: DataFrame) -> DataFrame:
    """(image, px, obj): the label map of objects (image, obj, px, depth) laid down by id.

    Where an object meets what lies there, the nearer of the two by mean depth over those pixels
    keeps them; an object farther away only fills empty pixels.
    """

    def run(group: pa.Table) -> pa.Table:
        obj, px, depth = (group[c].to_numpy() for c in ("obj", "px", "depth"))
        order = np.lexsort((px, obj))
        obj, px, depth = obj[order], px[order], depth[order]
        places, at = np.unique(px, return_inverse=True)
        label, lies = np.full(len(places), -1, np.int64), np.zeros(len(places))
        starts = np.flatnonzero(np.diff(obj, prepend=obj[0] - 1))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(obj)], strict=True):
            o, where, new = obj[start], at[start:end], depth[start:end]
            taken = label[where] >= 0
            if taken.any() and lies[where[taken]].mean() < new[taken].mean():
                where, new = where[~taken], new[~taken]
            label[where], lies[where] = o, new
        return pa.table({"image": pa.array(np.full(len(places), group["image"][0].as_py())), "px": pa.array(places), "obj": pa.array(label)})

    return pixels.groupBy("image").applyInArrow(run, "image long, px long, obj long")


def window_weights(size: int = 11, sigma: float = 1.5) -> list[tuple[int, float]]:
    """(offset, weight) of a Gaussian window that sums to one."""
    g = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [(i - size // 2, v / sum(g)) for i, v in enumerate(g)]


def ssim(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Mean structural similarity of images a and b: image, x, y, a, b. What lies outside is 0.

    The window is a product of two: sums along x, then along y, take 22 rows a pixel and not 121.
    """
    near = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in window_weights()])
    a, b = F.col("a"), F.col("b")
    sums = pixels.select("image", "x", "y", a.alias("ma"), b.alias("mb"), (a * a).alias("aa"), (b * b).alias("bb"), (a * b).alias("ab"))
    for axis, end in (("x", width), ("y", height)):
        spread = sums.withColumn("n", F.explode(near)).withColumn(axis, F.col(axis) + F.col("n.k")).filter(F.col(axis).between(0, end - 1))
        sums = spread.groupBy("image", "x", "y").agg(*[F.sum(F.col("n.w") * F.col(c)).alias(c) for c in ("ma", "mb", "aa", "bb", "ab")])
    ma, mb = F.col("ma"), F.col("mb")
    c1, c2 = 0.01**2, 0.03**2
    top = (2 * ma * mb + c1) * (2 * (F.col("ab") - ma * mb) + c2)
    low = (ma * ma + mb * mb + c1) * (F.col("aa") - ma * ma + F.col("bb") - mb * mb + c2)
    return sums.groupBy("image").agg(F.avg(top / low).alias("ssim"))


def fitted_anchors(sizes: DataFrame, n: int = 9, rounds: int = 15) -> DataFrame:
    """n anchor sizes of (w, h) by Lloyd's rounds on sizes over their deviation, started from quantiles.

    A round is one aggregation; the driver holds n centres.
    """
    spread = sizes.agg(F.stddev_pop("w").alias("w"), F.stddev_pop("h").alias("h")).first()
    sw, sh = (spread[c] or 1.0 for c in "wh")
    at = [(i + 0.5) / n for i in range(n)]
    first = sizes.agg(F.percentile_approx("w", at).alias("w"), F.percentile_approx("h", at).alias("h")).first()
    centres = [(w / sw, h / sh) for w, h in zip(first["w"] or [], first["h"] or [], strict=True)]
    for _ in range(rounds if centres else 0):
        gaps = [(F.col("w") / sw - a) * (F.col("w") / sw - a) + (F.col("h") / sh - b) * (F.col("h") / sh - b) for a, b in centres]
        nearest = F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))) - 1
        means = {r["k"]: (r["w"], r["h"]) for r in sizes.groupBy(nearest.alias("k")).agg((F.avg("w") / sw).alias("w"), (F.avg("h") / sh).alias("h")).collect()}
        new = [means.get(i, c) for i, c in enumerate(centres)]
        if new == centres:
            break
        centres = new
    rows = sorted((a * sw, b * sh) for a, b in centres)
    return sizes.sparkSession.createDataFrame([(i, float(w), float(h)) for i, (w, h) in enumerate(sorted(rows, key=lambda r: r[0] * r[1]))], "anchor long, w double, h double")


#: Chance and strength of a mutation, its bounds, the least side and the ratio of sides that an anchor still fits.
MUTATED, STRENGTH, FACTORS, LEAST_SIDE, FITS = 0.9, 0.1, (0.3, 3.0), 2.0, 0.25


def anchor_fitness(histogram: DataFrame, sets: list[list[tuple[float, float]]]) -> list[float]:
    """Of each set of anchors the mean, over sizes (w, h, n), of how well the best anchor fits, 0 if none does.

    All sets are scored in one aggregation; they come and their scores go as a few numbers.
    """
    grid = F.from_json(F.lit(json.dumps(sets)), "array<array<array<double>>>")
    ratio = lambda a, b: F.least(a / b, b / a)
    best = lambda anchors: F.array_max(F.transform(anchors, lambda a: F.least(ratio(F.col("w"), a[0]), ratio(F.col("h"), a[1]))))
    scored = histogram.select("n", F.posexplode(F.transform(grid, best)).alias("k", "best"))
    kept = F.when(F.col("best") > FITS, F.col("best")).otherwise(0.0)
    found = {r["k"]: r["fit"] for r in scored.groupBy("k").agg((F.sum(kept * F.col("n")) / F.sum("n")).alias("fit")).collect()}
    return [found.get(i) or 0.0 for i in range(len(sets))]


def mutations(anchors: list[tuple[float, float]], children: int, draws: np.random.Generator) -> list[list[tuple[float, float]]]:
    """Sets near a set: each side times a factor that is one now and then."""
    k = np.array(anchors)
    shape = (children, *k.shape)
    factors = np.clip((draws.random(shape) < MUTATED) * draws.random((children, 1, 1)) * draws.normal(size=shape) * STRENGTH + 1, *FACTORS)
    return np.maximum(k * factors, LEAST_SIDE).tolist()


def evolved_anchors(sizes: DataFrame, n: int = 9, generations: int = 16, children: int = 64, seed: int = 0) -> DataFrame:
    """(anchor, w, h, fitness): fitted anchors changed by chance as long as that fits sizes better.

    A generation is a number of mutations of the best set so far, scored at once over the histogram of
    sizes; the best of them takes over if it is better, so that fitness never falls.
    """
    histogram = cut(sizes.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n")))
    best = [(r["w"], r["h"]) for r in fitted_anchors(sizes, n).orderBy("anchor").collect()]
    fit, draws = anchor_fitness(histogram, [best])[0] if best else 0.0, np.random.default_rng(seed)
    for _ in range(generations if best else 0):
        own = mutations(best, children, draws)
        scores = anchor_fitness(histogram, own)
        at = int(np.argmax(scores))
        if scores[at] > fit:
            best, fit = own[at], scores[at]
    rows = sorted(((float(w), float(h)) for w, h in best), key=lambda r: r[0] * r[1])
    return sizes.sparkSession.createDataFrame([(i, w, h, float(fit)) for i, (w, h) in enumerate(rows)], "anchor long, w double, h double, fitness double")


@dataclass(frozen=True)
class Morphology:
    """Settings of a morphology run; values out of range are errors."""

    outlier_k: int = 200
    outlier_ratio: float = 3.0
    epsilon: float = 0.12
    min_samples: int = 4
    clusterer: str = "dbscan"
    min_cluster_size: int = 50
    selection_epsilon: float = 0.0
    distance_percentile: float = 99.0

    def __post_init__(self) -> None:
        if self.outlier_k < 1 or self.min_samples < 1:
            raise ValueError("counts must be positive")
        if self.epsilon <= 0 or self.outlier_ratio <= 0 or not 1 <= self.distance_percentile <= 100:
            raise ValueError("a setting is out of range")
        if self.clusterer not in ("dbscan", "hdbscan") or self.min_cluster_size < 2 or self.selection_epsilon < 0:
            raise ValueError("no such clusterer, or its settings are out of range")


def morphology(points: DataFrame, settings: Morphology = Morphology()) -> DataFrame:
    """Traits of each cloud (file_id, pid, x, y, z) after shifting, cleaning and clustering, from all its points.

    A cloud with a coordinate over 10,000 is moved to its mean and its centroid moved back.
    """
    far = F.max(F.greatest(*[F.abs(c) for c in "xyz"])) > 10_000
    shift = cut(points.groupBy("file_id").agg(*[F.when(far, F.floor(F.avg(c))).otherwise(0.0).alias("s" + c) for c in "xyz"]))
    local = points.join(shift, "file_id").select("file_id", "pid", *[(F.col(c) - F.col("s" + c)).alias(c) for c in "xyz"])
    cleaned = P.without_outliers(local, "file_id", settings.outlier_k, settings.outlier_ratio)
    if settings.clusterer == "dbscan":
        clusters = P.clustered(cleaned, "file_id", settings.epsilon, settings.min_samples)
    else:
        clusters = H.clustered(cleaned, "file_id", settings.min_cluster_size, settings.min_samples, True, settings.selection_epsilon)
    main = P.main_cluster(clusters, "file_id")
    found = T.traits(main.select("file_id", "pid", *"xyz"), "file_id", settings.distance_percentile)
    return found.join(shift, "file_id").select("file_id", *[(F.col(c) + F.col("s" + c)).alias(c) for c in "xyz"], "n", "length", "width", "volume", "inclination", "curvature")
