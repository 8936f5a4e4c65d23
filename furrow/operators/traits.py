"""The shape traits of point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import shapes as H
from . import splines as L

TRAITS = ("x", "y", "z", "n", "length", "width", "volume", "inclination", "curvature")


def traits(points: DataFrame, by: str, percentile: float = 95.0, smoothing: float = 1.0) -> DataFrame:
    """One row a cloud: centroid, count, spline length, PCA width, hull volume, inclination, curvature.

    Each trait is an aggregation of its own over points in the frame of their cloud's axes.
    """
    found = cut(H.frames(points, by))
    flat = cut(H.local(points, found, by))
    length = L.axis_lengths(flat.select(by, F.col("u1").alias("x"), F.col("u2").alias("y")), by, smoothing)
    out = found.join(length, by).join(H.widths(flat, by, percentile), by).join(H.hull_volumes(points, by), by)
    return out.select(by, *[F.col("centre")[i].alias(c) for i, c in enumerate("xyz")], "n", "length", "width", "volume", H.inclination(F.col("axes")).alias("inclination"), "curvature")
