"""Detections as results are read, put together from several models or views, and points made denser."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B

CENTRE = ("xc", "yc", "w", "h")
CORNERS = ("x1", "y1", "x2", "y2")


class Results:
    """Detections (image, corners, conf, cls and more) with class names and image size, in several forms."""

    def __init__(self, detections: DataFrame, names: Sequence[str], width: float, height: float) -> None:
        number = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (i, n)])
        self.rows = detections.withColumn("name", F.try_element_at(number, F.col("cls").cast("int")))
        self.width, self.height = width, height

    def _with(self, values: Sequence[Column], names: Sequence[str]) -> DataFrame:
        rest = [c for c in self.rows.columns if c not in CORNERS]
        return self.rows.select(*rest, *[v.alias(n) for v, n in zip(values, names, strict=True)])

    def xyxy(self) -> DataFrame:
        """Corners in pixels."""
        return self._with(B.box(), CORNERS)

    def xyxyn(self) -> DataFrame:
        """Corners as parts of the image."""
        return self._with([c / s for c, s in zip(B.box(), (self.width, self.height) * 2, strict=True)], CORNERS)

    def xywh(self) -> DataFrame:
        """Centre and size in pixels."""
        return self._with(B.xyxy_to_xywh(B.box()), CENTRE)

    def xywhn(self) -> DataFrame:
        """Centre and size as parts of the image."""
        return self._with(B.pixels_to_normalised(B.box(), self.width, self.height), CENTRE)

    def records(self) -> DataFrame:
        """Each detection as a JSON object: corners, confidence, class and its name."""
        fields = {"xmin": "x1", "ymin": "y1", "xmax": "x2", "ymax": "y2", "confidence": "conf", "class": "cls", "name": "name"}
        return self.rows.select("image", F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()])).alias("value"))

    def counts(self) -> DataFrame:
        """(image, said): how many of each class, by class number."""
        n = self.rows.groupBy("image", "cls", "name").agg(F.count(F.lit(1)).alias("n"))
        words = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("name"), F.when(F.col("n") > 1, "s").otherwise(""))
        listed = F.array_sort(F.collect_list(F.struct("cls", words.alias("said"))))
        return n.groupBy("image").agg(F.array_join(F.transform(listed, lambda x: x["said"]), ", ").alias("said"))


def ensemble(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The detections of several models or views together; suppression comes after."""
    for other in others:
        first = first.unionByName(other)
    return first


def restored(found: DataFrame, scale: float, width: float | None = None, height: float | None = None) -> DataFrame:
    """Detections on an image scaled, and mirrored where a width or height is given, back in the image."""
    x1, y1, x2, y2 = (c / scale for c in B.box())
    if width is not None:
        x1, x2 = width - x2, width - x1
    if height is not None:
        y1, y2 = height - y2, height - y1
    return found.withColumns(dict(zip(CORNERS, (x1, y1, x2, y2), strict=True)))


def overlaid(value: Column, mask: Column, alpha: float = 0.5) -> Column:
    """A channel with a mask over it, where the mask is on; in whole steps."""
    return F.when(mask > 0, F.floor(alpha * mask + (1 - alpha) * value)).otherwise(value)


def densified(points: DataFrame, least_gradient: float, extent: float, dense: float = 1.0, parts: int = 2) -> DataFrame:
    """points (scale, grad and more) with kind and copy: steep small ones twice, steep large ones as parts.

    The parts are copies 1 to parts of a parent that is dropped, each with its scale over
    0.8 * parts; where they lie is the caller's to draw. Others keep copy 0.
    """
    steep = F.col("grad") >= least_gradient
    kind = F.when(steep & (F.col("scale") > dense * extent), "split").when(steep, "clone").otherwise("keep")
    copies = F.when(F.col("kind") == "split", F.sequence(F.lit(1), F.lit(parts))).when(F.col("kind") == "clone", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = points.withColumn("kind", kind).withColumn("copy", F.explode(F.transform(copies, lambda i: i.cast("long"))))
    return rows.withColumn("scale", F.when(F.col("kind") == "split", F.col("scale") / (0.8 * parts)).otherwise(F.col("scale")))
