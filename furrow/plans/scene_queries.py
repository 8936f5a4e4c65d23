"""Queries over label maps, similarity, anchors and ordered sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import scenes as S
from .evaluation_queries import mask_pixels
from .fixtures import R, boxes, frames, pixels, points, r, sql, table
from .geometry_queries import QSQL, matrix, turned
from .registry import query

WEIGHTS = ", ".join(f"({dx}, {dy}, {v!r}::DOUBLE * {w!r}::DOUBLE)" for dx, v in S.window_weights() for dy, w in S.window_weights())
PAIR = ", px AS (SELECT image, x, y, 0.5 + 2 * e AS a, 0.5 + 1.8 * e + 0.02 * ((x * 7 + y * 13 + image) % 5) AS b FROM pixels)"


@query("ssim_px", sql(PAIR + f""", n(dx, dy, w) AS (VALUES {WEIGHTS}), m AS (SELECT image, x + dx AS x, y + dy AS y, sum(w*a) AS ma, sum(w*b) AS mb, sum(w*a*a) AS aa, sum(w*b*b) AS bb, sum(w*a*b) AS ab FROM px CROSS JOIN n
 WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7 GROUP BY ALL) SELECT image, {R('avg((2*ma*mb + 0.0001) * (2*(ab - ma*mb) + 0.0009) / ((ma*ma + mb*mb + 0.0001) * (aa - ma*ma + bb - mb*mb + 0.0009)))')} AS ssim FROM m GROUP BY image""", "pixels"))
def ssim_px(spark: SparkSession, sf: str) -> DataFrame:
    """Structural similarity of each image and a paler, uneven copy."""
    x, y, e = F.col("x"), F.col("y"), F.col("e")
    px = pixels(spark, sf).select("image", "x", "y", (0.5 + 2 * e).alias("a"), (0.5 + 1.8 * e + 0.02 * ((x * 7 + y * 13 + F.col("image")) % 5)).alias("b"))
    return S.ssim(px, 8, 8).select("image", r(F.col("ssim")).alias("ssim"))


@query("prefix_sums", sql(""", g AS (SELECT image, cls, count(*) AS n FROM boxes GROUP BY image, cls) SELECT image, cls, n, sum(n) OVER (PARTITION BY image ORDER BY cls ROWS UNBOUNDED PRECEDING)::BIGINT AS "end",
 (sum(n) OVER (PARTITION BY image ORDER BY cls ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start, coalesce(lag(n) OVER (PARTITION BY image ORDER BY cls) <> n, true) AS changes FROM g""", "boxes"))
def prefix_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Running offsets of each class in its image, and where counts change."""
    g = boxes(spark, sf).groupBy("image", "cls").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image").orderBy("cls")
    end = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return g.select("image", "cls", "n", end.alias("end"), (end - F.col("n")).alias("start"), F.coalesce(F.lag("n").over(w) != F.col("n"), F.lit(True)).alias("changes"))


@query("near_plane", sql(QSQL + f""", k AS (SELECT *, unnest([-1.0, 1.0, 1.0, -1.0]) * 0.5 * tan(0.5) AS cx, unnest([-1.0, -1.0, 1.0, 1.0]) * 0.5 * tan(0.4) AS cy, unnest([0, 1, 2, 3]) AS k FROM m)
 SELECT pid, k::BIGINT AS k, {R('m00*(cx - x) + m10*(cy - y) + m20*(0.5 - z)')} AS wx, {R('m01*(cx - x) + m11*(cy - y) + m21*(0.5 - z)')} AS wy FROM k""", "points"))
def near_plane(spark: SparkSession, sf: str) -> DataFrame:
    """Corners of each view's near rectangle in the world."""
    import math

    tx, ty = 0.5 * math.tan(0.5), 0.5 * math.tan(0.4)
    corners = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(a * tx).alias("cx"), F.lit(b * ty).alias("cy")) for i, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))])
    rows = turned(spark, sf).withColumn("c", F.explode(corners))
    m, d = matrix(), (F.col("c.cx") - F.col("x"), F.col("c.cy") - F.col("y"), 0.5 - F.col("z"))
    world = G.apply([[m[j][i] for j in range(3)] for i in range(3)], d)
    return rows.select("pid", F.col("c.k").cast("long").alias("k"), r(world[0]).alias("wx"), r(world[1]).alias("wy"))


@query("smooth_padded", sql(f""", e AS (SELECT source, min(frame) AS a, max(frame) AS b, arg_min(value, frame) AS first, arg_max(value, frame) AS last FROM frames GROUP BY source), s AS (SELECT f.source, f.frame, sum(g.value) AS s, count(*) AS n, greatest(0, 3 - f.frame) AS before, greatest(0, f.frame + 3 - any_value(b)) AS after, any_value(first) AS first, any_value(last) AS last
 FROM frames f JOIN frames g ON f.source = g.source AND g.frame BETWEEN f.frame - 3 AND f.frame + 3 JOIN e ON e.source = f.source GROUP BY f.source, f.frame) SELECT source, frame, {R('(s + before * first + after * last) / 7')} AS smooth FROM s""", "frames"))
def smooth_padded(spark: SparkSession, sf: str) -> DataFrame:
    """Box filter of seven values, ends repeated beyond the ends."""
    w, whole = Window.partitionBy("source").orderBy("frame"), Window.partitionBy("source").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = frames(spark, sf).select("source", "frame", F.sum("value").over(w.rowsBetween(-3, 3)).alias("s"), F.first("value").over(whole).alias("head"), F.last("value").over(whole).alias("tail"), F.max("frame").over(whole).alias("b"))
    before, after = F.greatest(F.lit(0), 3 - F.col("frame")), F.greatest(F.lit(0), F.col("frame") + 3 - F.col("b"))
    return f.select("source", "frame", r((F.col("s") + before * F.col("head") + after * F.col("tail")) / 7).alias("smooth"))


@query("replicate_smallest", sql("""SELECT image, box_id FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY (x2 - x1) + (y2 - y1), box_id) AS n, count(*) OVER (PARTITION BY image) AS c FROM boxes) WHERE n <= c // 2""", "boxes"))
def replicate_smallest(spark: SparkSession, sf: str) -> DataFrame:
    """The smaller half of each image's boxes by side length."""
    w = Window.partitionBy("image")
    size = (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1"))
    ranked = boxes(spark, sf).withColumn("n", F.row_number().over(w.orderBy(size, "box_id"))).withColumn("c", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("n") <= F.floor(F.col("c") / 2)).select("image", "box_id")


@query("file_facts", f"SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS age_days, strftime(o_orderdate, '%Y-%-m-%-d') AS day, {R('o_totalprice / 1048576')} AS mb FROM orders")
def file_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Age in days, date and size in MB."""
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.datediff(F.lit("2000-01-01").cast("date"), d.cast("date")).cast("long").alias("age_days"), F.date_format(d, "yyyy-M-d").alias("day"), r(F.col("o_totalprice") / 1048576).alias("mb"))


@query("composed_labels")
def composed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label maps of objects laid down by id, the nearer on top."""
    px = mask_pixels(spark, sf).withColumn("depth", ((F.col("mask") * 37) % 11 + F.col("px") % 3).cast("double"))
    return S.composed_labels(px.select("image", F.col("mask").alias("obj"), "px", "depth"))


@query("fitted_anchors")
def fitted_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Six anchor sizes fitted to all boxes."""
    return S.fitted_anchors(boxes(spark, sf).select((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")), 6)


@query("morphology_run")
def morphology_run(spark: SparkSession, sf: str) -> DataFrame:
    """Traits of each cloud after cleaning and clustering."""
    return S.morphology(points(spark, sf).select("file_id", "pid", "x", "y", "z"), S.Morphology(outlier_k=8))
