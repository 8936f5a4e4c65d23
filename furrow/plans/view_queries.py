"""Queries over views, screen shapes, draws and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import geometry as G
from ..operators import sampling as D
from ..operators import scenes as S
from ..session import cut
from ..streaming import frames as Z
from .fixtures import R, boxes, points, r, sql, table
from .geometry_queries import QSQL, SQL_COV, cols, matrix, quat, turned
from .point_queries import SPLATS, composited, splats
from .registry import query

SHIFT, SCALE = (0.5, -1.0, 2.0), 1.5


@query("shifted_views", sql(QSQL + f""", c AS (SELECT *, (-(m00*x + m10*y + m20*z) + 0.5) * 1.5 AS cx, (-(m01*x + m11*y + m21*z) - 1.0) * 1.5 AS cy, (-(m02*x + m12*y + m22*z) + 2.0) * 1.5 AS cz FROM m)
 SELECT pid, {R('cx')} AS cx, {R('cy')} AS cy, {R('cz')} AS cz, {R('-(m00*cx + m01*cy + m02*cz)')} AS tx, {R('-(m10*cx + m11*cy + m12*cz)')} AS ty, {R('-(m20*cx + m21*cy + m22*cz)')} AS tz FROM c""", "points"))
def shifted_views(spark: SparkSession, sf: str) -> DataFrame:
    """Centres of views moved and scaled, and the translations that such views have."""
    m = matrix()
    moved = G.shifted_centre(m, cols("x", "y", "z"), SHIFT, SCALE)
    at = turned(spark, sf).select("*", *[c.alias("c" + n) for c, n in zip(moved, "xyz", strict=True)])
    return at.select("pid", *[r(F.col("c" + n)).alias("c" + n) for n in "xyz"], *[r(-t).alias("t" + n) for t, n in zip(G.apply(m, cols("cx", "cy", "cz")), "xyz", strict=True)])


@query("view_path", sql(QSQL + f""", n AS (SELECT file_id, pid, x, y, z, qw, qx, qy, qz, lead(pid) OVER w AS next, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(qw) OVER w AS w2, lead(qx) OVER w AS a2, lead(qy) OVER w AS b2, lead(qz) OVER w AS c2 FROM m WINDOW w AS (PARTITION BY file_id ORDER BY pid)),
 d AS (SELECT *, qw*w2 + qx*a2 + qy*b2 + qz*c2 AS dot FROM n WHERE next IS NOT NULL), a AS (SELECT *, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg, acos(least(abs(dot), 1)) AS an, unnest([0, 1, 2, 3, 4]) AS k FROM d),
 t AS (SELECT *, k / 4.0::DOUBLE AS t, CASE WHEN sin(an) < 1e-6 THEN 1 - k / 4.0::DOUBLE ELSE sin((1 - k / 4.0::DOUBLE)*an)/sin(an) END AS wa, CASE WHEN sin(an) < 1e-6 THEN k / 4.0::DOUBLE ELSE sin(k / 4.0::DOUBLE*an)/sin(an) END * sg AS wb FROM a)
 SELECT file_id, pid, k::BIGINT AS k, {R('(1-t)*x + t*x2')} AS x, {R('(1-t)*y + t*y2')} AS y, {R('(1-t)*z + t*z2')} AS z, {R('wa*qw + wb*w2')} AS qw, {R('wa*qx + wb*a2')} AS qx, {R('wa*qy + wb*b2')} AS qy, {R('wa*qz + wb*c2')} AS qz FROM t""", "points"))
def view_path(spark: SparkSession, sf: str) -> DataFrame:
    """Five views from each view of a scene to the next: centres along a line, rotations along the shorter arc."""
    w, names = Window.partitionBy("file_id").orderBy("pid"), ("x", "y", "z", "qw", "qx", "qy", "qz")
    pairs = turned(spark, sf).select("file_id", "pid", *names, F.lead("pid").over(w).alias("next"), *[F.lead(n).over(w).alias(n + "2") for n in names]).filter("next is not null")
    steps = pairs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    t = F.col("k") / 4
    centre = [(1 - t) * F.col(c) + t * F.col(c + "2") for c in "xyz"]
    turn = G.slerp(quat(), cols("qw2", "qx2", "qy2", "qz2"), t)
    return steps.select("file_id", "pid", "k", *[r(c).alias(n) for c, n in zip((*centre, *turn), names, strict=True)])


PERSPECTIVE = ((0.5, 0.1, 4.0), (0.02, 0.5, -3.0), (0.0005, 0.0002, 1.0))


def _corner(i: int, x: str, y: str) -> str:
    a, b, c = PERSPECTIVE[i]
    return f"({a}::DOUBLE*{x} + {b}::DOUBLE*{y} + {c}::DOUBLE) / (0.0005::DOUBLE*{x} + 0.0002::DOUBLE*{y} + 1.0::DOUBLE)"


def _ends(i: int, f: str) -> str:
    return f"{f}({', '.join(_corner(i, x, y) for x, y in (('x1', 'y1'), ('x2', 'y2'), ('x1', 'y2'), ('x2', 'y1')))})"


@query("perspective_boxes", sql(f"""SELECT image, box_id, {R(f'greatest(0, least({_ends(0, "least")}, 300))')} AS w1, {R(f'greatest(0, least({_ends(1, "least")}, 200))')} AS w2,
 {R(f'greatest(0, least({_ends(0, "greatest")}, 300))')} AS w3, {R(f'greatest(0, least({_ends(1, "greatest")}, 200))')} AS w4 FROM boxes""", "boxes"))
def perspective_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of boxes after a transform with perspective, clipped to the image."""
    return boxes(spark, sf).select("image", "box_id", *[r(c).alias(f"w{i + 1}") for i, c in enumerate(B.warp(B.box(), PERSPECTIVE, 300.0, 200.0))])


@query("visible_splats", sql(SQL_COV + f""", d AS (SELECT pid, x, y, vz, a, b, c, a*c - b*b AS det FROM k), e AS (SELECT *, ceil(3 * sqrt((a+c)*0.5 + sqrt(greatest(0.1, ((a+c)*0.5)^2 - det)))) AS radius, 320 + 50 * x / vz AS px, 240 + 50 * y / vz AS py FROM d WHERE det <> 0 AND vz > 0.2)
 SELECT pid, {R('c/det')} AS ca, {R('-b/det')} AS cb, {R('a/det')} AS cc, {R('radius')} AS radius, (floor((px + radius) / 16) - floor((px - radius) / 16) + 1)::BIGINT AS columns FROM e WHERE radius > 0 AND px + radius >= 0 AND px - radius < 640 AND py + radius >= 0 AND py - radius < 480""", "points"))
def visible_splats(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussians in front of the view whose radius is over 0 and which the screen shows: inverse covariance, radius and columns of tiles."""
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    scale = [F.exp("e7"), F.exp("e8"), F.exp("x")]
    flat_m = [F.col(f"m{i}{j}") for i in range(3) for j in range(3)]
    cov = G.let(scale + flat_m, names, lambda v: G.covariance(v[:3], [v[3:6], v[6:9], v[9:12]]))
    solid = turned(spark, sf).select("pid", "x", "y", (F.col("z") + 3).alias("z"), cov.alias("cov")).filter("z > 0.2")
    flat = G.let(cols("x", "y", "z", *(f"cov.{n}" for n in names)), ("a", "b", "c"), lambda v: G.covariance_2d(v[:3], v[3:], 50.0, 0.5))
    # written once: the optimizer would repeat the covariance in every term of what follows
    plain = cut(solid.select("pid", "x", "y", "z", flat.alias("flat")).select("pid", "x", "y", "z", "flat.*"))
    got = plain.select("pid", "x", "y", "z", *[c.alias(n) for c, n in zip(G.conic(*cols("a", "b", "c")), ("ca", "cb", "cc", "radius"), strict=True)])
    at = got.withColumn("px", 320 + 50 * F.col("x") / F.col("z")).withColumn("py", 240 + 50 * F.col("y") / F.col("z"))
    seen = at.filter("radius > 0 and px + radius >= 0 and px - radius < 640 and py + radius >= 0 and py - radius < 480")
    columns = F.floor((F.col("px") + F.col("radius")) / 16) - F.floor((F.col("px") - F.col("radius")) / 16) + 1
    return seen.select("pid", *[r(F.col(c)).alias(c) for c in ("ca", "cb", "cc", "radius")], columns.alias("columns"))


@query("alpha_mask", sql(SPLATS + ", k AS (SELECT px, py FROM c GROUP BY px, py HAVING sum(w) > 0.5) SELECT px, py, (min(px) OVER ())::BIGINT AS x1, (max(py) OVER ())::BIGINT AS y2 FROM k", "points"))
def alpha_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels that the rendering covers more than half, and two of their bounds."""
    on = composited(splats(spark, sf)).groupBy("px", "py").agg(F.sum("w").alias("alpha")).filter("alpha > 0.5").select("px", "py")
    return on.join(F.broadcast(on.agg(F.min("px").cast("long").alias("x1"), F.max("py").cast("long").alias("y2"))))


@query("common_fields", """WITH k AS (SELECT event_type, event_id, unnest(json_keys(props)) AS field FROM events), f AS (SELECT event_type, field, count(DISTINCT event_id) AS n FROM k GROUP BY ALL), e AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL)
 SELECT f.event_type, field FROM f JOIN e USING (event_type) WHERE f.n = e.n""")
def common_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Names of fields that all records of a kind have."""
    own = table(spark, sf, "events").select("event_type", "event_id", "props")
    held = own.select("event_type", "event_id", F.explode(F.json_object_keys("props")).alias("field")).distinct().groupBy("event_type", "field").agg(F.count(F.lit(1)).alias("n"))
    return held.join(own.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), ["event_type", "n"]).select("event_type", "field")


@query("weighted_draw", sql(""", i AS (SELECT image, count(*) FILTER (cls = 1) AS w, image % 3 AS grp FROM boxes GROUP BY image), c AS (SELECT *, (sum(w) OVER (PARTITION BY grp ORDER BY image ROWS UNBOUNDED PRECEDING))::BIGINT - w AS before FROM i WHERE w > 0),
 d AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY image) - 1 AS draw FROM i), t AS (SELECT grp, sum(w)::BIGINT AS total FROM i GROUP BY grp), p AS (SELECT grp, draw, floor(((draw * 7919 + 13) % 100003) / 100003.0::DOUBLE * total)::BIGINT AS pos FROM d JOIN t USING (grp))
 SELECT p.grp, p.draw, c.image FROM p JOIN c ON p.grp = c.grp AND p.pos >= c.before AND p.pos < c.before + c.w""", "boxes"))
def weighted_draw(spark: SparkSession, sf: str) -> DataFrame:
    """As many images of each group as it has, drawn by how many boxes of class 1 they hold."""
    i = boxes(spark, sf).groupBy("image", (F.col("image") % 3).alias("grp")).agg(F.count_if(F.col("cls") == 1).alias("w"))
    n = D.cumulated(i.withColumn("one", F.lit(1).cast("long")), ["grp"], [F.col("image")], "one", "draw")
    draws = n.select("grp", "draw", (((F.col("draw") * 7919 + 13) % 100003) / 100003.0).alias("share"))
    return D.weighted_draws(i, draws, ["grp"], "image", "w")


@query("two_strikes", """SELECT user_id AS mask, CASE WHEN bool_or(event_type = 'purchase') OR count(*) > 1 THEN 'processed' ELSE 'buffered' END AS status FROM events GROUP BY user_id""")
def two_strikes(spark: SparkSession, sf: str) -> DataFrame:
    """Masks that were matched or met twice, and those that wait."""
    return Z.strikes(table(spark, sf, "events").select(F.col("user_id").alias("mask"), (F.col("event_type") == "purchase").alias("matched")))


@query("evolved_anchors")
def evolved_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Six anchor sizes after sixteen generations of mutations, and how well they fit all boxes."""
    return S.evolved_anchors(boxes(spark, sf).select((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")), 6)
