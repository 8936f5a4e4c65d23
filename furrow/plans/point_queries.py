"""Queries over point clouds and Gaussians."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import association as V
from ..operators import hierarchy
from ..operators import points as P
from ..operators import shapes as H
from ..operators import traits as T
from ..session import cut
from .fixtures import R, points, r, sql
from .registry import query

DIST = """, d AS (SELECT a.file_id, a.pid, b.pid AS other, sqrt((a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2) AS d FROM points a JOIN points b ON a.file_id = b.file_id AND a.pid <> b.pid),
 k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, other) AS n FROM d)"""


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("file_id", "pid", "x", "y", "z")


@query("knn_mean_distance", sql(DIST + f" SELECT pid, {R('avg(d * d)')} AS near FROM k WHERE n <= 3 GROUP BY pid", "points"))
def knn_mean_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared distance to the three nearest points."""
    return P.mean_neighbour_distance(cloud(spark, sf), "file_id", 3, True).select("pid", r(F.col("near")).alias("near"))


@query("outlier_removal", sql(DIST + """, a AS (SELECT file_id, pid, avg(d) AS near FROM k JOIN points USING (file_id, pid) WHERE n <= 8 GROUP BY file_id, pid), m AS (SELECT *, median(near) OVER (PARTITION BY file_id) AS mid FROM a),
 b AS (SELECT *, median(abs(near - mid)) OVER (PARTITION BY file_id) AS mad FROM m) SELECT file_id, pid FROM b WHERE near < mid + 2 * 1.4826 * mad""", "points"))
def outlier_removal(spark: SparkSession, sf: str) -> DataFrame:
    """Points left by statistical outlier removal."""
    return P.without_outliers(cloud(spark, sf), "file_id", 8, 2.0).select("file_id", "pid")


@query("nearest_views", sql(""", d AS (SELECT a.file_id, a.pid, b.pid AS other, sqrt((a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2) AS d FROM points a JOIN points b ON a.file_id = b.file_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY file_id, pid ORDER BY d, other) AS n FROM d WHERE d >= 1e-6) SELECT pid, other, n FROM k WHERE n <= 4""", "points"))
def nearest_views(spark: SparkSession, sf: str) -> DataFrame:
    """The four nearest views of each view in its scene."""
    return P.neighbours(cloud(spark, sf), "file_id", 4, 1e-6).select("pid", "other", "n")


CLUSTERS = """, e AS (SELECT a.file_id, a.pid, b.pid AS other FROM points a JOIN points b ON a.file_id = b.file_id AND (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 <= 0.0144),
 c AS (SELECT file_id, pid FROM e GROUP BY file_id, pid HAVING count(*) >= 4), l AS (SELECT e.file_id, e.pid, e.other FROM e JOIN c ON e.pid = c.pid JOIN c c2 ON e.other = c2.pid),
 w AS (SELECT file_id, pid, pid AS root FROM c UNION SELECT l.file_id, l.other, w.root FROM w JOIN l ON l.pid = w.pid), g AS (SELECT file_id, pid, min(root) AS root FROM w GROUP BY file_id, pid),
 n AS (SELECT file_id, root, dense_rank() OVER (PARTITION BY file_id ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT file_id, root FROM g)), x AS (SELECT g.file_id, g.pid, n.cluster FROM g JOIN n USING (file_id, root)),
 b AS (SELECT e.file_id, e.pid, min(x.cluster) AS cluster FROM e JOIN x ON e.other = x.pid WHERE e.pid NOT IN (SELECT pid FROM c) GROUP BY e.file_id, e.pid),
 lab AS (SELECT p.file_id, p.pid, coalesce(x.cluster, b.cluster, -1) AS cluster FROM points p LEFT JOIN x ON p.pid = x.pid LEFT JOIN b ON p.pid = b.pid)"""


@query("density_clusters", sql(CLUSTERS + " SELECT file_id, pid, cluster FROM lab", "points"))
def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters of each cloud, noise -1."""
    return P.clustered(cloud(spark, sf), "file_id", 0.12, 4).select("file_id", "pid", "cluster")


@query("main_cluster", sql(CLUSTERS + ", n2 AS (SELECT file_id, cluster, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, cluster) AS n FROM lab GROUP BY file_id, cluster) SELECT lab.file_id, lab.pid FROM lab JOIN n2 USING (file_id, cluster) WHERE n = 1", "points"))
def main_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the largest cluster of each cloud."""
    return P.main_cluster(P.clustered(cloud(spark, sf), "file_id", 0.12, 4), "file_id").select("file_id", "pid")


@query("hierarchical_clusters")
def hierarchical_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The most stable clusters of each cloud over all densities, noise -1."""
    return hierarchy.clustered(cloud(spark, sf), "file_id", 5, 3, False).select("file_id", "pid", "cluster")


@query("robust_location", sql(f""", m AS (SELECT file_id, median(x) AS mid FROM points GROUP BY file_id) SELECT p.file_id, {R('any_value(mid)')} AS mid, {R('median(abs(x - mid)) * 1.4826')} AS mad, {R('quantile_cont(x, 0.005)')} AS low, {R('quantile_cont(x, 0.995)')} AS high,
 {R('avg(x)')} AS cx, {R('avg(y)')} AS cy, {R('avg(z)')} AS cz, count(*) AS n, {R('min(x)')} AS x0, {R('max(x)')} AS x1, {R('min(z)')} AS z0, {R('max(z)')} AS z1, {R('covar_samp(x, y)')} AS cxy, {R('covar_samp(x, z)')} AS cxz, {R('var_samp(x)')} AS cxx FROM points p JOIN m USING (file_id) GROUP BY p.file_id""", "points"))
def robust_location(spark: SparkSession, sf: str) -> DataFrame:
    """Median, MAD, percentiles, centroid, bounds and covariance of each cloud."""
    p = cloud(spark, sf)
    mids = p.groupBy("file_id").agg(F.median("x").alias("mid"))
    q = p.join(mids, "file_id").groupBy("file_id")
    return q.agg(
        r(F.first("mid")).alias("mid"), r(F.median(F.abs(F.col("x") - F.col("mid"))) * 1.4826).alias("mad"), r(F.percentile("x", F.lit(0.005))).alias("low"), r(F.percentile("x", F.lit(0.995))).alias("high"),
        *[r(F.avg(c)).alias("c" + c) for c in "xyz"], F.count(F.lit(1)).alias("n"), r(F.min("x")).alias("x0"), r(F.max("x")).alias("x1"), r(F.min("z")).alias("z0"), r(F.max("z")).alias("z1"),
        r(F.covar_samp("x", "y")).alias("cxy"), r(F.covar_samp("x", "z")).alias("cxz"), r(F.var_samp("x")).alias("cxx"),
    )


@query("shape_traits")
def shape_traits(spark: SparkSession, sf: str) -> DataFrame:
    """Traits of each cloud: length, width, volume, inclination, curvature."""
    return T.traits(cloud(spark, sf), "file_id")


#: Axes of each cloud in closed form: eigenvalues by the angle of the scaled determinant, axes as the longest product of two rows of what is left.
AXES = """, m AS (SELECT file_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS c, covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM points GROUP BY file_id),
 q AS (SELECT *, (a+b+c)/3 AS q, sqrt(((a-(a+b+c)/3)^2 + (b-(a+b+c)/3)^2 + (c-(a+b+c)/3)^2 + 2*(d*d+e*e+f*f))/6) AS p FROM m),
 g AS (SELECT *, acos(greatest(-1, least(1, ((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e)) / (p*p*p) / 2)))/3 AS phi FROM q),
 v AS (SELECT file_id, n, cx, cy, cz, a, b, c, d, e, f, k, q + 2*p*cos(phi + CASE k WHEN 1 THEN 0 WHEN 2 THEN -2*pi()/3 ELSE 2*pi()/3 END) AS l FROM g CROSS JOIN (VALUES (1), (2), (3)) t(k)),
 w AS (SELECT file_id, n, cx, cy, cz, k, l, unnest([[d*f-e*(b-l), e*d-(a-l)*f, (a-l)*(b-l)-d*d], [d*(c-l)-e*f, e*e-(a-l)*(c-l), (a-l)*f-d*e], [(b-l)*(c-l)-f*f, f*e-d*(c-l), d*f-(b-l)*e]]) AS r FROM v),
 o AS (SELECT file_id, n, cx, cy, cz, k, any_value(l) AS l, arg_max(r, r[1]^2 + r[2]^2 + r[3]^2) AS r FROM w GROUP BY file_id, n, cx, cy, cz, k),
 s AS (SELECT *, sqrt(r[1]^2 + r[2]^2 + r[3]^2) * CASE WHEN greatest(r[1], r[2], r[3]) >= -least(r[1], r[2], r[3]) THEN 1 ELSE -1 END AS len FROM o),
 ax AS (SELECT file_id, n, cx, cy, cz, k, l, r[1]/len AS ax, r[2]/len AS ay, r[3]/len AS az FROM s),
 u AS (SELECT p.file_id, p.pid, ax.k, (p.x-cx)*ax + (p.y-cy)*ay + (p.z-cz)*az AS u FROM points p JOIN ax USING (file_id))"""


@query("oriented_boxes", sql(AXES + f""", h AS (SELECT file_id, k, min(u) AS low, max(u) AS high FROM u GROUP BY file_id, k), j AS (SELECT ax.*, low, high FROM ax JOIN h USING (file_id, k))
 SELECT file_id, {R('max(cx) + sum((low+high)/2*ax)')} AS c1, {R('max(cy) + sum((low+high)/2*ay)')} AS c2, {R('max(cz) + sum((low+high)/2*az)')} AS c3, {", ".join(f"{R(f'max(high-low) FILTER (k = {k})')} AS e{k}" for k in (1, 2, 3))},
 {", ".join(f"{R(f'max(a{c}) FILTER (k = {k})')} AS a{3 * k - 2 + i}" for k in (1, 2, 3) for i, c in enumerate("xyz"))} FROM j GROUP BY file_id""", "points"))
def oriented_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes along the principal axes of each cloud: centre, extent, axes row by row."""
    found = H.oriented_boxes(cloud(spark, sf), "file_id")
    return found.select("file_id", *[r(F.col(c)[i]).alias(f"{n}{i + 1}") for c, n, k in (("center", "c", 3), ("extent", "e", 3), ("axes", "a", 9)) for i in range(k)])


@query("principal_traits", sql(AXES + f""", h AS (SELECT file_id, 2 * quantile_cont(abs(u), 0.95) AS width FROM u WHERE k = 3 GROUP BY file_id) SELECT ax.file_id, max(n) AS n, {", ".join(f"{R(f'max(l) FILTER (k = {k})')} AS v{k}" for k in (1, 2, 3))},
 {R('any_value(width)')} AS width, {R('degrees(acos(greatest(-1, least(1, max(az) FILTER (k = 1)))))')} AS inclination FROM ax JOIN h USING (file_id) GROUP BY ax.file_id""", "points"))
def principal_traits(spark: SparkSession, sf: str) -> DataFrame:
    """Variances along the axes of each cloud, its width across them and its inclination."""
    p = cloud(spark, sf)
    found = cut(H.frames(p, "file_id"))
    width = H.widths(H.local(p, found, "file_id"), "file_id")
    return found.join(width, "file_id").select("file_id", "n", *[r(F.col("values")[i]).alias(f"v{i + 1}") for i in range(3)], r(F.col("width")).alias("width"), r(H.inclination(F.col("axes"))).alias("inclination"))


@query("scene_extent", sql(f""", c AS (SELECT file_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY file_id) SELECT file_id, {R('max(sqrt((x-cx)^2 + (y-cy)^2 + (z-cz)^2)) * 1.1')} AS radius FROM points JOIN c USING (file_id) GROUP BY file_id""", "points"))
def scene_extent(spark: SparkSession, sf: str) -> DataFrame:
    """Radius of each scene's cameras around their mean, and a tenth more."""
    p = cloud(spark, sf)
    c = p.groupBy("file_id").agg(*[F.avg(a).alias("c" + a) for a in "xyz"])
    d = F.sqrt(sum(((F.col(a) - F.col("c" + a)) * (F.col(a) - F.col("c" + a)) for a in "xyz"), F.lit(0.0)))
    return p.join(c, "file_id").groupBy("file_id").agg(r(F.max(d) * 1.1).alias("radius"))


SPLATS = """, s AS (SELECT pid, 16 + x * 40 AS sx, 16 + y * 40 AS sy, z + 3 AS depth, 1.5 + abs(e3) * 6 AS radius, 1 / (1 + exp(-e4 * 4)) AS opacity, file_id % 4 AS obj FROM points),
 t AS (SELECT *, unnest(range(greatest(0, floor((sx - radius) / 8))::BIGINT, least(4, floor((sx + radius) / 8) + 1)::BIGINT)) AS tx FROM s),
 u AS (SELECT *, unnest(range(greatest(0, floor((sy - radius) / 8))::BIGINT, least(4, floor((sy + radius) / 8) + 1)::BIGINT)) AS ty FROM t),
 px AS (SELECT a AS px, b AS py, a // 8 AS tx, b // 8 AS ty FROM (SELECT unnest(range(0, 32)) AS a) CROSS JOIN (SELECT unnest(range(0, 32)) AS b)),
 al AS (SELECT px, py, pid, depth, obj, least(0.99, opacity * exp(-0.5 * ((px - sx)^2 + (py - sy)^2) / (radius / 3)^2)) AS alpha FROM u JOIN px USING (tx, ty)),
 tr AS (SELECT *, coalesce(exp(sum(ln(1 - alpha)) OVER (PARTITION BY px, py ORDER BY depth, pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS t FROM al WHERE alpha >= 1 / 255.0::DOUBLE),
 c AS (SELECT *, alpha * t AS w FROM tr WHERE t * (1 - alpha) >= 1e-4)"""


def splats(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return points(spark, sf).select("pid", (16 + c("x") * 40).alias("sx"), (16 + c("y") * 40).alias("sy"), (c("z") + 3).alias("depth"), (1.5 + F.abs("e3") * 6).alias("radius"), (1 / (1 + F.exp(-c("e4") * 4))).alias("opacity"), (c("file_id") % 4).alias("obj"))


def covered(s: DataFrame, size: int = 32, tile: int = 8) -> DataFrame:
    """s for each pixel that a Gaussian covers: px, py and alpha.

    Gaussians go to the tiles that they meet and are joined to the tiles' pixels. What covers less
    than 1/255 of a pixel does not count.
    """
    c, n = F.col, size // tile
    spread = lambda v: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((c(v) - c("radius")) / tile)), F.least(F.lit(n - 1), F.floor((c(v) + c("radius")) / tile))))
    meets = lambda v: F.floor((c(v) - c("radius")) / tile) <= F.least(F.lit(n - 1), F.floor((c(v) + c("radius")) / tile))
    on = s.filter(meets("sx") & meets("sy") & (c("sx") + c("radius") >= 0) & (c("sy") + c("radius") >= 0))
    tiles = on.withColumn("tx", spread("sx")).withColumn("ty", spread("sy"))
    within = F.sequence(F.lit(0), F.lit(tile - 1))
    pixels = tiles.withColumn("dx", F.explode(within)).withColumn("dy", F.explode(within)).withColumn("px", c("tx") * tile + c("dx")).withColumn("py", c("ty") * tile + c("dy"))
    gap = (c("px") - c("sx")) * (c("px") - c("sx")) + (c("py") - c("sy")) * (c("py") - c("sy"))
    alpha = F.least(F.lit(0.99), c("opacity") * F.exp(-0.5 * gap / ((c("radius") / 3) * (c("radius") / 3))))
    return pixels.withColumn("alpha", alpha).filter(c("alpha") >= 1 / 255.0)


def composited(s: DataFrame, size: int = 32, tile: int = 8, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weights of Gaussians at pixels, front to back: px, py, pid, obj, depth, alpha, t, w.

    A pixel's transparency before each is a running sum of logarithms; a Gaussian that would leave
    under 1e-4 ends the pixel.
    """
    c = F.col
    before = Window.partitionBy(*keys, "px", "py").orderBy("depth", "pid").rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.exp(F.sum(F.ln(1 - c("alpha"))).over(before)), F.lit(1.0))
    return covered(s, size, tile).withColumn("t", t).filter(c("t") * (1 - c("alpha")) >= 1e-4).select(*keys, "px", "py", "pid", "obj", "depth", "alpha", "t", (c("alpha") * c("t")).alias("w"))


@query("splat_tiles", sql(SPLATS + ", k AS (SELECT tx + 4 * ty AS tile, pid, depth FROM u), n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY depth, pid) AS n FROM k) SELECT tile, pid, n, count(*) OVER (PARTITION BY tile) AS size FROM n", "points"))
def splat_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussians of each tile in order of depth, and each tile's range."""
    c = F.col
    low = lambda v: F.greatest(F.lit(0), F.floor((c(v) - c("radius")) / 8))
    high = lambda v: F.least(F.lit(3), F.floor((c(v) + c("radius")) / 8))
    s = splats(spark, sf).filter((low("sx") <= high("sx")) & (low("sy") <= high("sy")))
    k = s.withColumn("tx", F.explode(F.sequence(low("sx"), high("sx")))).withColumn("ty", F.explode(F.sequence(low("sy"), high("sy")))).withColumn("tile", c("tx") + 4 * c("ty"))
    w = Window.partitionBy("tile")
    return k.select("tile", "pid", F.row_number().over(w.orderBy("depth", "pid")).cast("long").alias("n"), F.count(F.lit(1)).over(w).alias("size"))


@query("splat_composite", sql(SPLATS + f" SELECT px, py, {R('sum(w)')} AS alpha, {R('sum(w * depth)')} AS depth, {R('sum(w * obj) + (1 - sum(w)) * 0.5')} AS colour, count(*) AS n FROM c GROUP BY px, py", "points"))
def splat_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Opacity, depth and colour of each pixel over a background."""
    w = F.col("w")
    return composited(splats(spark, sf)).groupBy("px", "py").agg(r(F.sum(w)).alias("alpha"), r(F.sum(w * F.col("depth"))).alias("depth"), r(F.sum(w * F.col("obj")) + (1 - F.sum(w)) * 0.5).alias("colour"), F.count(F.lit(1)).alias("n"))


CONTRIB = SPLATS + ", m AS (SELECT px, py, (px // 8 + py // 16) % 3 AS mask FROM px), k AS (SELECT mask AS obj, pid, sum(w) AS c FROM c JOIN m USING (px, py) GROUP BY mask, pid)"


def contributions(spark: SparkSession, sf: str) -> DataFrame:
    """(obj, pid, c): what each Gaussian gives to the pixels of each mask, summed over pixels."""
    mask = (F.floor(F.col("px") / 8) + F.floor(F.col("py") / 16)) % 3
    return composited(splats(spark, sf)).withColumn("obj", mask).groupBy("obj", "pid").agg(F.sum("w").alias("c"))


@query("splat_contributions", sql(CONTRIB + f" SELECT obj, pid, {R('c')} AS c FROM k", "points"))
def splat_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """What each Gaussian gives to each mask."""
    return contributions(spark, sf).select("obj", "pid", r(F.col("c")).alias("c"))


def labelled(contrib: DataFrame, gamma: float = 0.0) -> DataFrame:
    """(obj, pid) where what a Gaussian gives an object outweighs all the rest; ties go to the rest."""
    with_rest = contrib.withColumn("rest", F.sum("c").over(Window.partitionBy("pid")) - F.col("c"))
    n = F.greatest(F.sqrt(F.col("rest") * F.col("rest") + F.col("c") * F.col("c")), F.lit(1e-12))
    return with_rest.filter((F.col("c") / n > F.col("rest") / n + gamma) & (F.col("obj") > 0)).select("obj", "pid")


@query("splat_labels", sql(CONTRIB + ", s2 AS (SELECT *, sum(c) OVER (PARTITION BY pid) - c AS rest FROM k) SELECT obj, pid FROM s2 WHERE c / greatest(sqrt(c^2 + rest^2), 1e-12) > rest / greatest(sqrt(c^2 + rest^2), 1e-12) + 0.1 AND obj > 0", "points"))
def splat_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The object of each Gaussian, where one outweighs the rest."""
    return labelled(contributions(spark, sf), 0.1)


@query("label_vote", sql(CONTRIB + """, a AS (SELECT obj, pid FROM k WHERE c > 0.05), o AS (SELECT pid, pid % 3 AS old FROM points), v AS (SELECT a.obj, o.old, count(*) AS n FROM a JOIN o USING (pid) GROUP BY a.obj, o.old),
 tt AS (SELECT obj, sum(n) AS total, sum(n) FILTER (old > 0) AS claimed, arg_max(old, n * 10 - old) FILTER (old > 0) AS modal, max(n) FILTER (old > 0) AS most FROM v GROUP BY obj)
 SELECT obj, total::BIGINT AS total, claimed::BIGINT AS claimed, modal, claimed > 0.5 * total AS taken, most < 0.6 * total AS new_id FROM tt""", "points"))
def label_vote(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each new object's Gaussians are already claimed, and by which object most."""
    a = contributions(spark, sf).filter("c > 0.05").select("obj", "pid", (F.col("pid") % 3).alias("old"))
    v = a.groupBy("obj", "old").agg(F.count(F.lit(1)).alias("n"))
    claimed = F.when(F.col("old") > 0, F.col("n"))
    modal = F.max(F.when(F.col("old") > 0, F.struct(F.col("n"), (-F.col("old")).alias("k"))))
    t = v.groupBy("obj").agg(F.sum("n").alias("total"), F.sum(claimed).alias("claimed"), modal.alias("m"))
    return t.select("obj", "total", "claimed", (-F.col("m.k")).alias("modal"), (F.col("claimed") > 0.5 * F.col("total")).alias("taken"), (F.col("m.n") < 0.6 * F.col("total")).alias("new_id"))


@query("prune_points", sql(f""", s AS (SELECT pid, 1 / (1 + exp(-e4 * 4)) AS o, exp(e5) AS s, z, avg(z) OVER (PARTITION BY file_id) AS mz FROM points) SELECT pid, o < 0.4 OR s > 1.2 AS pruned, z < mz AS low, CASE WHEN s > 1.1 THEN 2 WHEN s > 0.9 THEN 1 ELSE 0 END::BIGINT AS copies, {R('s / (0.8 * 2)')} AS split_scale FROM s""", "points"))
def prune_points(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussians to prune, below the mean height, and to clone or split."""
    o, s = 1 / (1 + F.exp(-F.col("e4") * 4)), F.exp("e5")
    return points(spark, sf).select("pid", ((o < 0.4) | (s > 1.2)).alias("pruned"), (F.col("z") < F.avg("z").over(Window.partitionBy("file_id"))).alias("low"), F.when(s > 1.1, 2).when(s > 0.9, 1).otherwise(0).cast("long").alias("copies"), r(s / 1.6).alias("split_scale"))


@query("depth_alignment", sql(f""", d AS (SELECT file_id, 1 / (z + 3) AS a, 2 / (z + 3) + 0.1 + 0.01 * x AS b FROM points), m AS (SELECT file_id, median(a) AS ma, median(b) AS mb, count(*) AS n FROM d GROUP BY file_id),
 s AS (SELECT file_id, any_value(ma) AS ma, any_value(mb) AS mb, avg(abs(a - ma)) AS sa, avg(abs(b - mb)) AS sb, any_value(n) AS n, max(a) - min(a) AS span FROM d JOIN m USING (file_id) GROUP BY file_id)
 SELECT file_id, {R('CASE WHEN n > 10 AND span > 1e-3 THEN sa / sb ELSE 0 END')} AS scale, {R('CASE WHEN n > 10 AND span > 1e-3 THEN ma - mb * sa / sb ELSE 0 END')} AS shift FROM s""", "points"))
def depth_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Scale and offset that align one inverse depth with another by medians and mean deviations."""
    d = points(spark, sf).select("file_id", (1 / (F.col("z") + 3)).alias("a"), (2 / (F.col("z") + 3) + 0.1 + 0.01 * F.col("x")).alias("b"))
    m = d.groupBy("file_id").agg(F.median("a").alias("ma"), F.median("b").alias("mb"), F.count(F.lit(1)).alias("n"))
    s = d.join(m, "file_id").groupBy("file_id", "ma", "mb", "n").agg(F.avg(F.abs(F.col("a") - F.col("ma"))).alias("sa"), F.avg(F.abs(F.col("b") - F.col("mb"))).alias("sb"), (F.max("a") - F.min("a")).alias("span"))
    ok, ratio = (F.col("n") > 10) & (F.col("span") > 1e-3), F.col("sa") / F.col("sb")
    return s.select("file_id", r(F.when(ok, ratio).otherwise(0.0)).alias("scale"), r(F.when(ok, F.col("ma") - F.col("mb") * ratio).otherwise(0.0)).alias("shift"))


@query("running_maxima", sql(f"SELECT file_id, {R('max(abs(x))')} AS radius, {R('coalesce(sum(y) / nullif(count(*) FILTER (y > 0), 0), 0)')} AS grad, count(*) FILTER (y > 0) AS seen FROM points GROUP BY file_id", "points"))
def running_maxima(spark: SparkSession, sf: str) -> DataFrame:
    """Greatest radius and mean gradient over the times seen."""
    seen = F.count_if(F.col("y") > 0)
    return points(spark, sf).groupBy("file_id").agg(r(F.max(F.abs("x"))).alias("radius"), r(F.coalesce(F.try_divide(F.sum("y"), seen), F.lit(0.0))).alias("grad"), seen.alias("seen"))


#: Cosine and sine of the views' turns about the vertical.
TURNS = ((1.0, 0.0), (0.96, 0.28), (0.936, 0.352), (0.8, 0.6))


def view_splats(spark: SparkSession, sf: str) -> DataFrame:
    """scene, view, pid, sx, sy, depth, radius, opacity, obj: each scene's Gaussians in views turned about the vertical; obj is the octant of the scene."""
    c, w = F.col, Window.partitionBy("file_id")
    octant = sum((F.when(c(a) > F.avg(a).over(w), 1 << i).otherwise(0) for i, a in enumerate("xyz")), F.lit(0))
    p = points(spark, sf).withColumn("obj", octant)
    views = F.explode(F.array(*[F.struct(F.lit(i).alias("view"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(TURNS)]))
    turned = p.withColumn("v", views).withColumn("tx", c("v.a") * c("x") - c("v.b") * c("z")).withColumn("tz", c("v.b") * c("x") + c("v.a") * c("z"))
    return turned.select(c("file_id").alias("scene"), c("v.view").cast("long").alias("view"), "pid", (16 + c("tx") * 40).alias("sx"), (16 + c("y") * 40).alias("sy"), (c("tz") + 3).alias("depth"), (1.5 + F.abs("e3") * 6).alias("radius"), (1 / (1 + F.exp(-c("e4") * 4))).alias("opacity"), "obj")


def instance_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(masks, alphas, weights, low): in each view a mask for each octant, of the pixels to which it gives most, and what the Gaussians give."""
    s, px = view_splats(spark, sf), (F.col("px") + 32 * F.col("py")).cast("long").alias("px")
    weights = cut(composited(s, keys=("scene", "view")).select("scene", "view", px, "pid", "obj", "w"))
    alphas = covered(s).select("scene", "view", px, "pid", "alpha")
    shares = weights.groupBy("scene", "view", "px", "obj").agg(F.sum("w").alias("w"))
    most = shares.groupBy("scene", "view", "px").agg(F.max(F.struct(F.round("w", 9).alias("w"), "obj")).alias("m")).filter("m.w > 0.2")
    masks = most.select("scene", "view", F.col("m.obj").cast("long").alias("mask"), "px")
    low = points(spark, sf).withColumn("mid", F.avg("z").over(Window.partitionBy("file_id"))).filter("z < mid").select(F.col("file_id").alias("scene"), "pid")
    return masks, alphas, weights, low


@query("instance_rounds")
def instance_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every mask of four views of each scene as the seed of an instance."""
    masks, alphas, weights, low = instance_inputs(spark, sf)
    return V.associated(masks, alphas, weights, low, 32, 0.3)[0]


@query("instance_labels")
def instance_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The instance of each Gaussian after all rounds."""
    masks, alphas, weights, low = instance_inputs(spark, sf)
    return V.associated(masks, alphas, weights, low, 32, 0.3)[1]
