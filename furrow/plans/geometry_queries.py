"""Queries over points and cameras in space."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from .fixtures import R, points, r, sql
from .registry import query

QSQL = """, q AS (SELECT *, sqrt((e3+0.5)^2 + e4^2 + e5^2 + e6^2) AS qn FROM points), u AS (SELECT *, (e3+0.5)/qn AS qw, e4/qn AS qx, e5/qn AS qy, e6/qn AS qz FROM q),
 m AS (SELECT *, 1-2*(qy*qy+qz*qz) AS m00, 2*(qx*qy-qw*qz) AS m01, 2*(qx*qz+qw*qy) AS m02, 2*(qx*qy+qw*qz) AS m10, 1-2*(qx*qx+qz*qz) AS m11, 2*(qy*qz-qw*qx) AS m12,
 2*(qx*qz-qw*qy) AS m20, 2*(qy*qz+qw*qx) AS m21, 1-2*(qx*qx+qy*qy) AS m22 FROM u)"""


def cols(*names: str) -> list:
    return [F.col(n) for n in names]


def quat() -> list:
    return cols("qw", "qx", "qy", "qz")


def matrix() -> list:
    return [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]


def turned(spark: SparkSession, sf: str) -> DataFrame:
    """points with unit quaternions qw to qz and their matrices m00 to m22, one step after the other."""
    u = G.unit([F.col("e3") + 0.5, *cols("e4", "e5", "e6")])
    own = points(spark, sf).select("*", *[c.alias(n) for n, c in zip(("qw", "qx", "qy", "qz"), u, strict=True)])
    names = [f"m{i}{j}" for i in range(3) for j in range(3)]
    return own.select("*", G.let(quat(), names, lambda q: [c for row in G.rotation(q) for c in row]).alias("m")).select("*", "m.*").drop("m")


@query("camera_pose", sql(QSQL + f""" SELECT pid, {R('m00')} AS m00, {R('m12')} AS m12, {R('m20')} AS m20, {R('-(m00*x + m10*y + m20*z)')} AS cx, {R('-(m01*x + m11*y + m21*z)')} AS cy, {R('-(m02*x + m12*y + m22*z)')} AS cz,
 {R('abs(qw)')} AS w_back, {R('qx * CASE WHEN qw < 0 THEN -1 ELSE 1 END')} AS x_back FROM m""", "points"))
def camera_pose(spark: SparkSession, sf: str) -> DataFrame:
    """Rotation matrices of quaternions, camera centres, and quaternions of the matrices."""
    m = matrix()
    c, back = G.camera_centre(m, cols("x", "y", "z")), G.quaternion(m)
    return turned(spark, sf).select("pid", r(m[0][0]).alias("m00"), r(m[1][2]).alias("m12"), r(m[2][0]).alias("m20"), r(c[0]).alias("cx"), r(c[1]).alias("cy"), r(c[2]).alias("cz"), r(back[0]).alias("w_back"), r(back[1]).alias("x_back"))


P = G.projection_matrix(0.01, 100.0, 1.0, 0.8)


@query("project_points", sql(f""", v AS (SELECT pid, x, y, z + 3 AS z FROM points) SELECT pid, {R(f'(({P[0][0]!r}::DOUBLE * x / (z + 1e-7) + 1) * 640 - 1) * 0.5')} AS px, {R(f'(({P[1][1]!r}::DOUBLE * y / (z + 1e-7) + 1) * 480 - 1) * 0.5')} AS py,
 {R(f'({P[2][2]!r}::DOUBLE * z + {P[2][3]!r}::DOUBLE) / (z + 1e-7)')} AS depth, {R('640 / (2 * tan((1 + x / 10) / 2))')} AS focal, {R('2 * atan(640 / (2 * (500 + y)))')} AS fov, z > 2.5 AS in_front FROM v""", "points"))
def project_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points to pixels through a projection matrix; field of view and focal length; what is in front."""
    v = points(spark, sf).select("pid", "x", "y", (F.col("z") + 3).alias("z"))
    p = G.projected(P, cols("x", "y", "z"))
    return v.select("pid", r(G.ndc_to_pixel(p[0], 640.0)).alias("px"), r(G.ndc_to_pixel(p[1], 480.0)).alias("py"), r(p[2]).alias("depth"), r(G.focal_of_fov(1 + F.col("x") / 10, 640)).alias("focal"), r(G.fov_of_focal(500 + F.col("y"), 640)).alias("fov"), (F.col("z") > 2.5).alias("in_front"))


SQL_COV = QSQL + """, s AS (SELECT *, exp(e7) AS s0, exp(e8) AS s1, exp(x) AS s2, z + 3 AS vz FROM m), c AS (SELECT *,
 m00*m00*s0*s0 + m01*m01*s1*s1 + m02*m02*s2*s2 AS xx, m00*m10*s0*s0 + m01*m11*s1*s1 + m02*m12*s2*s2 AS xy, m00*m20*s0*s0 + m01*m21*s1*s1 + m02*m22*s2*s2 AS xz,
 m10*m10*s0*s0 + m11*m11*s1*s1 + m12*m12*s2*s2 AS yy, m10*m20*s0*s0 + m11*m21*s1*s1 + m12*m22*s2*s2 AS yz, m20*m20*s0*s0 + m21*m21*s1*s1 + m22*m22*s2*s2 AS zz FROM s),
 j AS (SELECT *, 50.0 / vz AS fz, -50.0 * greatest(-0.65, least(0.65, x / vz)) * vz / (vz * vz) AS jx, -50.0 * greatest(-0.65, least(0.65, y / vz)) * vz / (vz * vz) AS jy FROM c),
 k AS (SELECT *, fz*fz*xx + 2*fz*jx*xz + jx*jx*zz + 0.3 AS a, fz*fz*xy + fz*jy*xz + jx*fz*yz + jx*jy*zz AS b, fz*fz*yy + 2*fz*jy*yz + jy*jy*zz + 0.3 AS c FROM j)"""


@query("splat_covariance", sql(SQL_COV + f""" SELECT pid, {R('xx')} AS xx, {R('xy')} AS xy, {R('zz')} AS zz, {R('a')} AS a, {R('b')} AS b, {R('c')} AS c,
 {R('ceil(3 * sqrt((a+c)*0.5 + sqrt(greatest(0.1, ((a+c)*0.5)^2 - (a*c-b*b)))) - 1e-9)')} AS radius FROM k WHERE a*c - b*b <> 0""", "points"))
def splat_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """Covariance of Gaussians in space and on screen, and their radius."""
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    scale = [F.exp("e7"), F.exp("e8"), F.exp("x")]
    flat_m = [F.col(f"m{i}{j}") for i in range(3) for j in range(3)]
    cov = G.let(scale + flat_m, names, lambda v: G.covariance(v[:3], [v[3:6], v[6:9], v[9:12]]))
    solid = turned(spark, sf).select("pid", "x", "y", (F.col("z") + 3).alias("z"), cov.alias("cov"))
    flat = G.let(cols("x", "y", "z", *(f"cov.{n}" for n in names)), ("a", "b", "c"), lambda v: G.covariance_2d(v[:3], v[3:], 50.0, 0.5))
    got = solid.select("pid", "cov", flat.alias("flat")).select("pid", "cov.*", "flat.*")
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    mid = (F.col("a") + F.col("c")) * 0.5
    radius = F.ceil(3 * F.sqrt(mid + F.sqrt(F.greatest(F.lit(0.1), mid * mid - det))) - 1e-9)
    return got.filter(det != 0).select("pid", *[r(F.col(n)).alias(n) for n in ("xx", "xy", "zz", "a", "b", "c")], r(radius).alias("radius"))


@query("point_colours", sql(f""", n AS (SELECT *, sqrt(x*x + y*y + z*z) AS d FROM points), u AS (SELECT pid, x/d AS dx, y/d AS dy, z/d AS dz, x, y, z, e3, e4, e5, e6, e7, e8 FROM n)
 SELECT pid, {R('greatest(0, x*0.28209479177387814 - y*0.4886025119029199*dy + z*0.4886025119029199*dz - e3*0.4886025119029199*dx + e4*1.0925484305920792*dx*dy - e5*1.0925484305920792*dy*dz + e6*0.31539156525252005*(2*dz*dz-dx*dx-dy*dy) - e7*1.0925484305920792*dx*dz + e8*0.5462742152960396*(dx*dx-dy*dy) + 0.5)')} AS colour,
 {R('1/(1+exp(-e3))')} AS opacity, {R('ln(0.3::DOUBLE / 0.7 + abs(e4))')} AS raw, {R('exp(1e-4 * pid)')} AS scale FROM u""", "points"))
def point_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Colours by spherical harmonics of degree 2, and activations."""
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    colour = G.harmonics(cols("x", "y", "z", "e3", "e4", "e5", "e6", "e7", "e8"), [F.col(c) / d for c in "xyz"])
    odds = F.lit(0.3) / 0.7 + F.abs("e4")
    return points(spark, sf).select("pid", r(colour).alias("colour"), r(G.sigmoid(F.col("e3"))).alias("opacity"), r(G.logit(odds / (1 + odds))).alias("raw"), r(F.exp(F.col("pid") * 1e-4)).alias("scale"))


def _spread(v: str) -> str:
    for shift, mask in ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249)):
        v = f"(({v} | ({v} << {shift})) & {mask})"
    return v


@query("morton_codes", sql(f""", b AS (SELECT pid, least(1023, greatest(0, floor((x + 4) * 128)))::BIGINT AS a, least(1023, greatest(0, floor((y + 4) * 128)))::BIGINT AS b, least(1023, greatest(0, floor((z + 4) * 128)))::BIGINT AS c FROM points),
 s1 AS (SELECT pid, {_spread('a')} AS a, {_spread('b')} AS b, {_spread('c')} AS c FROM b) SELECT pid, a | (b << 1) | (c << 2) AS code FROM s1""", "points"))
def morton_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Interleaved codes of coordinates of ten bits."""
    bits = [F.least(F.lit(1023), F.greatest(F.lit(0), F.floor((F.col(c) + 4) * 128))).cast("long") for c in "xyz"]
    return points(spark, sf).select("pid", G.morton(*bits).alias("code"))


@query("id_colours", sql(""", h AS (SELECT pid, pid * 1.6180339887::DOUBLE - floor(pid * 1.6180339887::DOUBLE) AS hue, 0.5::DOUBLE + 0.5::DOUBLE * (pid % 2) AS s FROM points), x AS (
 SELECT pid, s, floor(hue * 6)::INT AS k, s * (1 - abs((hue * 6) % 2 - 1)) AS x, 0.5::DOUBLE - s / 2 AS low FROM h)
 SELECT pid, CASE WHEN pid = 0 THEN 0 ELSE floor(([s, x, 0.0, 0.0, x, s][k+1] + low) * 255)::BIGINT END AS red, CASE WHEN pid = 0 THEN 0 ELSE floor(([x, s, s, x, 0.0, 0.0][k+1] + low) * 255)::BIGINT END AS green,
 CASE WHEN pid = 0 THEN 0 ELSE floor(([0.0, 0.0, x, s, s, x][k+1] + low) * 255)::BIGINT END AS blue FROM x""", "points"))
def id_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Colours of instance ids."""
    return points(spark, sf).select("pid", *[c.alias(n) for c, n in zip(G.id_colour(F.col("pid")), ("red", "green", "blue"), strict=True)])


@query("learning_rates", sql(f"""SELECT pid, {R(f'exp({math.log(0.01)!r}::DOUBLE * (1 - least(pid / 400.0::DOUBLE, 1)) + {math.log(0.0001)!r}::DOUBLE * least(pid / 400.0::DOUBLE, 1)) * (0.1 + 0.9 * sin(0.5 * pi() * least(pid / 100.0::DOUBLE, 1))) * 1000')} AS rate FROM points""", "points"))
def learning_rates(spark: SparkSession, sf: str) -> DataFrame:
    """A log-linear schedule with a slow start."""
    return points(spark, sf).select("pid", r(G.exponential_rate(F.col("pid"), 0.01, 0.0001, 100, 0.1, 400) * 1000).alias("rate"))


@query("orbit_path", sql(f""", c AS (SELECT file_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY file_id), e AS (SELECT file_id, cx, cy, cz, max(sqrt((x-cx)^2 + (y-cy)^2 + (z-cz)^2)) * 1.1 AS far FROM points JOIN c USING (file_id) GROUP BY ALL), s AS (SELECT *, unnest(range(0, 60)) AS i FROM e)
 SELECT file_id, i, {R('cx + far * cos(radians(20)) * cos(2 * pi() * i / 59)')} AS x, {R('cy + far * cos(radians(20)) * sin(2 * pi() * i / 59)')} AS y, {R('cz + far * sin(radians(20))')} AS z FROM s""", "points"))
def orbit_path(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras on a circle around each scene at a fixed elevation, as far out as its extent, both ends included."""
    p, e = points(spark, sf), math.radians(20)
    c = p.groupBy("file_id").agg(*[F.avg(a).alias("c" + a) for a in "xyz"])
    gap = F.sqrt(sum(((F.col(a) - F.col("c" + a)) * (F.col(a) - F.col("c" + a)) for a in "xyz"), F.lit(0.0)))
    far = p.join(c, "file_id").groupBy("file_id", "cx", "cy", "cz").agg((F.max(gap) * 1.1).alias("far"))
    at = far.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))))
    a = 2 * math.pi * F.col("i") / 59
    return at.select("file_id", "i", r(F.col("cx") + F.col("far") * math.cos(e) * F.cos(a)).alias("x"), r(F.col("cy") + F.col("far") * math.cos(e) * F.sin(a)).alias("y"), r(F.col("cz") + F.col("far") * math.sin(e)).alias("z"))


@query("view_interpolation", sql(QSQL + f""", v AS (SELECT pid, qw, qx, qy, qz, CASE WHEN qw < 0 THEN -1 ELSE 1 END AS sg, acos(least(abs(qw), 1)) AS an FROM m), t AS (SELECT *, CASE WHEN sin(an) < 1e-6 THEN 0.7 ELSE sin(0.7*an)/sin(an) END AS wa, CASE WHEN sin(an) < 1e-6 THEN 0.3 ELSE sin(0.3*an)/sin(an) END * sg AS wb FROM v)
 SELECT pid, {R('wa + wb*qw')} AS w, {R('wb*qx')} AS x FROM t""", "points"))
def view_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """Quaternions three tenths of the way from no rotation to a view."""
    got = G.slerp([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], quat(), F.lit(0.3))
    return turned(spark, sf).select("pid", r(got[0]).alias("w"), r(got[1]).alias("x"))


BOX = QSQL + """, o AS (SELECT x AS cx, y AS cy, z AS cz, m.* EXCLUDE (x, y, z) FROM m WHERE pid = (SELECT min(pid) FROM points))"""


@query("points_in_boxes", sql(BOX + """, d AS (SELECT p.pid, p.x - o.cx AS dx, p.y - o.cy AS dy, p.z - o.cz AS dz, o.* EXCLUDE (pid, cx, cy, cz) FROM points p CROSS JOIN o)
 SELECT pid, abs(dx) <= 0.3 AND abs(dy) <= 0.3 AND abs(dz) <= 0.3 AS in_aabb, abs(dx*m00 + dy*m10 + dz*m20) <= 0.4 AND abs(dx*m01 + dy*m11 + dz*m21) <= 0.3 AND abs(dx*m02 + dy*m12 + dz*m22) <= 0.2 AS in_obb FROM d""", "points"))
def points_in_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Points inside an axis-aligned and an oriented box around the first point."""
    p = points(spark, sf)
    first = turned(spark, sf).orderBy("pid").limit(1).select(*[F.col(c).alias("c" + c) for c in "xyz"], *[F.col(f"m{i}{j}") for i in range(3) for j in range(3)])
    d = [F.col(c) - F.col("c" + c) for c in "xyz"]
    local = [sum((d[i] * F.col(f"m{i}{j}") for i in range(3)), F.lit(0.0)) for j in range(3)]
    inside = lambda v, half: (F.abs(v[0]) <= half[0]) & (F.abs(v[1]) <= half[1]) & (F.abs(v[2]) <= half[2])
    return p.crossJoin(F.broadcast(first)).select("pid", inside(d, (0.3, 0.3, 0.3)).alias("in_aabb"), inside(local, (0.4, 0.3, 0.2)).alias("in_obb"))


@query("oriented_corners", sql(QSQL + f""", k AS (SELECT *, unnest([0,1,2,3,4,5,6,7]) AS k FROM m), h AS (SELECT *, (CASE WHEN k % 2 = 1 THEN 0.5 ELSE -0.5 END) * 2.0::DOUBLE AS hx, (CASE WHEN (k // 2) % 2 = 1 THEN 0.5 ELSE -0.5 END) * 1.0::DOUBLE AS hy, (CASE WHEN k // 4 = 1 THEN 0.5 ELSE -0.5 END) * 3.0::DOUBLE AS hz FROM k)
 SELECT pid, k::BIGINT AS k, {R('x + m00*hx + m01*hy + m02*hz')} AS cx, {R('y + m10*hx + m11*hy + m12*hz')} AS cy, {R('z + m20*hx + m21*hy + m22*hz')} AS cz, 6.0::DOUBLE AS volume, {R('(2+0.2)*(1+0.4)*(3+0.6)')} AS buffered FROM h""", "points"))
def oriented_corners(spark: SparkSession, sf: str) -> DataFrame:
    """Eight corners of oriented boxes, their volume, and that with a buffer on each side."""
    e = (2.0, 1.0, 3.0)
    corners = G.oriented_corners(cols("x", "y", "z"), [F.lit(v) for v in e], matrix())
    rows = turned(spark, sf).select("pid", F.posexplode(F.array(*[F.struct(*[c.alias("c" + n) for c, n in zip(k, "xyz", strict=True)]) for k in corners])).alias("k", "c"))
    size, grown = F.array(*[F.lit(v) for v in e]), F.zip_with(F.array(*[F.lit(v) for v in e]), F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)), lambda a, b: a + 2 * b)
    product = lambda a: F.aggregate(a, F.lit(1.0), lambda x, y: x * y)
    return rows.select("pid", F.col("k").cast("long").alias("k"), *[r(F.col(f"c.c{n}")).alias("c" + n) for n in "xyz"], product(size).alias("volume"), r(product(grown)).alias("buffered"))
