"""Queries over names, arrays and sets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from .fixtures import R, boxes, frames, points, r, sql, table, truth
from .registry import query

NAMES = """, n AS (SELECT page_id, url, '/data/images/plot/images/FPWW036_SR0461_1_FIP2_cam_' || lpad((page_id % 15)::VARCHAR, 2, '0') || '_' || lpad((page_id % 7)::VARCHAR, 3, '0') || '.png' AS path FROM pages),
 m AS (SELECT *, regexp_extract(path, '([^/]*)\\.png$', 1) AS name FROM n)"""


def names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url")
    path = F.concat(F.lit("/data/images/plot/images/FPWW036_SR0461_1_FIP2_cam_"), X.padded(F.col("page_id") % 15, 2), F.lit("_"), X.padded(F.col("page_id") % 7, 3), F.lit(".png"))
    return p.withColumn("path", path).withColumn("name", F.regexp_extract("path", r"([^/]*)\.png$", 1))


@query("name_parts", sql(NAMES + """ SELECT page_id, coalesce(try_cast(regexp_extract(name, 'cam_(\\d+)', 1) AS BIGINT), 0) AS camera, CASE WHEN coalesce(try_cast(regexp_extract(name, 'cam_(\\d+)', 1) AS BIGINT), 0) <= 10 THEN 'train' ELSE 'test' END AS split,
 name[1:length(name)-4] AS image, right(name, 3)::BIGINT AS mask, array_to_string(list_filter(string_split(name, '_')[3:], lambda t: NOT starts_with(t, 'FIP')), '_') AS short, regexp_replace(path, '\\.(png|jpg)', '', 'g') AS stem,
 regexp_replace(regexp_replace(path, '^(.*)/images/', '\\1/labels/'), '\\.[^./]*$', '.txt') AS label_path FROM m"""))
def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Camera, split, image, mask number, short name and label file from file names."""
    n = F.col("name")
    return names(spark, sf).select("page_id", X.camera_id(n).alias("camera"), X.split_label(X.camera_id(n)).alias("split"), X.image_of_mask(n).alias("image"), X.index_of_mask(n).alias("mask"), X.short_name(n).alias("short"), X.without_extension(F.col("path")).alias("stem"), X.label_path(F.col("path")).alias("label_path"))


@query("url_parts", sql(""", c AS (SELECT page_id, url, regexp_replace(url, '[|@#!¡·$€%&()=?¿^*;:,¨´><+]', '_', 'g') AS clean FROM pages) SELECT page_id, clean, regexp_matches(url, '^[\\x00-\\x7F]*$') AS ascii, regexp_matches(url, '[\\x{4e00}-\\x{9fff}]') AS chinese,
 regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) AS file, CASE WHEN regexp_matches(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1), '^\\d+$') THEN try_cast(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) AS BIGINT) END AS number FROM c"""))
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned addresses, their character classes, file names and numbers."""
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.clean(u).alias("clean"), X.is_ascii(u).alias("ascii"), X.is_chinese(u).alias("chinese"), X.file_of_url(u).alias("file"), X.whole_number(X.file_of_url(u)).alias("number"))


@query("run_stamps", sql(""", f AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 5 = 0 THEN 'latest' ELSE strftime(o_orderdate, '%Y-%m-%d_%H%M%S') END AS folder FROM orders)
 SELECT o_orderkey, folder, CASE WHEN length(folder) = 17 AND folder[5] = '-' THEN strftime(try_strptime(folder, '%Y-%m-%d_%H%M%S'), '%d_%m_%Y_%H_%M_%S') END AS stamp FROM f"""))
def run_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Times in run folders' names, written as output stamps."""
    folder = F.when(F.col("o_orderkey") % 5 == 0, F.lit("latest")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd_HHmmss"))
    return table(spark, sf, "orders").select("o_orderkey", folder.alias("folder")).select("o_orderkey", "folder", F.date_format(X.run_stamp(F.col("folder")), "dd_MM_yyyy_HH_mm_ss").alias("stamp"))


@query("json_defaults", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(try_cast(json_extract_string(props, '$.missing') AS DOUBLE), -1.0::DOUBLE) AS missing FROM events")
def json_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in JSON, with a default where they are missing."""
    return table(spark, sf, "events").select("event_id", X.json_number(F.col("props"), "$.k").alias("k"), F.coalesce(X.json_number(F.col("props"), "$.missing"), F.lit(-1.0)).alias("missing"))


@query("class_map", sql(""", m AS (SELECT list(i ORDER BY i) AS a FROM (SELECT unnest(range(1, 92)) AS i) WHERE i NOT IN (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)) SELECT vec_id, a[label % 80 + 1]::BIGINT AS c FROM embeddings CROSS JOIN m"""))
def class_map(spark: SparkSession, sf: str) -> DataFrame:
    """80-class numbers to 91-class numbers."""
    return table(spark, sf, "embeddings").select("vec_id", X.class_91(F.col("label") % 80).cast("long").alias("c"))


@query("holdout_split", sql("""SELECT s_suppkey, CASE WHEN (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1) % 8 = 0 THEN 'test' ELSE 'train' END AS split FROM supplier"""))
def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every eighth name of a scene is held out."""
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_name")) - 1
    return table(spark, sf, "supplier").select("s_suppkey", F.when(n % 8 == 0, "test").otherwise("train").alias("split"))


@query("run_lengths", sql(""", px AS (SELECT image, x1::BIGINT AS px FROM boxes GROUP BY image, x1), g AS (SELECT *, px - row_number() OVER (PARTITION BY image ORDER BY px) AS g FROM px) SELECT image, min(px) AS start, count(*) AS length FROM g GROUP BY image, g""", "boxes"))
def run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Run-length encoding of each image's pixels."""
    px = boxes(spark, sf).select("image", F.col("x1").cast("long").alias("px"))
    g = px.withColumn("g", F.col("px") - F.dense_rank().over(Window.partitionBy("image").orderBy("px")))
    length = F.coalesce(F.max("px") - F.min("px") + 1, F.lit(1).cast("long"))
    return g.groupBy("image", "g").agg(F.min("px").alias("start"), length.alias("length")).drop("g")


@query("array_pack", sql(f"""SELECT image, box_id, (list_position([x1, y1, x2, y2], list_max([x1, y1, x2, y2])) - 1)::BIGINT AS top, {R('CASE WHEN conf <= 0.1 THEN 1 WHEN conf <= 0.3 THEN 1 + (5 - 1) * (conf - 0.1) / (0.3 - 0.1) WHEN conf <= 0.5 THEN 5 + (2 - 5) * (conf - 0.3) / (0.5 - 0.3) ELSE 2 END')} AS y,
 ['zero', 'one', 'two'][cls + 1] AS name, len(list_filter([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95], lambda t: conf * 2 > t + 0.001))::BIGINT AS past FROM boxes""", "boxes"))
def array_pack(spark: SparkSession, sf: str) -> DataFrame:
    """First greatest entry, linear interpolation, class names and thresholds passed."""
    c = F.col("conf")
    top = A.arg_max(F.array("x1", "y1", "x2", "y2"))
    y = A.interpolated(c, (0.1, 0.3, 0.5), (1.0, 5.0, 2.0))
    bars = F.transform(A.linspace(0.5, 0.95, 10), lambda t: F.round(t + 0.001, 9))  # the doubles of the decimals, which a confidence may equal
    name = F.element_at(F.create_map(*[F.lit(v) for i, n in enumerate(("zero", "one", "two")) for v in (i, n)]), F.col("cls").cast("int"))
    return boxes(spark, sf).select("image", "box_id", top.cast("long").alias("top"), r(y).alias("y"), name.alias("name"), F.size(F.filter(bars, lambda t: c * 2 > t)).cast("long").alias("past"))


@query("class_counts", sql("""SELECT c::BIGINT AS cls, count(b.cls) AS n, count(DISTINCT b.image) AS images FROM (SELECT unnest(range(0, 5)) AS c) s LEFT JOIN boxes b ON b.cls = s.c GROUP BY c""", "boxes"))
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes and images of each of five classes, those without any included."""
    spine = spark.range(5).withColumnRenamed("id", "cls")
    counted = boxes(spark, sf).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image").alias("images"))
    return spine.join(counted, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("images", F.lit(0)).alias("images"))


@query("grid_cells", sql(""", g AS (SELECT image, ceil(max(x2) / 64)::BIGINT AS nx, ceil(max(y2) / 64)::BIGINT AS ny FROM boxes GROUP BY image), h AS (SELECT *, unnest(range(0, nx)) AS gx FROM g)
 SELECT image, gx, unnest(range(0, ny)) AS gy, gx + nx * unnest(range(0, ny)) AS cell FROM h""", "boxes"))
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the grid that each image's boxes need, as rows."""
    up = lambda c: F.ceil(F.max(c) / 64)
    g = boxes(spark, sf).groupBy("image").agg(up("x2").alias("nx"), up("y2").alias("ny"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    return g.withColumn("gx", span("nx")).withColumn("gy", span("ny")).select("image", "gx", "gy", (F.col("gx") + F.col("nx") * F.col("gy")).alias("cell"))


@query("matrix_product", sql(f"""SELECT b.pid, p.k::BIGINT AS k, 1 / (1 + exp(-(b.x * p.a + b.y * p.b + b.z * p.c))) > 0.5 AS inside, {R('b.x * p.a + b.y * p.b + b.z * p.c')} AS v FROM points b CROSS JOIN (VALUES (0, 0.5::DOUBLE, -0.2::DOUBLE, 0.1::DOUBLE), (1, -0.3, 0.8, 0.4)) p(k, a, b, c)""", "points"))
def matrix_product(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients times prototypes, activated and cut at a half."""
    protos = F.array(*[F.array(*[F.lit(v) for v in row]) for row in ((0.5, -0.2, 0.1), (-0.3, 0.8, 0.4))])
    rows = points(spark, sf).select("pid", F.array("x", "y", "z").alias("c"), F.posexplode(protos).alias("k", "p"))
    v = F.aggregate(F.zip_with("c", "p", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.select("pid", F.col("k").cast("long").alias("k"), (1 / (1 + F.exp(-v)) > 0.5).alias("inside"), r(v).alias("v"))


@query("set_operations", sql("""SELECT 'union' AS op, image, box_id AS id FROM boxes WHERE cls = 0 UNION ALL SELECT 'union', image, gt_id FROM truth WHERE cls = 1
 UNION ALL SELECT 'distinct', image, cls FROM (SELECT DISTINCT image, cls FROM boxes) UNION ALL SELECT 'minus', image, cls FROM (SELECT DISTINCT image, cls FROM boxes EXCEPT SELECT image, cls FROM truth)
 UNION ALL SELECT 'both', image, cls FROM (SELECT image, cls FROM boxes INTERSECT SELECT image, cls FROM truth)""", "truth"))
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Union, distinct rows, difference and intersection."""
    b, t = boxes(spark, sf), truth(spark, sf)
    tag = lambda df, op, c: df.select(F.lit(op).alias("op"), "image", F.col(c).alias("id"))
    mine, theirs = b.select("image", "cls").distinct(), t.select("image", "cls").distinct()
    return tag(b.filter("cls = 0"), "union", "box_id").unionByName(tag(t.filter("cls = 1"), "union", "gt_id")).unionByName(tag(mine, "distinct", "cls")).unionByName(tag(mine.join(theirs, ["image", "cls"], "left_anti"), "minus", "cls")).unionByName(tag(mine.join(theirs, ["image", "cls"], "left_semi"), "both", "cls"))


@query("join_kinds", sql("""SELECT 'left' AS kind, c.c_custkey AS id, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey
 UNION ALL SELECT 'anti', c_custkey, 0 FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) UNION ALL SELECT 'semi', c_custkey, 1 FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"""))
def join_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Images with their label files: all with counts, those without, those with."""
    c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    counted = o.groupBy("id").count()
    left = c.join(counted, "id", "left").select(F.lit("left").alias("kind"), "id", F.coalesce("count", F.lit(0)).alias("n"))
    anti = c.join(o, "id", "left_anti").select(F.lit("anti").alias("kind"), "id", F.lit(0).cast("long").alias("n"))
    return left.unionByName(anti).unionByName(c.join(o, "id", "left_semi").select(F.lit("semi").alias("kind"), "id", F.lit(1).cast("long").alias("n")))


@query("frame_stride", sql("SELECT source, frame, event_id FROM frames WHERE frame % 3 = 0", "frames"))
def frame_stride(spark: SparkSession, sf: str) -> DataFrame:
    """Every third frame of each source."""
    return frames(spark, sf).filter("frame % 3 = 0").select("source", "frame", "event_id")


@query("latest_frame", sql("SELECT source, max(frame) AS frame, arg_max(event_id, frame) AS event_id FROM frames GROUP BY source", "frames"))
def latest_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The newest frame of each source."""
    return frames(spark, sf).groupBy("source").agg(F.max(F.struct("frame", "event_id")).alias("last")).select("source", "last.frame", "last.event_id")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, (floor(sum(value) * 100 + 0.5) / 100)::DOUBLE AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling daily windows."""
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.sum("value") * 100 + 0.5) / 100).alias("total"))
    return e.select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("event_sessions", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (
 SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end after two hours without an event."""
    return table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


@query("ema_fold", sql(f""", s AS (SELECT source, list(value ORDER BY frame) AS v FROM frames GROUP BY source) SELECT source, {R('list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, x: 0.4::DOUBLE * x + 0.6::DOUBLE * a)')} AS ema FROM s""", "frames"))
def ema_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential moving average of each source's values."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"])
    return frames(spark, sf).groupBy("source").agg(values.alias("v")).select("source", r(A.ema(F.col("v"))).alias("ema"))


@query("smooth_box", sql(f"SELECT source, frame, {R('avg(value) OVER (PARTITION BY source ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS smooth, {R('value - lag(value) OVER (PARTITION BY source ORDER BY frame)')} AS step FROM frames", "frames"))
def smooth_box(spark: SparkSession, sf: str) -> DataFrame:
    """Moving mean and differences along each source."""
    w = Window.partitionBy("source").orderBy("frame")
    return frames(spark, sf).select("source", "frame", r(F.avg("value").over(w.rowsBetween(-2, 2))).alias("smooth"), r(F.col("value") - F.lag("value").over(w)).alias("step"))


@query("early_stopping", sql("""SELECT source, frame, coalesce(max(value) OVER (PARTITION BY source ORDER BY frame ROWS UNBOUNDED PRECEDING) = value, false) AS best, frame - max(CASE WHEN value = best THEN frame END) OVER (PARTITION BY source ORDER BY frame ROWS UNBOUNDED PRECEDING) >= 5 AS stop FROM (
 SELECT *, max(value) OVER (PARTITION BY source ORDER BY frame ROWS UNBOUNDED PRECEDING) AS best FROM frames)""", "frames"))
def early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with the best value so far, and whether that is five or more frames ago."""
    w = Window.partitionBy("source").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    f = frames(spark, sf).withColumn("top", F.max("value").over(w)).withColumn("at", F.when(F.col("value") == F.col("top"), F.col("frame")))
    return f.select("source", "frame", (F.col("top") == F.col("value")).alias("best"), (F.col("frame") - F.max("at").over(w) >= 5).alias("stop"))


@query("deterministic_sample")
def deterministic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Five points of each file in an order by hash, and a split and rank by hash."""
    n = F.row_number().over(Window.partitionBy("file_id").orderBy(F.xxhash64("pid", F.lit(7)), "pid"))
    u = F.pmod(F.xxhash64("pid", F.lit(11)), F.lit(1000))
    split = F.when(u < 900, "train").otherwise("val")
    return points(spark, sf).select("file_id", "pid", n.alias("n"), split.alias("split"), F.pmod(n, F.lit(4)).alias("worker"), (-F.ln((u + 1) / 1001.0) / (1 + F.abs("x"))).alias("weighted_key")).filter("n <= 5")
