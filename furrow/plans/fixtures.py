"""Views of the engine's tables over the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column) -> Column:
    """To six decimals, halves up, in the same double arithmetic as R."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def R(x: str) -> str:
    return f"(floor(({x})::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, box_id (its index in the image), x1, y1, x2, y2, conf, cls, flag, from lineitem."""
    # only what the rest follows from is dealt by image
    line = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("image"), "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
    index = F.row_number().over(Window.partitionBy("image").orderBy("l_orderkey", "l_partkey", "l_extendedprice")) - 1
    x1, y1 = ((F.col(c) % n).cast("double") for c, n in (("l_partkey", 500), ("l_orderkey", 400)))
    return line.withColumn("box_id", index.cast("long")).select(
        "image", "box_id", x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity")).alias("x2"), (y1 + (F.col("l_quantity") * 0.5 + 5)).alias("y2"),
        (F.col("l_extendedprice") / 200000).alias("conf"), (F.col("l_partkey") % 3).alias("cls"), F.col("l_returnflag").alias("flag"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of flag R, moved a little, as ground truth: image, gt_id, x1, y1, x2, y2, cls."""
    return moved(boxes(spark, sf_dir))


def moved_box() -> dict[str, Column]:
    """The columns of a box's truth, but for image and class."""
    dx, dy = (F.col("box_id") % 5).cast("double"), (F.col("box_id") % 4).cast("double")
    return {"gt_id": F.col("box_id"), "x1": F.col("x1") + dx, "y1": F.col("y1") + dy, "x2": F.col("x2") + dx, "y2": F.col("y2") + dy}


def moved(b: DataFrame) -> DataFrame:
    """truth of given boxes."""
    return b.filter("flag = 'R'").select("image", *[c.alias(n) for n, c in moved_box().items()], "cls")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, pid, x, y, z and more coordinates e3 to e8, from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    dims = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "e3", "e4", "e5", "e6", "e7", "e8"))]
    return e.select(F.col("label").cast("long").alias("file_id"), F.col("vec_id").alias("pid"), *dims)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, x, y, e: each embedding as an image of eight by eight."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("k", "e"))
    return e.select("image", (F.col("k") % 8).cast("long").alias("x"), F.floor(F.col("k") / 8).alias("y"), F.col("e").cast("double").alias("e"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, method, run, stamp, metric, from orders."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("grp"), F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("stamp"), F.col("o_totalprice").alias("metric"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, ts, event_id, frame (from 0 by source), value, kind, from events."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "ts", "event_id", n.cast("long").alias("frame"), "value", F.col("event_type").alias("kind"), "props")


VIEWS = {
    "boxes": """SELECT image, box_id, x1, y1, x1 + w AS x2, y1 + h AS y2, conf, cls, flag FROM (
      SELECT l_suppkey * 10 + l_linenumber AS image,
             row_number() OVER (PARTITION BY l_suppkey * 10 + l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) - 1 AS box_id,
             (l_partkey % 500)::DOUBLE AS x1, (l_orderkey % 400)::DOUBLE AS y1, l_quantity AS w, l_quantity * 0.5 + 5 AS h,
             l_extendedprice / 200000 AS conf, l_partkey % 3 AS cls, l_returnflag AS flag FROM lineitem)""",
    "truth": """SELECT image, box_id AS gt_id, x1 + box_id % 5 AS x1, y1 + box_id % 4 AS y1, x2 + box_id % 5 AS x2, y2 + box_id % 4 AS y2, cls
      FROM boxes WHERE flag = 'R'""",
    "points": """SELECT label::BIGINT AS file_id, vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
      embedding[4]::DOUBLE AS e3, embedding[5]::DOUBLE AS e4, embedding[6]::DOUBLE AS e5, embedding[7]::DOUBLE AS e6, embedding[8]::DOUBLE AS e7,
      embedding[9]::DOUBLE AS e8 FROM embeddings""",
    "pixels": "SELECT vec_id AS image, k % 8 AS x, k // 8 AS y, embedding[k + 1]::DOUBLE AS e FROM embeddings, (SELECT unnest(range(0, 64)) AS k)",
    "runs": "SELECT o_custkey % 50 AS grp, o_orderpriority AS method, o_orderkey AS run, o_orderdate AS stamp, o_totalprice AS metric FROM orders",
    "frames": """SELECT user_id AS source, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value,
      event_type AS kind, props FROM events""",
}
NEEDS = {"truth": ("boxes",)}


def sql(body: str, *views: str) -> str:
    """A query over some of the views; body may start with further common table expressions (", name AS (...)")."""
    wanted: list[str] = []
    for v in views:
        wanted += [n for n in (*NEEDS.get(v, ()), v) if n not in wanted]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    if not head:
        return ("WITH RECURSIVE " + body.lstrip(", ")) if body.startswith(",") else body
    return f"WITH RECURSIVE {head} {body}"
