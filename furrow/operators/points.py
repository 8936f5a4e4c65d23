"""Point clouds: neighbours, outliers, clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import components

XYZ = ("x", "y", "z")
#: Points of a cloud up to which its neighbours are searched in one cell.
SMALL = 256


def _celled(points: DataFrame, side: Column) -> DataFrame:
    return points.withColumns({"c" + c: F.floor((F.col(c) - F.col(c + "0")) / side).cast("long") for c in XYZ})


def _around(points: DataFrame, alone: Column | None = None) -> DataFrame:
    """Each point once for each of the 27 cells around its own, which becomes its cell; where alone is true, once for its own."""
    steps = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    if alone is not None:
        steps = F.when(alone, F.array(F.lit(0).cast("long"))).otherwise(steps)
    for c in XYZ:
        points = points.withColumn("step", F.explode(steps)).withColumn("c" + c, F.col("c" + c) + F.col("step")).drop("step")
    return points


def _distance(a: str = "", b: str = "o") -> Column:
    return F.sqrt(sum(((F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in XYZ), F.lit(0.0)))


#: Most points of a cell in one array.
CHUNK = 256


def _arrays(others: DataFrame, cell: list[str]) -> DataFrame:
    """cell, with its points (by, pid, x, y, z) in arrays of CHUNK at most, so that a crowded cell is no row of its own."""
    chunk = F.floor((F.row_number().over(Window.partitionBy(*cell).orderBy("pid")) - 1) / CHUNK)
    dealt = others.withColumn("chunk", chunk)
    return dealt.groupBy(*cell, "chunk").agg(F.collect_list(F.struct("pid", *XYZ)).alias("there")).drop("chunk")


def _nearest(own: DataFrame, there: DataFrame, cell: list[str], by: str, k: int, least: float | None, *more: str) -> DataFrame:
    """Of own points and the arrays of their cells the k nearest of each point: by, pid, near, an array of (d, other), far, the distance of the k-th, and more.

    A point takes k of each array and then k of those, so that no pair but these becomes a row or is sorted in a task.
    """
    xyz = lambda o: [F.col(c) - o[c] for c in XYZ]
    distance = lambda o: F.sqrt(sum((v * v for v in xyz(o)), F.lit(0.0)))
    pairs = F.transform(F.filter("there", lambda o: o["pid"] != F.col("pid")), lambda o: F.struct(distance(o).alias("d"), o["pid"].alias("other")))
    pairs = pairs if least is None else F.filter(pairs, lambda p: p["d"] >= least)
    some = own.join(there, cell).select(by, "pid", *more, F.slice(F.array_sort(pairs), 1, k).alias("near"))
    whole = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    found = some.filter(F.size("near") > 0).groupBy(by, "pid", *more).agg(whole.alias("near"))
    return found.select(by, "pid", "near", F.when(F.size("near") == k, F.get("near", F.lit(k - 1))["d"]).alias("far"), *more)


def _listed(found: DataFrame, by: str) -> DataFrame:
    """by, pid, other, d, n of the arrays of _nearest."""
    rows = found.select(by, "pid", F.posexplode("near").alias("n", "p"))
    return rows.select(by, "pid", F.col("p.other").alias("other"), F.col("p.d").alias("d"), (F.col("n") + 1).cast("long").alias("n"))


def neighbours(points: DataFrame, by: str, k: int, least: float | None = None) -> DataFrame:
    """(by, pid, other, d, n): the k nearest others of each point in its group, by distance, then pid.

    points has by, pid, x, y, z. Points are dealt to cells that hold a few times k points on
    average, a small cloud to one, and meet those of their own cell first. A point whose k-th
    neighbour is nearer than the walls of its cell is done. One whose k-th is farther meets the
    points of the cells that are that near, and is done then. One that has met fewer than k is
    searched for again in cells of twice the side, until a cell holds the whole cloud. With
    least, nearer points do not count.
    """
    key = ["x0", "y0", "z0"]
    ends = points.groupBy(by).agg(*[F.min(c).alias(c + "0") for c in XYZ], *[F.max(c).alias(c + "1") for c in XYZ], F.count(F.lit(1)).alias("size"))
    wide = F.greatest(*[F.col(c + "1") - F.col(c + "0") for c in XYZ])
    side = F.when(F.col("size") <= SMALL, wide).otherwise(wide * F.cbrt(F.lit(4.0 * (k + 1)) / F.col("size")))
    ends = cut(ends.select(by, *key, (wide * 1.0001 + 1e-12).alias("wide"), F.greatest(side * 1.0001 + 1e-12, wide * 1e-6).alias("side")))
    all_points = points.select(by, "pid", *XYZ).join(ends, by)
    cell = [by, "cx", "cy", "cz"]
    if ends.filter("side < wide").isEmpty():  # each cloud is a cell: nothing is left after the first search
        # so many parts are kept: few bytes make many pairs, which one task should not get
        own = points.select(by, "pid", *XYZ).repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
        return _listed(_nearest(own, _arrays(own, [by]), [by], by, k, least), by)
    all_points = cut(all_points)
    left, parts = all_points, []
    while True:
        others = cut(_arrays(_celled(all_points, F.col("side")).select(*cell, "pid", *XYZ), cell))
        walls = [F.least(at - F.col("c" + c) * F.col("side"), (F.col("c" + c) + 1) * F.col("side") - at) for c, at in ((c, F.col(c) - F.col(c + "0")) for c in XYZ)]
        own = _celled(left, F.col("side")).withColumn("room", F.when(F.col("side") >= F.col("wide"), math.inf).otherwise(F.least(*walls)))
        found = cut(_nearest(own, others, cell, by, k, least, "room"))
        whole = F.col("room") == math.inf
        parts.append(_listed(found.filter(whole | (F.col("far") <= F.col("room"))), by))
        far = cut(found.filter(~whole & (F.col("far") > F.col("room"))).select(by, "pid", "far"))
        if not far.isEmpty():
            near = left.join(far, [by, "pid"])
            for c in XYZ:
                low, high = (F.floor((F.col(c) - F.col(c + "0") + i * F.col("far")) / F.col("side")).cast("long") for i in (-1, 1))
                near = near.withColumn("c" + c, F.explode(F.sequence(low, high)))
            parts.append(_listed(_nearest(near.drop("far"), others, cell, by, k, least), by))
        short = left.filter(F.col("side") < F.col("wide")).join(found.filter("far is not null").select(by, "pid"), [by, "pid"], "left_anti")
        left = cut(short.withColumn("side", F.least(F.col("side") * 2, F.col("wide"))))
        if left.isEmpty():
            break
        all_points = all_points.withColumn("side", F.least(F.col("side") * 2, F.col("wide")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mean_neighbour_distance(points: DataFrame, by: str, k: int, squared: bool = False) -> DataFrame:
    """points with near: the mean (squared) distance to the k nearest others of the group, not a number where there are none."""
    d = F.col("d") * F.col("d") if squared else F.col("d")
    near = neighbours(points, by, k).groupBy(by, "pid").agg(F.avg(d).alias("near"))
    return points.join(near, [by, "pid"], "left").withColumn("near", F.coalesce("near", F.lit(math.nan)))


def without_outliers(points: DataFrame, by: str, k: int = 200, ratio: float = 3.0) -> DataFrame:
    """Points whose mean neighbour distance is under median + ratio * 1.4826 * MAD; groups of k or fewer stay."""
    near = mean_neighbour_distance(points, by, k)
    w = Window.partitionBy(by)
    centred = near.withColumn("mid", F.median("near").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    bound = centred.withColumn("mad", F.median(F.abs(F.col("near") - F.col("mid"))).over(w))
    return bound.filter((F.col("n") <= k) | (F.col("near") < F.col("mid") + ratio * 1.4826 * F.col("mad"))).drop("near", "mid", "n", "mad")


def clustered(points: DataFrame, by: str, eps: float, least: int) -> DataFrame:
    """points with cluster, by density within each group; -1 is noise.

    Cores have least points within eps, themselves included. Clusters are the components of
    cores in reach of each other, numbered by their first core's pid; a border point joins the
    least-numbered cluster of a core in reach. Points of one small cell are all in reach of each
    other: those of a full one are cores without looking further, and its cores are one node of the
    graph, so that links grow with the cells, not with the pairs. Other points meet in cells of
    side eps, those of a small cloud in one.
    """
    small = {"s" + c: F.floor(F.col(c) / (eps / math.sqrt(3) * 0.999)).cast("long") for c in XYZ}
    size = points.groupBy(by).agg((F.count(F.lit(1)) <= SMALL).alias("alone"))
    own = points.select(by, "pid", *XYZ).join(size, by)
    cells = cut(own.withColumns({"c" + c: F.when(F.col("alone"), F.lit(0).cast("long")).otherwise(F.floor(F.col(c) / eps).cast("long")) for c in XYZ} | small))
    cell, node = [by, "cx", "cy", "cz"], [by, "sx", "sy", "sz"]
    as_other = lambda df, *more: df.select(*cell, F.col("pid").alias("other"), *[F.col(c).alias("o" + c) for c in XYZ], *more)
    near = sum(((F.col(c) - F.col("o" + c)) * (F.col(c) - F.col("o" + c)) for c in XYZ), F.lit(0.0)) <= eps * eps
    reach = lambda a, b: _around(a, F.col("alone")).join(b, cell).filter(near)
    full = cells.groupBy(*node).count().filter(F.col("count") >= least).select(*node, F.lit(True).alias("full"))
    told = cells.join(full, node, "left")
    rest = told.filter("full is null").drop("full")
    more = reach(rest, as_other(cells)).groupBy(by, "pid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(by, "pid")
    cores = cut(told.filter("full").drop("full").unionByName(rest.join(more, [by, "pid"])))
    # a node is a small cell with cores, known by a number; its first core stands for it
    nodes = cut(cores.groupBy(*node).agg(F.min("pid").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    numbered = cut(cores.join(nodes.drop("first"), node))
    links = reach(numbered, as_other(numbered, F.col("node").alias("v"))).filter("node < v").select(F.col("node").alias("u"), "v").distinct()
    joined = components(links)
    rooted = nodes.join(joined, "node", "left").select(by, "node", "first", F.coalesce("component", "node").alias("root"))
    first = rooted.groupBy(by, "root").agg(F.min("first").alias("first"))
    number = (F.row_number().over(Window.partitionBy(by).orderBy("first")) - 1).cast("long")
    labels = rooted.join(first.select(by, "root", number.alias("cluster")), [by, "root"]).select("node", "cluster")
    labelled = cut(numbered.join(labels, "node"))
    loose = cells.join(labelled.select(by, "pid"), [by, "pid"], "left_anti")
    border = reach(loose, as_other(labelled, "cluster")).groupBy(by, "pid").agg(F.min("cluster").alias("cluster"))
    found = labelled.select(by, "pid", "cluster").unionByName(border.select(by, "pid", "cluster"))
    return points.join(found, [by, "pid"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))


def main_cluster(clusters: DataFrame, by: str) -> DataFrame:
    """Rows of each group's largest cluster; of equals the one with the least number, noise included."""
    counted = clusters.groupBy(by, "cluster").count()
    first = counted.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), "cluster"))).filter("n = 1").select(by, "cluster")
    return clusters.join(first, [by, "cluster"])
