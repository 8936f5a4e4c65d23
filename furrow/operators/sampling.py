"""Running sums, the last row before a place, and weighted draws, over ranges of an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def cumulated(rows: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str = "before") -> DataFrame:
    """rows with the sum of value over the rows before them within by, in an order that tells all rows apart.

    Ranges of the order are summed on their own and start from the sums of those before.
    """
    dealt = cut(rows.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(dealt.groupBy(*by, "part").agg(F.sum(value).alias("s")).select(*by, "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("start")))
    own = F.sum(value).over(Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return dealt.withColumn("own", own).join(starts, [*by, "part"]).withColumn(name, F.col("own") + F.col("start")).drop("own", "start", "part")


def last_before(places: DataFrame, items: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """places with item: the last of items (by, at, item) at or before each place in by, null where there is none.

    Both go through ranges of at together; a range takes over the last item of those before it.
    """
    put = [c for c in places.columns if c not in by]
    both = items.select(*by, F.col(at).alias("__at"), F.lit(0).alias("__kind"), "item", F.lit(None).cast(places.select(F.struct(*put)).schema[0].dataType).alias("__place"))
    both = both.unionByName(places.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.struct(*put).alias("__place")))
    dealt = cut(both.repartitionByRange(*[F.col(b) for b in by], "__at", "__kind").withColumn("part", F.spark_partition_id()))
    ends = dealt.filter("__kind = 0").groupBy(*by, "part").agg(F.max(F.struct("__at", "item")).alias("end"))
    parts = dealt.select(*by, "part").distinct().join(ends, [*by, "part"], "left")
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(parts.select(*by, "part", F.last("end.item", True).over(earlier).alias("carried")))
    own = F.last("item", True).over(Window.partitionBy(*by, "part").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("own", own).filter("__kind = 1").join(carried, [*by, "part"]).select(*by, "__place.*", F.coalesce("own", "carried").alias("item"))


def weighted_draws(items: DataFrame, draws: DataFrame, by: Sequence[str], item: str, weight: str) -> DataFrame:
    """(by, draw, item): for each draw (by, draw, share), share from 0 to under 1, an item by its weight, a whole number; items may be drawn again.

    Items lie one after the other in order, each as long as its weight, and a draw falls at its
    share of the whole.
    """
    some = items.filter(F.col(weight) > 0)
    laid = cumulated(some.select(*by, item, weight), by, [F.col(item)], weight)
    totals = some.groupBy(*by).agg(F.sum(weight).alias("total"))
    places = draws.join(totals, list(by)).select(*by, "draw", F.floor(F.col("share") * F.col("total")).alias("before"))
    found = last_before(places, laid.select(*by, "before", F.col(item).alias("item")), by, "before")
    return found.select(*by, "draw", F.col("item").alias(item))
