"""Precision, recall and average precision of scored matches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written

EPS = 1e-16


def dealt(rows: DataFrame, *order: Column) -> DataFrame:
    """rows written once in ranges of an order, with the number of its range in a column part."""
    return cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def curve(scored: DataFrame, totals: DataFrame, by: list[str], n: int) -> DataFrame:
    """Running hits at n thresholds in order of falling confidence: by, part, rank, tps (an array), n_true.

    scored has by, conf, tie and hits (a bit for each threshold); totals has n_true and some or all
    of by. Rows are dealt to ranges of by and confidence, summed in each, and each range starts
    from the sums of those before it, so that no task holds a whole class.
    """
    order = [F.desc("conf"), F.col("tie")]
    rows = dealt(scored.select(*by, "conf", "tie", "hits"), *by, *order)
    hit = [F.shiftright("hits", i).bitwiseAND(1) for i in range(n)]
    sums = rows.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(h).alias(f"s{i}") for i, h in enumerate(hit)])
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("rows", *(f"s{i}" for i in range(n)))]
    starts = sums.select(*by, "part", before[0].alias("rank0"), *[c.alias(f"s{i}") for i, c in enumerate(before[1:])])
    starts = cut(starts.join(totals, [c for c in by if c in totals.columns]))
    so_far = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts, [*by, "part"])
    rank, tps = F.row_number().over(so_far) + F.col("rank0"), [F.sum(h).over(so_far) + F.col(f"s{i}") for i, h in enumerate(hit)]
    return placed.select(*by, "part", rank.alias("rank"), F.array(*tps).alias("tps"), "n_true")


def precision(tps: Column) -> Column:
    return tps / F.col("rank")


def recall(tps: Column) -> Column:
    return tps / (F.col("n_true") + EPS)


def envelope(curves: DataFrame, by: list[str], n: int) -> DataFrame:
    """A row for each rank and threshold, whose place is in k: by, rank, k, tps, precision, recall, envelope.

    The envelope is the precision made non-increasing in rank: that of the same range from behind, or of
    a later range. A rank is one row with its n thresholds until all is worked out.
    """
    at = [precision(F.col("tps")[i]) for i in range(n)]
    tops = curves.groupBy(*by, "part").agg(*[F.max(p).alias(f"t{i}") for i, p in enumerate(at)])
    later = Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    after = cut(tops.select(*by, "part", *[F.max(f"t{i}").over(later).alias(f"t{i}") for i in range(n)]))
    back = Window.partitionBy(*by, "part").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    own = curves.join(after, [*by, "part"]).withColumn("env", F.array(*[F.greatest(F.max(p).over(back), F.col(f"t{i}")) for i, p in enumerate(at)]))
    rows = own.select(*by, "rank", "n_true", F.posexplode(F.arrays_zip("tps", "env")).alias("k", "z"))
    rows = rows.select(*by, "rank", "k", "n_true", F.col("z.tps").alias("tps"), F.col("z.env").alias("envelope"))
    return rows.withColumn("precision", precision(F.col("tps"))).withColumn("recall", recall(F.col("tps")))


#: Most rows of a block.
BLOCK = 16_384


def blocks(scored: DataFrame, by: list[str], n: int) -> DataFrame:
    """Hits at n thresholds in order of falling confidence, in rows of many: by, part, block, rows, hits (an array), sums.

    scored has by, conf, tie and hits (a bit for each threshold). Rows are dealt to ranges of by and confidence and sorted there
    once; after that only their bits are kept, a few bytes for a row, and a block of one class is a row of its own, which later steps
    take one at a time.
    """
    order, kinds = [F.desc("conf"), F.col("tie")], dict(scored.dtypes)
    rows = scored.select(*by, "conf", "tie", "hits").repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            changes = np.zeros(batch.num_rows, bool)
            changes[::BLOCK] = True
            for c in by:
                code = batch.column(batch.schema.get_field_index(c)).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                changes[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(changes)
            hits = batch.column(batch.schema.get_field_index("hits"))
            sums = np.add.reduceat((hits.to_numpy()[:, None] >> np.arange(n)) & 1, starts, axis=0, dtype=np.int64)
            ends = np.append(starts, batch.num_rows)
            listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            out = {c: batch.column(batch.schema.get_field_index(c)).take(pa.array(starts)) for c in (*by, "part")}
            out |= {"block": pa.array(made + np.arange(len(starts))), "rows": pa.array(np.diff(ends)), "hits": listed(ends, hits), "sums": listed(np.arange(len(starts) + 1) * n, pa.array(sums.ravel()))}
            made += len(starts)
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", part int, block long, rows long, hits array<int>, sums array<long>"
    return written(rows.select(*by, F.spark_partition_id().alias("part"), "hits").mapInArrow(run, schema))


def started(found: DataFrame, totals: DataFrame, by: list[str], n: int) -> DataFrame:
    """blocks with what goes before each: rank0 and tps0 (an array), and n_true; totals has n_true and some or all of by."""
    earlier = Window.partitionBy(*by).orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = found.select(*by, "part", "block", before(F.col("rows")).alias("rank0"), F.array(*[before(F.col("sums")[i]) for i in range(n)]).alias("tps0"))
    starts = cut(starts.join(totals, [c for c in by if c in totals.columns]))
    return found.join(starts, [*by, "part", "block"])


def _each_block(found: DataFrame, by: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run of each block with its starts. Blocks are small, but much is made of them, so that they are not left to a few tasks.

    They are dealt by other keys than a join before, or else the step would be left out.
    """
    key, kinds = [*by, "part", "block"], dict(found.dtypes)
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "block", "part").groupBy(*key).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + schema)


def _running(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranks, running hits, precision) of a block; of the last two a row for each threshold."""
    hits, before = (np.asarray(block[c][0].values) for c in ("hits", "tps0"))
    rank = block["rank0"][0].as_py() + np.arange(1, len(hits) + 1)
    tps = before[:, None] + np.cumsum((hits >> np.arange(len(before))[:, None]) & 1, axis=1)
    return rank, tps, tps / rank


def _made(block: pa.Table, by: list[str], out: dict[str, np.ndarray]) -> pa.Table:
    size = len(next(iter(out.values())))
    kept = {c: pa.repeat(block[c][0], size) for c in (*by, "n_true")}
    return pa.table({**{c: kept[c] for c in by}, **{c: pa.array(v) for c, v in out.items()}, "n_true": kept["n_true"]})


def block_envelope(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """The rows of envelope from blocks with their starts: a task holds a block at a time, and sorts nothing but blocks."""

    def tops(block: pa.Table) -> pa.Table:
        top = _running(block)[2].max(axis=1)
        return pa.table({**{c: block[c] for c in (*by, "part", "block")}, "top": pa.array([top.tolist()], pa.list_(pa.float64()))})

    def run(block: pa.Table) -> pa.Table:
        rank, tps, precise = _running(block)
        after = np.array([t or 0.0 for t in block["after"][0].as_py()])
        top = np.maximum(np.maximum.accumulate(precise[:, ::-1], axis=1)[:, ::-1], after[:, None])
        return _made(block, by, {"rank": np.tile(rank, n), "k": np.repeat(np.arange(n, dtype=np.int32), len(rank)), "tps": tps.ravel(), "envelope": top.ravel()})

    later = Window.partitionBy(*by).orderBy(F.desc("part"), F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    top = _each_block(found, by, tops, ", part int, block long, top array<double>")
    after = cut(top.select(*by, "part", "block", F.array(*[F.max(F.col("top")[i]).over(later) for i in range(n)]).alias("after")))
    rows = _each_block(found.join(after, [*by, "part", "block"]), by, run, ", rank long, k int, tps long, envelope double, n_true long")
    return rows.withColumn("precision", precision(F.col("tps"))).withColumn("recall", recall(F.col("tps")))


def block_average_precision(found: DataFrame, by: list[str], n: int, steps: int = 100) -> DataFrame:
    """average_precision from blocks with their starts."""

    def run(block: pa.Table) -> pa.Table:
        rank, tps, precise = _running(block)
        place = np.ceil(tps / (block["n_true"][0].as_py() + EPS) * steps).astype(np.int32)
        changes = np.diff(place, axis=1, prepend=place[:, :1] - 1) != 0
        starts = np.flatnonzero(changes.ravel())
        last = np.append(starts[1:], place.size) - 1
        flat = tps.ravel()
        return _made(block, by, {"k": (starts // len(rank)).astype(np.int32), "g": place.ravel()[starts], "rank": rank[last % len(rank)], "tps": flat[last], "tps0": flat[starts], "top": np.maximum.reduceat(precise.ravel(), starts)})

    parts = _each_block(found, by, run, ", k int, g int, rank long, tps long, tps0 long, top double, n_true long")
    return _area(parts.groupBy(*by, "k", "g", "n_true").agg(F.max("rank").alias("rank"), F.max("tps").alias("tps"), F.min("tps0").alias("tps0"), F.max("top").alias("top")), by, steps)


def best_f1(curves: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, k, rank, f1): the best F1 at each threshold, of equals to nine decimals the first. Ranges lie sorted, so that nothing is sorted for it."""
    f = [f1(precision(F.col("tps")[i]), recall(F.col("tps")[i])) for i in range(n)]
    best = curves.groupBy(*by, "part").agg(*[F.max(F.struct(F.round(v, 9).alias("r"), (-F.col("rank")).alias("rank"), v.alias("f1"))).alias(f"b{i}") for i, v in enumerate(f)])
    rows = best.select(*by, F.posexplode(F.array(*[f"b{i}" for i in range(n)])).alias("k", "b"))
    return rows.groupBy(*by, "k").agg(F.max("b").alias("b")).select(*by, "k", (-F.col("b.rank")).alias("rank"), "b.f1")


def average_precision(curves: DataFrame, by: list[str], steps: int = 100) -> DataFrame:
    """(by, k, ap): area under the envelope, by trapezia between steps + 1 equally spaced recalls.

    The curve starts at recall 0 with precision 1 and ends at recall 1 with precision 0, and is
    linear between its points; of points with equal recall the last counts. Between two places of
    the grid only the first and last point and the greatest precision matter, so that points are
    summed up by place before anything is sorted.
    """
    rows = curves.select(*by, "rank", "n_true", F.posexplode("tps").alias("k", "tps"))
    own = [*by, "k"]
    place = F.ceil(recall(F.col("tps")) * steps).cast("int")
    # hits only rise with the rank, so that the ends of a place are its extremes, which need no sort
    ends = rows.groupBy(*own, place.alias("g"), "n_true").agg(F.max("rank").alias("rank"), F.max("tps").alias("tps"), F.min("tps").alias("tps0"), F.max(precision(F.col("tps"))).alias("top"))
    return _area(ends, by, steps)


def _area(ends: DataFrame, by: list[str], steps: int) -> DataFrame:
    """average_precision from the ends of each place: by, k, g, n_true, rank, tps, tps0, top."""
    own = [*by, "k"]
    last = F.struct(recall(F.col("tps")).alias("recall"), precision(F.col("tps")).alias("precision"))
    kept = ends.select(*own, "g", last.alias("last"), F.struct(recall(F.col("tps0")).alias("recall")).alias("first"), "top")
    kept = cut(kept)
    grid = kept.select(*own).distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = Window.partitionBy(*own).orderBy("g")
    at, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    near = grid.join(kept, [*own, "g"], "left").select(*own, "g", F.last("last", True).over(at).alias("l"), F.first("first", True).over(after).alias("r"), F.max("top").over(after).alias("top"))
    x0, x1 = F.coalesce("l.recall", F.lit(0.0)), F.coalesce("r.recall", F.lit(1.0))
    y0, y1 = F.greatest(F.coalesce("l.precision", F.lit(1.0)), F.col("top")), F.coalesce("top", F.lit(0.0))
    height = F.when(F.col("g") == steps, 0.0).otherwise(y0 + (y1 - y0) * ((F.col("g") / steps - x0) / (x1 - x0)))
    weight = F.when((F.col("g") == 0) | (F.col("g") == steps), 0.5).otherwise(1.0)
    return near.groupBy(*own).agg((F.sum(height * weight) / steps).alias("ap"))


def f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / (precision + recall + EPS)


def psnr(mse: Column, peak: float = 1.0, rounded: Callable[[Column], Column] = lambda c: c) -> Column:
    """Peak signal to noise in decibels, infinite where there is no error."""
    return F.when(mse > 0, rounded(10 * F.log10(F.try_divide(F.lit(peak * peak), mse)))).when(mse.isNotNull(), F.lit(math.inf))


def swept(rows: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """Each row once for each combination of thresholds that its columns exceed, which are added as <column>_th."""
    for name, values in grid.items():
        over = F.array_compact(F.array(*[F.when(F.col(name) > v, F.lit(float(v))) for v in values]))
        rows = rows.withColumn(f"{name}_th", F.explode(over))
    return rows
