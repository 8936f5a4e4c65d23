"""Mixing sources to target weights by the cube method.

Each unit is taken floor(p) or floor(p) + 1 times, p being its source's target over its
source's size. The fractional parts are the inclusion probabilities of a balanced sample:
the flight moves them inside the null space of two constraints, the number of documents and
the number of words. It settles the largest unit that is left, all others making up for it,
so that the few that stay fractional are small. Those of all blocks of a source meet in the
next round, until one block a source is left. Its last units are landed by a draw, and the
words that the draw is off are made up by the fewest changes of how often units are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, narrowed, numbered

#: Units in a block of the flight phase.
BLOCK = 1024
MOST_REPEATS = 3
#: Sources up to which the table with one row for each is broadcast.
FEW_SOURCES = 50_000
WORDS = r"[^\x20\x09-\x0D]+"
EPS = 1e-9
#: Units times words up to which the landing finds the nearest total there is; over it, changes of one or two units.
EXACT = 20_000_000


def targets(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """(src, source_size, n) to (src, source_size, n, rank, target).

    Weights are 1, 2, 3, 1, ... by code point, null last. A target stops at most times its
    source's size and the excess is shared again by weight: target = min(most * size, level *
    weight). The level rises from that without stops, one aggregation a step, until no further
    source stops; a source that stops at a level stops at every higher one.
    """
    ranked = numbered(sources, "rank", F.col("src").asc_nulls_last()).withColumn("w", ((F.col("rank") - 1) % 3 + 1).cast("long"))
    cap, level, before = (most * F.col("source_size")).cast("double"), 0.0, -1
    while True:
        stops = F.col("w") * F.lit(level) > cap
        now = ranked.agg(
            F.sum("source_size").alias("total"), F.sum("w").alias("w"), F.count_if(stops).alias("stopped"),
            F.sum(F.when(stops, F.col("source_size")).otherwise(0)).alias("below"), F.sum(F.when(stops, F.col("w")).otherwise(0)).alias("below_w"),
        ).first()
        if not now["w"] or now["stopped"] == before or now["w"] == now["below_w"]:
            break
        before, level = now["stopped"], (now["total"] - most * now["below"]) / (now["w"] - now["below_w"])
    return ranked.select("src", "source_size", "n", "rank", F.least(cap, F.col("w") * F.lit(level)).alias("target"))


def flight(p: np.ndarray, count: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two are fractional, sums of count and size kept.

    A step moves the first unit that is fractional, the largest if units come by falling size,
    along its own axis projected into the null space of the two constraint rows over all
    fractional units. How far, one way or the other, is drawn so that each probability keeps
    its mean; every step settles a unit at least.
    """
    p = p.copy()
    chance = iter(draws.random(2 * len(p) + 4))
    live = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    p[np.setdiff1d(np.arange(len(p)), live)] = np.round(p[np.setdiff1d(np.arange(len(p)), live)])
    top = max(1.0, float(size.max(initial=0.0)))
    a, b, q = count[live].astype(float), size[live] / top, p[live]
    while len(live) > 1:
        aa, ab, bb = a @ a, a @ b, b @ b
        det = aa * bb - ab * ab
        if det > 1e-12 * aa * bb:
            u = -a * ((bb * a[0] - ab * b[0]) / det) - b * ((aa * b[0] - ab * a[0]) / det)
        else:  # all of the same shape: one row is enough
            u = -a * (a[0] / aa)
        u[0] += 1
        if np.abs(u).max() < 1e-9:
            break
        rise = u > 0
        room = np.where(rise, 1 - q, q)
        fall = np.where(rise, q, 1 - q)
        speed = np.maximum(np.abs(u), 1e-15)
        up, down = float((room / speed).min()), float((fall / speed).min())
        q = q + u * (up if next(chance) * (up + down) < down else -down)
        done = (q < EPS) | (q > 1 - EPS)
        if not done.any():  # rounding kept the boundary from being met
            done[np.minimum(q, 1 - q).argmin()] = True
        p[live[done]] = np.round(q[done])
        live, a, b, q = live[~done], a[~done], b[~done], q[~done]
    p[live] = q
    return p


def landed(p: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Whole numbers for the last fractional units, each drawn by its probability."""
    return np.where((p > EPS) & (p < 1 - EPS), draws.random(len(p)) < p, np.round(p)).astype(np.int64)


def corrected(k: np.ndarray, size: np.ndarray, goal: float, most: int) -> np.ndarray:
    """k, each from 0 to most, changed little so that the sum of k * size comes nearest to goal.

    Small problems get the nearest total that there is, and of the ways to it one with the
    least sum of changes. Larger ones, whose tables would not fit, are improved by the best change
    of one or two units until none helps; the total is then never farther off than before, which
    is the words of the two smallest units of the last block at most, as only those are drawn.
    """
    top = int(min(most * size.sum(), goal + size.max(initial=0) + 1))
    return _nearest(k, size, goal, most, top) if len(k) * (top + 1) <= EXACT else _improved(k, size, goal, most)


def _nearest(k: np.ndarray, size: np.ndarray, goal: float, most: int, top: int) -> np.ndarray:
    far = 1 << 28
    cost = np.full(top + 1, far, np.int32)
    cost[0] = 0
    chosen = np.zeros((len(k), top + 1), np.int8)
    for i, (n, s) in enumerate(zip(k.tolist(), size.tolist(), strict=True)):
        best = cost + n
        for c in range(1, most + 1):
            if c * s > top:
                break
            less = np.full(top + 1, far, np.int32)
            less[c * s :] = cost[: top + 1 - c * s] + abs(c - n)
            better = less < best
            best[better], chosen[i][better] = less[better], c
        cost = np.minimum(best, far)
    sums = np.flatnonzero(cost < far)
    at = int(min(sums.tolist(), key=lambda x: (abs(x - goal), cost[x])))
    out = k.copy()
    for i in range(len(k) - 1, -1, -1):
        out[i] = chosen[i][at]
        at -= int(out[i]) * int(size[i])
    return out


def _improved(k: np.ndarray, size: np.ndarray, goal: float, most: int) -> np.ndarray:
    k = k.copy()
    while True:
        off = goal - float(k @ size)
        unit, to = (x.ravel() for x in np.indices((len(k), most + 1)))
        here = (to != k[unit]) & (size[unit] > 0)
        unit, to = unit[here], to[here]
        change = ((to - k[unit]) * size[unit]).astype(float)
        order = np.lexsort((to, unit, change))
        unit, to, change = unit[order], to[order], change[order]
        if abs(off) < 0.5 + EPS or not len(change):
            return k
        one = int(np.abs(off - change).argmin())
        best, ways = abs(off - change[one]), [one]
        # for each change the nearest of the others to what it leaves
        place = np.searchsorted(change, off - change)
        for shift in range(-most - 2, most + 2):
            other = np.clip(place + shift, 0, len(change) - 1)
            miss = np.where(unit[other] == unit, np.inf, np.abs(off - change - change[other]))
            at = int(miss.argmin())
            if miss[at] < best - EPS:
                best, ways = float(miss[at]), [at, int(other[at])]
        if best > abs(off) - 0.5:
            return k
        k[unit[ways]] = to[ways]


def _fly(last: bool, seed: int, most: int):
    def run(units: pa.Table) -> pa.Table:
        units = units.sort_by([("words", "descending"), *((c, "ascending") for c in ("h", "doc_id", "copy"))]).combine_chunks()
        draws = np.random.default_rng([seed, *(units[c][0].as_py() for c in ("rank", "block", "round"))])
        base, p, size = (units[c].to_numpy() for c in ("base", "p", "words"))
        q = flight(p, np.ones(len(p)), size, draws)
        if last:
            q = corrected(base + landed(q, draws), size, float((base + p) @ size), most) - base
        return units.set_column(units.schema.get_field_index("p"), "p", pa.array(q.astype(float), pa.float64()))

    return run


UNIT = "rank long, doc_id long, size long, h long, copy long, words long, p double, base long, block long, round long"


def units(docs: DataFrame) -> DataFrame:
    """Documents to (src, doc_id, size, h, copy): a row for each, those with the same source, id and text numbered from 1 in copy."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(F.col("source").alias("src"), F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), F.xxhash64(text).alias("h"))
    return sized.groupBy("src", "doc_id", "size", "h").agg(F.count(F.lit(1)).alias("m")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))


def mix(docs: DataFrame, most: int = MOST_REPEATS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(src, doc_id, size, h, copy, source_size, target, k): each unit and how often it is taken.

    docs needs doc_id, text and source; other columns are ignored, whatever their names. A
    null text is empty and a null source a source of its own, the last. Of rows equal in source,
    doc_id and text, which are numbered in copy, some may be taken more often than others. Ties are ordered by hash, id and
    copy. An empty table gives an empty result. k never exceeds most.
    """
    counted = cut(units(docs))
    per_source = cut(targets(counted.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), most))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    extent = per_source.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("units")).first()
    small = F.broadcast if extent["sources"] <= FEW_SOURCES else (lambda df: df)
    joined = counted.withColumnRenamed("src", "own").join(small(per_source), F.col("own").eqNullSafe(F.col("src"))).drop("own")
    base = F.least(F.floor(F.col("ratio") + EPS), F.lit(most)).cast("long")
    start = joined.withColumn("ratio", ratio).select(
        F.col("rank").cast("long").alias("rank"), "doc_id", "size", "h", "copy", F.col("size").alias("words"), F.greatest(F.col("ratio") - base, F.lit(0.0)).alias("p"), base.alias("base"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("round")
    )
    parts, number = [], 0
    now = start
    largest = extent["units"] or 0
    while largest > block:
        # a source's blocks: enough of them for its units, dealt by hash
        n = now.groupBy(F.col("rank").alias("r")).count().select("r", F.ceil(F.col("count") / block).alias("blocks"))
        dealt = now.join(small(n), F.col("rank") == F.col("r")).withColumn("block", F.pmod(F.xxhash64("h", "doc_id", "copy", F.lit(seed + number)), F.col("blocks"))).withColumn("round", F.lit(number).cast("long"))
        flown = cut(dealt.select(*now.columns).groupBy("rank", "block").applyInArrow(_fly(False, seed, most), UNIT))
        fractional = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        parts.append(flown.filter(~fractional))
        now = flown.filter(fractional)
        largest = now.groupBy("rank").count().agg(F.max("count")).first()[0] or 0
        number += 1
    final = now.withColumn("block", F.lit(0).cast("long")).withColumn("round", F.lit(number).cast("long"))
    parts.append(final.groupBy("rank").applyInArrow(_fly(True, seed, most), UNIT))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    decided = done.select(F.col("rank").alias("r"), "doc_id", "size", "h", "copy", (F.col("base") + F.round("p").cast("long")).alias("k"))
    out = decided.join(small(per_source), F.col("r") == F.col("rank"))
    return out.select("src", "doc_id", "size", "h", "copy", "source_size", "target", F.least(F.col("k"), F.lit(most)).alias("k"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as it is taken, numbered in mix_copy from 1; rows not taken go.

    All columns of docs stay, whatever their names; should one be called mix_copy, the number
    replaces it. Nulls, empty texts, ties, repeated rows and empty tables are as in mix(). Which of
    repeated rows is which copy is told by all their columns.
    """
    mixed = cut(mix(docs, **options))
    once = mixed.groupBy("src", "doc_id", "h").agg(F.max("copy").alias("m"), F.max("k").alias("k"))
    rows = docs.select(F.struct("*").alias("row")).withColumn("own_h", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    key = F.col("row.source").eqNullSafe(F.col("src")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("own_h") == F.col("h"))
    taken = rows.join(once.filter("m = 1 and k > 0"), key).select("row", "k")
    repeated = cut(once.filter("m > 1"))
    again = narrowed(rows, repeated.select(F.col("h").alias("own_h")), "own_h").join(repeated, key).select("row", "src", "doc_id", "h", F.monotonically_increasing_id().alias("nth"))
    # those that are repeated are numbered by a sort over all of them, which no group holds up
    order = [F.col("src").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("h"), F.xxhash64(F.to_json("row")), F.col("nth")]
    placed = numbered(again, "at", *order)
    first = placed.groupBy(F.col("src").alias("src2"), F.col("doc_id").alias("id2"), F.col("h").alias("h2")).agg(F.min("at").alias("first"))
    met = placed.join(first, F.col("src").eqNullSafe(F.col("src2")) & F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))).select("row", "src", "doc_id", "h", (F.col("at") - F.col("first") + 1).alias("copy"))
    own = mixed.filter("k > 0").select(F.col("src").alias("src2"), F.col("doc_id").alias("id2"), F.col("h").alias("h2"), F.col("copy").alias("copy2"), "k")
    numbered_rows = met.join(own, F.col("src").eqNullSafe(F.col("src2")) & F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")) & (F.col("copy") == F.col("copy2"))).select("row", "k")
    copies = taken.unionByName(numbered_rows).select("row", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("mix_copy"))
    return copies.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "mix_copy"], "mix_copy")
