"""Matches of detections and truth, and best or nearest polygons, by numpy for many whole images at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import polygons as G
from .overlap import CORNERS

EPS = 1e-7
#: Pairs that are looked at together, and pairs of polygons that are worked out together.
PAIRS, POLYGONS = 1 << 20, 1 << 16


def whole(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their values of a column; rows of equal values follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column)).to_pylist()
        first = values.index(values[-1])
        if held and not first and values[0] == last:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, first)]
        if sum(b.num_rows for b in done):
            yield pa.Table.from_batches(done)
        held, last = [batch.slice(first)], values[-1]
    if held:
        yield pa.Table.from_batches(held)


def rounded(x: np.ndarray) -> np.ndarray:
    """To nine decimals, halves up, in the arithmetic of DuckDB's round."""
    scaled = x * 1e9
    down = np.floor(scaled)
    return (down + (scaled - down >= 0.5)) / 1e9


def hit_bits(key: np.ndarray, det: np.ndarray, box: np.ndarray, lab: np.ndarray, true: np.ndarray, true_box: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """For each row a bit for each threshold at which its box has a match among the truths of equal key.

    A box takes the truth of most IoU, of equals the one of the least lab, and a truth goes to the first box, by det,
    that reaches the threshold. Key is negative for rows that take no part. A pair of some IoU shares more than
    that part of the width of both, so that only boxes that start so near to a truth's left side are looked at.
    """
    least, bits = min(thresholds), np.zeros(len(key), np.int32)
    sides = lambda b: (b[2] - b[0] > 0) & (b[3] - b[1] > 0) & np.isfinite(b).all(0)
    own, t = np.flatnonzero((key >= 0) & sides(box)), np.flatnonzero((key >= 0) & true & sides(true_box))
    if not (len(own) and len(t)):
        return bits
    own = own[np.lexsort((box[0, own], key[own]))]
    share = 0.9 * least  # so that rounding loses no pair
    x, width = true_box[0, t], true_box[2, t] - true_box[0, t]
    low, high = x - width * (1 / share - 1), x + width * (1 - share)
    base = min(low.min(), box[0, own].min())
    room = max(high.max(), box[0, own].max()) - base + 1.0
    place, slack = key[own] * room + (box[0, own] - base), 1e-9 * room
    first = np.searchsorted(place, key[t] * room + (low - base) - slack, "left")
    count = np.searchsorted(place, key[t] * room + (high - base) + slack, "right") - first
    ends, at = np.cumsum(count), 0
    areas = [(b[2] - b[0]) * (b[3] - b[1]) for b in (true_box, box)]
    best, mate = np.full(len(key), -1.0), np.full(len(key), -1)
    while at < len(t):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = count[at:stop]
        a, b = np.repeat(t[at:stop], n), own[np.repeat(first[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = stop
        same = key[a] == key[b]
        a, b = a[same], b[same]
        wide, high_ = (np.maximum(np.minimum(true_box[k + 2, a], box[k + 2, b]) - np.maximum(true_box[k, a], box[k, b]), 0.0) for k in (0, 1))
        both = wide * high_
        iou = rounded(both / (areas[0][a] + areas[1][b] - both + EPS))
        kept = iou >= least
        a, b, iou = a[kept], b[kept], iou[kept]
        order = np.lexsort((lab[a], -iou, b))
        a, b, iou = a[order], b[order], iou[order]
        top = np.diff(b, prepend=-1) != 0
        a, b, iou = a[top], b[top], iou[top]
        better = (iou > best[b]) | ((iou == best[b]) & (lab[a] < lab[mate[b]]))
        best[b[better]], mate[b[better]] = iou[better], a[better]
    found = np.flatnonzero(mate >= 0)
    found = found[np.lexsort((det[found], mate[found]))]
    start = np.maximum.accumulate(np.where(np.diff(mate[found], prepend=-1) != 0, np.arange(len(found)), 0))
    for k, threshold in enumerate(thresholds):
        reach = best[found] >= threshold
        before = np.cumsum(reach) - reach
        bits[found[reach & (before == before[start])]] |= 1 << k
    return bits


def scored(rows: DataFrame, thresholds: Sequence[float], sides: Sequence[float] = (0.0,)) -> DataFrame:
    """(cls, conf, tie, truth, hits) of each detection: whether it is a truth too, and a bit for each threshold at which it has a match.

    rows has image, cls, conf, tie, det, its place in the image, x1 to y2, and where it is a truth too lab, distinct in the image, and g_x1 to
    g_y2. For a side over 0 masks are matched, the whole cells of that side between a box's floors; the bits of the sides follow
    one another. Rows of an image follow one another and go through one task anyway to be numbered, so that
    nothing of the pairs is dealt over tasks or written.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole(batches, "image"):
            ints = lambda c: found[c].fill_null(0).to_numpy()
            at = lambda p: np.stack([found[p + c].fill_null(np.nan).to_numpy() for c in CORNERS])
            taken = found["image"].is_valid().to_numpy() & found["cls"].is_valid().to_numpy()
            classes, cls = np.unique(ints("cls"), return_inverse=True)
            image = np.cumsum(np.diff(ints("image"), prepend=ints("image")[0]) != 0)
            key = np.where(taken, image * len(classes) + cls, -1)
            box, true_box, hits = at(""), at("g_"), np.zeros(found.num_rows, np.int32)
            for k, side in enumerate(sides):
                own, true = (np.floor(b / side) if side else b for b in (box, true_box))
                hits |= hit_bits(key, ints("det"), own, ints("lab"), found["lab"].is_valid().to_numpy(), true, thresholds) << (k * len(thresholds))
            out = found.select(["cls", "conf", "tie"]).append_column("truth", found["lab"].is_valid()).append_column("hits", pa.array(hits))
            yield from out.combine_chunks().to_batches(10_000)

    return rows.sortWithinPartitions("image").mapInArrow(run, f"cls {kinds['cls']}, conf double, tie long, truth boolean, hits int")


def _worked_out(f: Callable[[G.Corners, G.Corners], np.ndarray], shapes: G.Corners, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """f of pairs of shapes, some at a time."""
    parts = [f(*(tuple(c[rows[k : k + POLYGONS]] for c in shapes) for rows in (a, b))) for k in range(0, len(a), POLYGONS)]
    return np.concatenate([np.zeros(0), *parts])


def best_or_nearest(key: np.ndarray, ids: np.ndarray, query: np.ndarray, shapes: G.Corners, reach: float = 16.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, other row, overlap, distance): for each query the other polygon of equal key that it shares most area with, or the nearest if it shares none.

    Ties to nine decimals go to the least id; a query without others in its key has no row, nor do rows of negative key or without
    finite corners take part. Queries look for others in bounds widened by reach, which finds all that share
    area too, the rest by four times that, and so on: what is found nearer than they are widened is the nearest there is.
    """
    x, y, _ = shapes
    taken = (key >= 0) & np.isfinite(x).all(1) & np.isfinite(y).all(1)
    low, high = (np.stack([f(x, axis=1), f(y, axis=1)]) for f in (np.min, np.max))
    others = np.flatnonzero(taken & ~query)
    left = np.flatnonzero(taken & query)
    left = left[np.isin(key[left], key[others])]
    none = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, ...]] = [(none, none, np.zeros(0), np.zeros(0))]
    if not len(left):
        return out[0]
    others = others[np.lexsort((low[0, others], key[others]))]
    groups = int(key.max()) + 1
    widest = np.zeros(groups)
    np.maximum.at(widest, key[others], (high - low)[0, others])
    ends = [np.full((2, groups), v) for v in (np.inf, -np.inf)]
    some = np.concatenate([others, left])
    for k in (0, 1):
        np.minimum.at(ends[0][k], key[some], low[k, some])
        np.maximum.at(ends[1][k], key[some], high[k, some])
    whole_key = (ends[1] - ends[0]).max(axis=0)
    base = low[0, some].min()
    room = high[0, some].max() - base + 1.0
    place, slack = key[others] * room + (low[0, others] - base), 1e-9 * room
    at = lambda rows, to, side: np.searchsorted(place, key[rows] * room + np.clip(to - base, -slack, room - 1.0) + (slack if side == "right" else -slack), side)

    def first_of(a: np.ndarray, b: np.ndarray, worth: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids[b], worth, a))
        order = order[np.diff(a[order], prepend=-1) != 0]
        return a[order], b[order], value[order]

    widened = False
    while len(left):
        first = at(left, low[0, left] - reach - widest[key[left]], "left")
        count = at(left, high[0, left] + reach, "right") - first
        sums, begin, done = np.cumsum(count), 0, np.zeros(len(key), bool)
        while begin < len(left):
            stop = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + PAIRS, "right")))
            n = count[begin:stop]
            a, b = np.repeat(left[begin:stop], n), others[np.repeat(first[begin:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            begin = stop
            near = (key[a] == key[b]) & (low[:, a] - reach <= high[:, b]).all(0) & (low[:, b] <= high[:, a] + reach).all(0)
            a, b = a[near], b[near]
            if not widened:
                area = _worked_out(G.shared, shapes, a, b)
                share = area > 0
                p, q, best = first_of(a[share], b[share], -rounded(area[share]), area[share])
                out.append((p, q, best, np.zeros(len(p))))
                done[p] = True
                a, b = a[~done[a]], b[~done[a]]
            far = _worked_out(G.apart, shapes, a, b)
            p, q, best = first_of(a, b, rounded(far), far)
            sure = (best <= reach - 1e-6) | (whole_key[key[p]] <= reach)
            out.append((p[sure], q[sure], np.zeros(int(sure.sum())), best[sure]))
            done[p[sure]] = True
        left, reach, widened = left[~done[left]], reach * 4, True
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def quad_matches(rows: DataFrame) -> DataFrame:
    """(image, a_id, b_id, overlap, distance) of best_or_nearest within each image: rows has image, id, query, x1 to y2, and the cos and sin by which a box is turned.

    Rows of an image follow one another, as for scored.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole(batches, "image"):
            image, ids = (found[c].fill_null(0).to_numpy() for c in ("image", "id"))
            real = lambda c: found[c].fill_null(np.nan).to_numpy()
            key = np.where(found["image"].is_valid().to_numpy(), np.cumsum(np.diff(image, prepend=image[0]) != 0), -1)
            shapes = G.quads(np.stack([real(c) for c in CORNERS]), real("cos"), real("sin"))
            a, b, overlap, distance = best_or_nearest(key, ids, found["query"].to_numpy(), shapes)
            for k in range(0, len(a), 10_000):
                p, q = a[k : k + 10_000], b[k : k + 10_000]
                columns = (image[p], ids[p], ids[q], overlap[k : k + 10_000], distance[k : k + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["image", "a_id", "b_id", "overlap", "distance"])

    return rows.sortWithinPartitions("image").mapInArrow(run, f"image {kinds['image']}, a_id long, b_id long, overlap double, distance double")
