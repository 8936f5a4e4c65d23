"""Removal of long repeated spans of words by a compacted De Bruijn graph.

A window is 50 consecutive words. Of the word 12-grams in each window the one with the least
hash is its anchor, so equal windows have equal anchors, whatever stands around them. The graph
is sparse: of all token k-mers only the anchors are nodes, and an edge is the words from an
anchor to the next in the same document (or to its start or end). A node whose occurrences all
have the same edge to the next, which all have the same edge back, does not branch there. Spark
joins compact such nodes to paths: each node points to the one before, and pointers are doubled
until they reach a path's head. All occurrences of a path have the same words from its first
anchor to its last: their windows are judged at once, from the path. The windows that reach past
a path are compared one by one, by their words at their source coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut, narrowed, text_slices

WINDOW, GRAM = 50, 12
#: 12-grams in a window.
CHOICE = WINDOW - GRAM + 1
#: Rows without an id come after all others.
LAST = (1 << 63) - 1
NO_NODE = -(1 << 63)
AT_START, AT_END = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each span consecutive values the place of the least, the first of equals."""
    best, place, have = values, np.arange(len(values), dtype=np.int32), 1
    if len(values) < span:
        return place[:0]

    def merged(shift: int) -> None:
        nonlocal best, place
        n = len(best) - shift
        later = best[shift:] < best[:n]
        best, place = np.where(later, best[shift:], best[:n]), np.where(later, place[shift:], place[:n])

    while have * 2 <= span:
        merged(have)
        have *= 2
    if span > have:
        merged(span - have)
    return place


def anchors(own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts whose word hashes are own[at[i]:at[i + 1]]: (anchors of each, node, place, first window of each anchor, edges).

    Each text with anchors has one edge more than anchors, those before the first and after the last too.
    """
    count = np.diff(at)
    windows = np.maximum(count - WINDOW + 1, 0)
    if not windows.any():
        nothing = np.zeros(0, np.int64)
        return np.zeros(len(count), np.int64), nothing.astype(np.uint64), nothing, nothing, nothing.astype(np.uint64)
    grams = words.gram_hashes(own, GRAM)
    place = least_places(grams, CHOICE)
    rows = np.repeat(np.arange(len(count)), windows)
    window = np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows)
    chosen = place[at[:-1][rows] + window]
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])))
    chosen, rows, window = chosen[new].astype(np.int64), rows[new], window[new]
    n = np.bincount(rows, minlength=len(count))
    with_any = np.flatnonzero(n)
    rank = np.repeat(np.arange(len(with_any)), n[with_any])
    slot = np.arange(len(chosen)) + rank
    first = np.concatenate(([0], np.cumsum(n[with_any] + 1)[:-1]))
    last = first + n[with_any]
    starts, ends = np.empty(len(chosen) + len(with_any), np.int64), np.empty(len(chosen) + len(with_any), np.int64)
    starts[first], starts[slot + 1] = at[:-1][with_any], chosen
    ends[slot], ends[last] = chosen + GRAM, at[1:][with_any]
    edges = words.span_hashes(own, starts, ends)
    edges[first] ^= AT_START
    edges[last] ^= AT_END
    return n, grams[chosen], chosen - at[:-1][rows], window, edges


def _list(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


SKETCH = "doc_id long, text_hash long, n_words long, k1 long, k2 long, kept_sha256 string, nodes array<long>, places array<int>, firsts array<int>, edges array<long>"


def sketched(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: keys of its word sequence, the digest of its words, its anchors."""
    names = [x.split()[0] for x in SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                starts, ends, at = words.split(data, offsets, words.NOT_BLANK)
                own = words.word_hashes(data, starts, ends)
                k1, k2 = (words.span_hashes(own, at[:-1], at[1:], which) for which in (0, 1))
                n, nodes, places, firsts, edges = anchors(own, at)
                raw = data.tobytes()
                digests = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                lists = [_list(n, pa.array(nodes.view(np.int64))), _list(n, pa.array(places.astype(np.int32))), _list(n, pa.array(firsts.astype(np.int32))), _list(n + (n > 0), pa.array(edges.view(np.int64)))]
                columns = [batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(np.diff(at)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(digests), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("text_hash")).mapInArrow(run, SKETCH)


def spans_of(covered: np.ndarray) -> list[tuple[int, int]]:
    """The runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def covered_by(windows: np.ndarray) -> np.ndarray:
    """Words covered by the windows whose starts are True."""
    total = np.cumsum(np.concatenate((windows.astype(np.int32), np.zeros(WINDOW - 1, np.int32))))
    total[WINDOW:] -= total[:-WINDOW].copy()
    return total > 0


def paths(nodes: DataFrame) -> DataFrame:
    """(node, head, place): the path that each node is part of and its place in it, from 0.

    nodes has node and, where the link to the node before does not branch, prev; else prev is
    null and the node a head. Each round joins pointers with pointers, which doubles how far
    they reach. Nodes on a ring have no head; each is a path of its own.
    """
    now = cut(nodes.select("node", F.coalesce("prev", "node").alias("up"), F.col("prev").isNotNull().cast("long").alias("place"), F.col("prev").isNull().alias("done")))
    left = now.filter("not done").count()
    while left:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"), F.col("done").alias("there"))
        now = cut(now.join(above, "up").select("node", F.col("next").alias("up"), F.when(F.col("done"), F.col("place")).otherwise(F.col("place") + F.col("more")).alias("place"), (F.col("done") | F.col("there")).alias("done")))
        before, left = left, now.filter("not done").count()
        if left == before:  # only rings are left
            break
    return now.select("node", F.when(F.col("done"), F.col("up")).otherwise(F.col("node")).alias("head"), F.when(F.col("done"), F.col("place")).otherwise(F.lit(0)).alias("place"))


def judged(did: int, n: int, places: np.ndarray, firsts: np.ndarray, at: np.ndarray, least: np.ndarray, head: np.ndarray, place: np.ndarray, one_before: np.ndarray, one_after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows removed, windows to be compared) of a text; at, and the others in its order, tell of its repeated anchors."""
    r, windows = len(places), n - WINDOW + 1
    first_doc = np.full(r, -1, np.int64)
    first_doc[at] = least
    order = np.argsort(at)
    at, head, place, one_before, one_after = at[order], head[order], place[order], one_before[order], one_after[order]
    # runs of anchors that follow each other on one path: all its occurrences have the words from the first anchor to the last,
    # and where only one edge leads there, or on, also those of that edge
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (head[1:] != head[:-1]) | (place[1:] != place[:-1] + 1)))
    run = np.cumsum(new) - 1
    low, high = np.full(r, n, np.int64), np.zeros(r, np.int64)
    starts = np.flatnonzero(new)
    ends = np.concatenate((starts[1:], [len(at)])) - 1
    first, last = at[starts], at[ends]
    low[at] = np.where(one_before[starts], np.where(first > 0, places[first - 1], 0), places[first])[run]
    high[at] = np.where(one_after[ends], np.where(last + 1 < r, places[np.minimum(last + 1, r - 1)] + GRAM, n), places[last] + GRAM)[run]
    owner = np.repeat(np.arange(r), np.diff(np.concatenate((firsts, [windows]))))
    start = np.arange(windows)
    settled = (start >= low[owner]) & (start + WINDOW <= high[owner])
    repeated = first_doc[owner] >= 0
    return settled & repeated & (first_doc[owner] < did), repeated & ~settled


SPANS = "array<struct<a:int,b:int>>"
SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _spans(lists: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in x] for x in lists], SPAN_TYPE)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, whole, removed, open_ = [], [], [], []
        did, n = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        places, firsts, hits = (batch.column(i) for i in range(3, 6))
        for i in range(batch.num_rows):
            own = hits[i].values
            gone, left = judged(did[i], n[i], *(x[i].values.to_numpy().astype(np.int64) for x in (places, firsts)), own.field("i").to_numpy(), own.field("least").to_numpy(), *(own.field(c).to_numpy(zero_copy_only=False) for c in ("head", "place", "one_before", "one_after")))
            if gone.any() or left.any():
                keep.append(i)
                whole.append(bool(covered_by(gone).all()))
                removed.append(spans_of(gone) if not whole[-1] else [])
                open_.append(spans_of(left))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(whole, pa.bool_()), _spans(removed), _spans(open_)], names=["did", "text_hash", "whole", "removed", "open"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = pa.array([packer.compress((t or "").encode()) for t in batch.column(0).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*batch.schema.names[1:], "packed"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of the words of each open window, with its source coordinates."""
    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        for did, text_hash, spans, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not spans:
                continue
            data = np.frombuffer(reader.decompress(packed), np.uint8)
            starts, ends, _ = words.split(data, np.array([0, len(data)]), words.NOT_BLANK)
            own = words.word_hashes(data, starts, ends)
            at = np.concatenate([np.arange(s["a"], s["b"]) for s in spans])
            h1, h2 = (words.span_hashes(own, at, at + WINDOW, which).view(np.int64) for which in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(len(at), did)), pa.array(np.full(len(at), text_hash)), pa.array(at.astype(np.int32))], names=["h1", "h2", "did", "text_hash", "at"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        gone, digests = [], []
        for whole, removed, packed, more in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            tokens = reader.decompress(packed).split()
            windows = np.full(len(tokens) - WINDOW + 1, whole)
            for s in removed:
                windows[s["a"] : s["b"]] = True
            if more:
                windows[more] = True
            cover = covered_by(windows)
            gone.append(int(cover.sum()))
            digests.append(hashlib.sha256(b" ".join([t for t, c in zip(tokens, cover.tolist(), strict=True) if not c])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=["did", "text_hash", "gone", "kept"])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs.

    A word goes if a window of 50 words that covers it also starts in a row with a smaller
    doc_id. docs needs doc_id and text; other columns are ignored. A null text has no words;
    fewer than 50 words have no window. Rows with equal ids remove nothing from each other, and
    rows without an id come after all others. An empty table gives an empty result.
    """
    key = ["did", "text_hash"]
    sketch = cut(sketched(docs).withColumn("did", F.coalesce("doc_id", F.lit(LAST))))
    placed = sketch.filter(F.size("nodes") > 0)
    occurrences = placed.select(*key, F.posexplode("nodes").alias("i", "node"), "nodes", "edges").select(*key, "i", "node", F.coalesce(F.get("nodes", F.col("i") - 1), F.lit(NO_NODE)).alias("prev"), F.col("edges")[F.col("i")].alias("before"), F.col("edges")[F.col("i") + 1].alias("after"))
    nodes = occurrences.groupBy("node").agg(F.min("did").alias("least"), F.max("did").alias("most"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("before", "after", "prev") for f in (F.min, F.max)))
    # written once, so that the joins below exchange both sides and adaptive execution can split a hot node or window
    same = lambda c: F.col(f"min_{c}") == F.col(f"max_{c}")
    repeated = cut(nodes.filter("least < most").select("node", "least", F.when(same("before") & same("prev"), F.col("min_prev")).alias("prev"), same("before").alias("one_before"), same("after").alias("one_after")))
    # a link that branches on neither side: every occurrence of either end is one of the other
    onward = repeated.filter("one_after").select(F.col("node").alias("prev"), F.lit(True).alias("linked"))
    linked = repeated.select("node", "prev").join(onward, "prev", "left").select("node", F.when(F.col("linked"), F.col("prev")).alias("prev"))
    compacted = cut(repeated.drop("prev").join(paths(linked), "node"))
    hits = occurrences.select(*key, "i", "node").join(compacted, "node").groupBy(*key).agg(F.collect_list(F.struct("i", "least", "head", "place", "one_before", "one_after")).alias("hits"))
    judging = placed.select(*key, "n_words", "places", "firsts").join(hits, key).dropDuplicates(key)
    verdicts = cut(judging.mapInArrow(_judge, f"did long, text_hash long, whole boolean, removed {SPANS}, open {SPANS}"))
    wanted = verdicts.filter("not whole or size(open) > 0")
    texts = docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"))
    joined = narrowed(texts, wanted, "text_hash").join(wanted, key).select("text", *key, "whole", "removed", "open").dropDuplicates(key)
    packed = cut(joined.mapInArrow(_packed, f"did long, text_hash long, whole boolean, removed {SPANS}, open {SPANS}, packed binary"))
    windows = packed.select(*key, "open", "packed").mapInArrow(_windows, "h1 long, h2 long, did long, text_hash long, at int")
    least = cut(windows.groupBy("h1", "h2").agg(F.min("did").alias("least"), F.max("did").alias("most")).filter("least < most").drop("most"))
    more = windows.join(least, ["h1", "h2"]).filter("least < did").groupBy(*key).agg(F.collect_list("at").alias("more"))
    done = packed.filter("not whole").select(*key, "whole", "removed", "packed").join(more, key, "left").mapInArrow(_finish, "did long, text_hash long, gone long, kept string")
    whole = verdicts.filter("whole").select(*key, F.lit(None).cast("long").alias("gone"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    out = sketch.select("doc_id", *key, "n_words", "kept_sha256").join(done.unionByName(whole), key, "left")
    gone = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.coalesce("gone", "n_words")).cast("long")
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.coalesce("kept", "kept_sha256").alias("kept_sha256"))
