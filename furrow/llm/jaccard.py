"""Jaccard join on word five-grams with Bayesian candidate pruning.

Texts with equal words form a class and are handled once. A class has 128 MinHash values in
32 bands of four; classes that agree in a band are candidates. Within a bucket the values of
two classes are compared some at a time and the pair is dropped once the posterior probability
that its similarity reaches the threshold, from a uniform prior, is under the tolerance. The
pairs that are left, and no others, are verified on whole shingle sets. Most come as pairs of
classes with few partners and are joined with both sets. Where many classes resemble each other,
pairs would be as many as the square of the group: such a crowd is dealt in pairs
of blocks, and each block finds its surviving pairs again before it verifies them. Buckets and
crowds of any size are split.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import words
from .common import cut, narrowed, text_slices
from .components import roots

SHINGLE = 5
#: The threshold as a fraction, and the posterior below which a pair is dropped.
AT_LEAST = (4, 5)
TOLERANCE = 1e-6
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values compared between two looks at the posterior.
STEP = 16
#: Members of a bucket, and of a crowd, of which two blocks meet in one task.
BUCKET_BLOCK, CROWD_BLOCK = 512, 256
#: Blocks that a crowd has at least, where they can be an eighth as large, so that its work is spread early.
SPREAD = 20
#: Partners in a bucket with which a class still gives pairs; pairs of a class with more are a crowd's.
FEW = 16
_draws = np.random.default_rng(20_240_601)
FACTORS = _draws.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _draws.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds by text, first and second key of the word sequence) of lower-cased texts.

    A text of one to four words has one shingle, all of it; one without words has none.
    """
    starts, ends, at = words.split(data, offsets, words.NOT_BLANK)
    own = words.word_hashes(data, starts, ends)
    count = np.diff(at)
    keys = [words.span_hashes(own, at[:-1], at[1:], which) for which in (0, 1)]
    grams = words.gram_hashes(own, SHINGLE)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(bounds[-1], np.uint64)
    rows = np.repeat(np.arange(len(n)), n)
    place = at[:-1][rows] + np.arange(len(out)) - bounds[:-1][rows]
    short = (count < SHINGLE)[rows]
    out[~short] = grams[place[~short]]
    out[short] = keys[0][rows[short]]
    return out, bounds, *keys


def minhashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of HASHES 16-bit values for each text; those of a text without shingles mean nothing."""
    n = len(bounds) - 1
    out = np.zeros((n, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        at = bounds[:-1][full]
        for i in range(HASHES):
            least = np.minimum.reduceat(low * FACTORS[i] + SHIFTS[i], at)
            out[full, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, k1, k2, n_shingles, bands) for each row; bands is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in text_slices(batch.column(1)):
                hashes, bounds, k1, k2 = shingles(data, offsets)
                parts.append((k1, k2, np.diff(bounds), minhashes(hashes, bounds)))
            if not parts:
                continue
            k1, k2, n, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS), pa.int32()), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))
            bands = pa.compute.if_else(pa.array(n > 0), bands, pa.scalar(None, bands.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n.astype(np.int32)), bands], names=["doc_id", "text_hash", "k1", "k2", "n_shingles", "bands"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), text_hash().alias("text_hash"))
    return own.mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, n_shingles int, bands array<long>")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def least_matches(tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 STEP, ... values compared, the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n give P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    t = AT_LEAST[0] / AT_LEAST[1]
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a run of equal keys ends, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if held:
            before = held[-1].slice(held[-1].num_rows - 1)
            if any(before.column(before.schema.get_field_index(k))[0].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
                yield pa.Table.from_batches(held)
                held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _blocked(members: DataFrame, key: str, block: int, spread: int = 1) -> DataFrame:
    """Rows with size (of their key's members) dealt to pairs of blocks: adds own, low, high.

    A key with up to block members makes one pair (0, 0), a larger one has enough blocks. With
    spread it has as many at least, of an eighth of the members or more. Each member goes to
    every pair that its block is part of.
    """
    n = F.greatest(F.ceil(F.col("size") / block), F.least(F.lit(spread), F.ceil(F.col("size") / max(1, block // 8))))
    own = F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    return members.withColumn("own", own).withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "size").repartition(F.col(key), F.col("low"), F.col("high")).sortWithinPartitions(key, "low", "high")


def surviving(values: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the pairs of rows (a, b) of MinHash values are still likely enough after all looks."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, fewest in enumerate(least):
        span = slice(k * STEP, (k + 1) * STEP)
        matches += (values[a[left], span] == values[b[left], span]).sum(1)
        on = matches >= fewest
        left, matches = left[on], matches[on]
    return left


def _bands(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bands, and the MinHash values that they are made of."""
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    return bands, np.ascontiguousarray(bands).view(np.uint16)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts, and the end."""
    change = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate(([True], change, [True])))


def _candidates(least: list[int]):
    """(u, v, crowd) of pairs that agree in a bucket and whose posterior holds.

    A pair comes up in the first band in which it agrees. Those of two classes with FEW
    partners or fewer in their blocks are given as they are; the others as links of each class
    to the least of its crowd.
    """

    def pairs(key: np.ndarray, own: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, d = np.arange(len(key)), 1
        while True:
            i = i[i + d < len(key)]
            i = i[key[i + d] == key[i]]
            if not len(i):
                return
            good = i[~cross[i] | (own[i] != own[i + d])]
            for at in range(0, len(good), 1 << 16):
                yield good[at : at + (1 << 16)], good[at : at + (1 << 16)] + d
            d += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["bucket", "low", "high"]):
            table = table.combine_chunks()
            bucket, node, low, high, own, band = (table[c].to_numpy() for c in ("bucket", "node", "low", "high", "own", "band"))
            bands, values = _bands(table)
            starts = _new(bucket, low, high)
            key = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in pairs(key, own, low != high):
                first = (bands[a] == bands[b]).argmax(1) == band[a]  # else another bucket has the pair
                a, b = a[first], b[first]
                on = surviving(values, a, b, least)
                firsts.append(a[on])
                seconds.append(b[on])
            a, b = np.concatenate(firsts), np.concatenate(seconds)
            if not len(a):
                continue
            partners = np.bincount(a, minlength=len(node)) + np.bincount(b, minlength=len(node))
            few = np.maximum(partners[a], partners[b]) <= FEW
            u, v = np.minimum(node[a[few]], node[b[few]]), np.maximum(node[a[few]], node[b[few]])
            names, place = np.unique(node, return_inverse=True)  # the least of a crowd is then the same in most buckets
            top = roots(len(names), place[a[~few]], place[b[~few]])
            moved = np.flatnonzero(top != np.arange(len(names)))
            u, v = np.concatenate((u, names[moved])), np.concatenate((v, names[top[moved]]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.arange(len(u)) >= few.sum())], names=["u", "v", "crowd"])

    return run


def similar(sets: list[np.ndarray], rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the similarity of each of rows to each of others, places in sets, reaches the threshold."""
    n = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, place, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    new = np.cumsum(count > 1) - 1
    place, owner = new[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((len(rows), len(others)), np.int64)
    wide = int(place[-1]) + 1 if len(place) else 0
    for at in range(0, wide, 4096):
        a, b = np.searchsorted(place, (at, at + 4096))
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[owner[a:b], place[a:b] - at] = 1
        both += (grid[rows] @ grid[others].T).astype(np.int64)
    union = n[rows][:, None] + n[others][None] - both
    return both * AT_LEAST[1] >= AT_LEAST[0] * union


def _verify_crowd(least: list[int]):
    """For each crowd and pair of blocks: copies linked to each node, and the least node of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["component", "low", "high"]):
            table = table.combine_chunks()
            component, node, low, high, own, copies = (table[c].to_numpy() for c in ("component", "node", "low", "high", "own", "copies"))
            bands, values = _bands(table)
            sets = table["shingles"].combine_chunks()
            starts = _new(component, low, high).tolist()
            out: list[list[np.ndarray]] = []
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                at = np.arange(start, end)
                left, right = (at, at) if low[start] == high[start] else (at[own[at] == low[start]], at[own[at] == high[start]])
                # the block's own candidates: pairs that agree in a band and whose posterior holds
                agree = np.zeros((len(left), len(right)), bool)
                for k in range(BANDS):
                    agree |= bands[left, k][:, None] == bands[right, k][None]
                if left is right:
                    agree &= np.tri(len(at), k=-1, dtype=bool)
                i, j = np.nonzero(agree)
                on = surviving(values, left[i], right[j], least)
                i, j = i[on], j[on]
                if not len(i):
                    continue
                rows, i = np.unique(left[i], return_inverse=True)
                others, j = np.unique(right[j], return_inverse=True)
                used = np.union1d(rows, others)
                own_sets = [np.frombuffer(sets[x].as_buffer(), np.int64) for x in used.tolist()]
                good = similar(own_sets, np.searchsorted(used, rows), np.searchsorted(used, others))[i, j]
                a, b = rows[i[good]], others[j[good]]
                if not len(a):
                    continue
                weight = np.zeros(end - start, np.int64)
                np.add.at(weight, a - start, copies[b])
                np.add.at(weight, b - start, copies[a])
                some = np.flatnonzero(weight)
                top = roots(end - start, a - start, b - start)
                out.append([node[start + some], weight[some], node[start + top[some]]])
            if out:
                u, n, v = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n), pa.array(v)], names=["u", "links", "v"])

    return run


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair with both sets that reaches the threshold, the copies of either linked to the other."""
    for batch in batches:
        u, v, u_copies, v_copies = (batch.column(i).to_numpy() for i in range(4))
        good = np.zeros(len(u), bool)
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            a, b = (np.frombuffer(z.as_buffer(), np.int64) for z in (x, y))
            if len(a) * AT_LEAST[1] < AT_LEAST[0] * len(b) or len(b) * AT_LEAST[1] < AT_LEAST[0] * len(a):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            good[i] = both * AT_LEAST[1] >= AT_LEAST[0] * (len(a) + len(b) - both)
        u, v, u_copies, v_copies = u[good], v[good], u_copies[good], v_copies[good]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((u, v), (v_copies, u_copies), (v, u))], names=["u", "links", "v"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: list[bytes] = []
        for first, end, data, offsets in text_slices(batch.column(0)):
            hashes, bounds, _, _ = shingles(data, offsets)
            sets += [np.unique(hashes[bounds[i] : bounds[i + 1]]).tobytes() for i in range(end - first)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], names=[*batch.schema.names[1:], "shingles"])


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, classes): doc_id, k1, k2 of each row; k1, k2, node, rep_id, rep_hash, copies, links, class_id of each class.

    Nodes are numbers given to the classes when they are written, so no two share one.
    """
    sketch = cut(sketched(docs))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = cut(sketch.groupBy("k1", "k2").agg(rep.alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")).select("k1", "k2", F.monotonically_increasing_id().alias("node"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "copies", "bands"))
    banded = classes.filter("bands is not null").select("node", F.posexplode("bands").alias("band", "value")).select("node", "band", F.xxhash64("band", "value").alias("bucket"))
    # written, so that the join exchanges both sides and adaptive execution can split a hot bucket
    crowded = cut(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = banded.join(crowded, "bucket").join(classes.select("node", "bands"), "node")
    least = least_matches()
    found = cut(_blocked(members, "bucket", BUCKET_BLOCK).select("bucket", "low", "high", "own", "band", "node", "bands").mapInArrow(_candidates(least), "u long, v long, crowd boolean"))
    crowds = cut(components(found.filter("crowd").select("u", "v").distinct()))
    # pairs within a crowd are found again, with all the others, by its blocks
    of = lambda end: crowds.select(F.col("node").alias(end), F.col("component").alias(end + "_crowd"))
    pairs = cut(found.filter("not crowd").select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left").filter("u_crowd is null or v_crowd is null or u_crowd != v_crowd").select("u", "v"))
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(crowds.select("node")).distinct()
    wanted = cut(nodes.join(classes.select("node", "rep_id", "rep_hash", "copies"), "node"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), text_hash().alias("text_hash"))
    own = narrowed(own, wanted.select(F.col("rep_hash").alias("text_hash")), "text_hash")
    # one row of each class: rows equal in id and text are the same text
    texts = own.join(wanted, (own["text_hash"] == wanted["rep_hash"]) & own["doc_id"].eqNullSafe(wanted["rep_id"])).select("text", "node", "copies").dropDuplicates(["node"])
    sets = cut(texts.mapInArrow(_shingle_sets, "node long, copies long, shingles binary"))
    end = lambda e: sets.select(F.col("node").alias(e), F.col("copies").alias(e + "_copies"), F.col("shingles").alias(e + "_set"))
    both = pairs.join(end("u"), "u").join(end("v"), "v").select("u", "v", "u_copies", "v_copies", "u_set", "v_set")
    sizes = crowds.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    crowd = crowds.join(sizes, "component").join(classes.select("node", "bands"), "node").join(sets, "node")
    verified = "u long, links long, v long"
    links = cut(both.mapInArrow(_verify_pairs, verified).unionByName(_blocked(crowd, "component", CROWD_BLOCK, SPREAD).mapInArrow(_verify_crowd(least), verified)))
    final = components(links)
    linked = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.drop("bands").join(final, "node", "left").join(linked, "node", "left")
    named = cut(named.select("k1", "k2", "node", "rep_id", "rep_hash", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component")))
    # written, so that the join exchanges both sides and adaptive execution can split a large component
    first = cut(named.groupBy("component").agg(F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "rep_hash")).alias("first")))
    return sketch.select("doc_id", "k1", "k2"), named.join(first, "component")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs.

    n_links counts the other rows whose similarity, of lower-cased word five-grams, is 0.8 or
    more, copies included; class_id is the least doc_id of those linked directly or through
    others. docs needs doc_id and text; other columns are ignored. Texts without words, nulls
    among them, are copies of each other and of nothing else. Texts of one to four words are
    one shingle. Repeated rows are copies; rows without an id are never the least of a class
    that has one. An empty table gives an empty result.
    """
    rows, classes = joined(docs)
    return rows.join(classes.select("k1", "k2", F.col("first.rep_id").alias("class_id"), F.col("links").alias("n_links")), ["k1", "k2"]).drop("k1", "k2")


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked texts, that with the least doc_id; columns unchanged.

    Nulls, empty texts and groups are as in report(). Of rows equal in doc_id and text one
    stays. Columns may have any names; an empty table stays empty.
    """
    _, classes = joined(docs)
    first = classes.select(F.col("first.rep_id").alias("id"), F.col("first.rep_hash").alias("hash")).distinct()
    rows = docs.select(F.struct("*").alias("row")).withColumns({"own_id": F.col("row.doc_id").cast("long"), "own_hash": F.xxhash64(F.coalesce("row.text", F.lit("")))})
    kept = rows.join(first, (F.col("own_hash") == F.col("hash")) & F.col("own_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["own_hash", "own_id"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
