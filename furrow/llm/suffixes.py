"""Removal of long repeated byte strings by bucket refinement of a sparse set of suffixes.

A string here is LENGTH bytes. Of its q-grams the one with the least hash is its anchor, so equal
strings have equal anchors at the same offset, and only suffixes that start at anchors are put in
buckets: one in about 60 of all. The initial bucket of a suffix is its q-gram. A bucket of one
suffix is done: no string with that anchor is repeated. The other buckets are refined by what
stands around the anchor, up to the first and last byte of any string that has this anchor
here. Places that still share a bucket after that have all their strings in common. What is left
are places at the ends of repeats, whose bucket's members differ somewhere. Each of them stands for
a range of offsets of its strings; a round cuts the ranges into ARMS parts and sorts again on the
identifier of the bytes that all strings of a part have, then on that of all bytes of the part.
Buckets that come apart are done, as are parts that are equal as a whole; the refined buckets are
what the next round cuts, until a part is a single string.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut, deleted, shared_dir, text_slices
from .substrings import least_places

LENGTH, GRAM = 200, 64
#: Parts into which a round cuts a range of offsets.
ARMS = 6
#: Bytes of text, and places, handled at once: arrays of some dozen times as many bytes stand in memory.
SLICE_BYTES, SLICE_PLACES = 1 << 18, 1 << 10
#: Rows without an id are told apart by their texts.
LAST = (1 << 63) - 1
#: A place: the first string that has the anchor, the anchor's offset in it and the number of such strings, in one long.
PLACE_BITS = 8


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts data[at[i]:at[i + 1]]: (anchors of each, q-gram, hash of all strings of the anchor, place)."""
    windows = np.maximum(np.diff(at) - LENGTH + 1, 0)
    nothing = np.zeros(0, np.uint64)
    if not windows.any():
        return np.zeros(len(windows), np.int64), nothing, nothing, nothing.astype(np.int64)
    own = data.astype(np.uint64) + np.uint64(1)
    grams = words.gram_hashes(own, GRAM)
    rows = np.repeat(np.arange(len(windows)), windows)
    start = at[:-1][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows)
    chosen = least_places(grams, LENGTH - GRAM + 1)[start].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1]))))
    first, many = start[new], np.diff(np.concatenate((new, [len(rows)])))
    chosen, rows = chosen[new], rows[new]
    offset = chosen - first
    hulls = words.mix(words.span_hashes(own, first, first + many - 1 + LENGTH) ^ words.mix(offset.astype(np.uint64)))
    place = ((first - at[:-1][rows]) << 2 * PLACE_BITS) | (offset << PLACE_BITS) | (many - 1)
    return np.bincount(rows, minlength=len(windows)), grams[chosen], hulls, place


SKETCH = "r long, doc_id long, text_hash long, n_bytes long, kept_sha256 string, grams array<long>, hulls array<long>, places array<long>"


def sketched(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its number r, its key, length and digest, and its anchors."""
    names = [x.split()[0] for x in SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(3), SLICE_BYTES):
                n, grams, hulls, places = anchors(data, offsets)
                raw = data.tobytes()
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                bounds = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.view(np.int64))) for x in (grams, hulls, places)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(3)), pa.array(np.diff(offsets)), pa.array(digests), *lists], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return rows.mapInArrow(run, SKETCH)


def packed(docs: DataFrame) -> DataFrame:
    """(did, text_hash, packed) of docs: their key, and their texts compressed for the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pa.array([packer.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], names=["did", "text_hash", "packed"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return keyed.mapInArrow(run, "did long, text_hash long, packed binary")


CONTEXT = "rep long, gram long, mult long, high int, many int, around binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each place wanted in a text: the bytes of all strings of its anchor, the anchor's greatest offset and the number of strings."""
    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = reader.decompress(text)
            for w in wanted:
                first, high, many = w["place"] >> 2 * PLACE_BITS, (w["place"] >> PLACE_BITS) & 255, (w["place"] & 255) + 1
                for c, v in zip(columns, (w["rep"], w["gram"], w["mult"], high, many, raw[first : first + many - 1 + LENGTH]), strict=True):
                    c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["rep", "gram", "mult", "high", "many", "around"])


PARTS = "rep long, gram long, mult long, x int, y int, low int, high int, core long, whole long"


def _parts(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts each place's range of offsets from x to y into parts of size: hashes of the bytes that all strings of a part have, and of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE_PLACES) for b in batches for i in range(0, b.num_rows, SLICE_PLACES)):
            rep, gram, mult, top, many, x, y = (batch.column(c).to_numpy().astype(np.int64) for c in ("rep", "gram", "mult", "high", "many", "x", "y"))
            around = batch.column("around")
            bounds = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + batch.num_rows + 1].astype(np.int64)
            data = np.frombuffer(around.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64) + np.uint64(1)
            base = bounds[:-1] - bounds[0]
            n = (y - x) // size + 1
            row = np.repeat(np.arange(len(n)), n)
            px = x[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
            py = np.minimum(px + size - 1, y[row])
            low, high = np.maximum(px, (top - many + 1)[row]), np.minimum(py, top[row])
            here = low <= high
            row, px, py, low, high = row[here], px[here], py[here], low[here], high[here]
            anchor = base[row] + top[row]
            salt = words.mix((px * 256 + py).astype(np.uint64))
            core = words.mix(words.span_hashes(data, anchor - px, anchor - py + LENGTH) ^ salt)
            whole = words.mix(words.span_hashes(data, anchor - high, anchor - low + LENGTH) ^ words.mix((low * 256 + high).astype(np.uint64)))
            ints = [pa.array(v.astype(np.int32)) for v in (px, py, low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(v[row]) for v in (rep, gram, mult)] + ints + [pa.array(v.view(np.int64)) for v in (core, whole)], names=[c.split()[0] for c in PARTS.split(", ")])

    return run


def refined(contexts: DataFrame) -> list[DataFrame]:
    """(rep, low, high) of places that stand for themselves alone, in rounds: offsets of strings that occur elsewhere."""
    size, out = LENGTH - GRAM + 1, []
    cut_up = contexts.withColumns({"x": F.lit(0), "y": F.lit(size - 1)})
    while size > 1:
        size = -(-size // ARMS)
        parts = cut_up.mapInArrow(_parts(size), PARTS)
        buckets = parts.groupBy("gram", "core", "whole").agg(F.sum("mult").alias("n"), F.min("rep").alias("first"))
        # a bucket of one place is done; so is one whose members are equal as a whole
        counted = buckets.groupBy("gram", "core").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("all > 1")
        told = parts.join(buckets.join(counted, ["gram", "core"]), ["gram", "core", "whole"])
        goes_on = (F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("rep") == F.col("first")))
        found = cut(told.select("rep", "x", "y", "low", "high", F.least("n", F.lit(2)).cast("long").alias("mult"), ((F.col("n") > 1) & (F.col("mult") == 1)).alias("settled"), goes_on.alias("open")).filter("settled or open"))
        out.append(found.filter("settled").select("rep", "low", "high"))
        left = found.filter("open").select("rep", "x", "y", "mult").distinct()
        cut_up = contexts.drop("mult").join(left, "rep")
    return out


RANGES = "array<struct<a:long,b:long>>"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the bytes of all ranges from each text."""
    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        gone, spans, digests = [], [], []
        for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw, digest, at, n, runs = reader.decompress(text), hashlib.sha256(), 0, 0, 0
            for x in sorted((x["a"], x["b"]) for x in ranges):
                if x[0] > at or not runs:
                    digest.update(raw[at : x[0]])
                    runs += 1
                    at = x[0]
                n += max(0, x[1] - at)
                at = max(at, x[1])
            digest.update(raw[at:])
            gone.append(n)
            spans.append(runs)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["did", "text_hash", "gone", "spans", "kept"])


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges): each row of docs (r, doc_id, text_hash, n_bytes, kept_sha256), and of those with repeats the byte ranges (r, ranges).

    Ranges may overlap. Rows with equal texts and ids repeat each other.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}"
    sketched(docs).write.option("compression", "zstd").parquet(f"{folder}/sketch")
    sketch = spark.read.parquet(f"{folder}/sketch")
    rows = cut(sketch.drop("grams", "hulls", "places"))
    suffixes = sketch.select("r", F.explode(F.arrays_zip("grams", "hulls", "places")).alias("s")).select("r", F.col("s.grams").alias("gram"), F.col("s.hulls").alias("hull"), F.col("s.places").alias("place"))
    # written once, so that the join exchanges both sides and adaptive execution can split a hot bucket
    buckets = suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("hull").alias("least"), F.max("hull").alias("most")).filter("n > 1")
    member = suffixes.join(cut(buckets.select("gram", (F.col("least") == F.col("most")).alias("same"))), "gram")
    split = F.when(~F.col("same"), F.struct("place", "gram", "hull"))
    verdicts = cut(member.groupBy("r").agg(F.collect_list(F.when(F.col("same"), F.col("place"))).alias("settled"), F.collect_list(split).alias("split")))
    deleted(spark, folder)
    places = verdicts.select("r", F.explode("split").alias("s")).select("r", "s.*")
    classes = cut(places.groupBy("gram", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r", "place")).alias("least")).select("gram", "hull", "n", "least.r", "least.place", F.monotonically_increasing_id().alias("rep")))
    alike = places.join(classes.filter("n > 1").select("gram", "hull"), ["gram", "hull"]).select("r", "place")
    keys = rows.select("r", F.coalesce("doc_id", F.lit(LAST)).alias("did"), "text_hash")
    wanted = classes.groupBy("r").agg(F.collect_list(F.struct("rep", "gram", "place", F.least("n", F.lit(2)).cast("long").alias("mult"))).alias("wanted"))
    texts = packed(docs).join(keys.join(wanted, "r"), ["did", "text_hash"])
    texts.select("packed", "wanted").mapInArrow(_contexts, CONTEXT).write.option("compression", "zstd").parquet(f"{folder}/contexts")
    rounds = refined(spark.read.parquet(f"{folder}/contexts"))
    deleted(spark, folder)
    first, high, more = (F.shiftright("place", 2 * PLACE_BITS), F.shiftright("place", PLACE_BITS).bitwiseAND(255), F.col("place").bitwiseAND(255))
    span = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    found = alike.select("r", span(first, first + more + LENGTH).alias("range"))
    for ends in rounds:
        found = found.unionByName(ends.join(classes.select("rep", "r", "place"), "rep").select("r", span(first + high - F.col("high"), first + high - F.col("low") + LENGTH).alias("range")))
    whole = verdicts.filter(F.size("settled") > 0).select("r", F.transform("settled", lambda p: F.struct(F.shiftright(p, 2 * PLACE_BITS).alias("a"), (F.shiftright(p, 2 * PLACE_BITS) + p.bitwiseAND(255) + LENGTH).alias("b"))).alias("ranges"))
    some = found.groupBy("r").agg(F.collect_list("range").alias("ranges"))
    return rows, whole.unionByName(some).groupBy("r").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    A byte goes if a string of 200 bytes that covers it also starts at another place, of the same
    row or another. docs needs doc_id and text; other columns are ignored. A null text is empty;
    texts under 200 bytes stay whole. Repeated rows remove each other. An empty table gives an
    empty result.
    """
    rows, ranges = repeats(docs)
    key = ["did", "text_hash"]
    keyed = rows.withColumn("did", F.coalesce("doc_id", F.lit(LAST)))
    wanted = cut(keyed.select("r", *key).join(ranges, "r").drop("r").dropDuplicates(key))
    done = packed(docs).join(wanted, key).select(*key, "packed", "ranges").dropDuplicates(key).mapInArrow(_removed, "did long, text_hash long, gone long, spans long, kept string")
    out = keyed.join(done, key, "left")
    return out.select("doc_id", "n_bytes", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "kept_sha256").alias("kept_sha256"))


#: Texts are cut into overlapping pieces, as a string is cut out of a short text sooner.
SQL = """WITH b AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents), n AS (SELECT r, doc_id, t, length(t) // 2 AS n FROM b),
 pieces AS MATERIALIZED (SELECT r, at0, n, t[2 * at0 + 1:2 * at0 + 1198] AS t FROM (SELECT r, t, n, unnest(range(0, n - 199, 400)) AS at0 FROM n)),
 w AS MATERIALIZED (SELECT r, at0 + i AS i, md5_number(t[2 * i + 1:2 * i + 400]) AS h FROM (SELECT r, t, at0, unnest(range(0, least(400, n - 199 - at0))) AS i FROM pieces)),
 k AS (SELECT r, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
 s AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM k)),
 p AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM s GROUP BY r, run), q AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM p),
 o AS (SELECT r, sum(z - a) AS removed, count(*) AS spans, max(z) AS last FROM p GROUP BY r), c AS (SELECT q.r, string_agg(t[2 * f + 1:2 * a], '' ORDER BY a) AS kept FROM q JOIN n USING (r) GROUP BY q.r)
 SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(c.kept || t[2 * last + 1:], t))) AS kept_sha256 FROM n LEFT JOIN o USING (r) LEFT JOIN c USING (r)"""
