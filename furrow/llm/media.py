"""Content-defined chunking of media payloads.

A payload is stored as a WAV file of 8-bit samples. A rolling gear hash cuts the file where its
top bits are zero, so that equal passages give equal chunks wherever they stand. A medium is the
ordered list of its chunks' digests. Chunks are deduplicated by digest through Spark, and each is
stored once, compressed with a dictionary: one that occurs once stands in its medium's pack, the
others in a table of chunks of their own. All are tables in the shared folder, which Spark's
committer writes. Reading joins the packs with the chunks that they lack, puts the files together
and verifies them.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_by_hash, shared_dir

#: Payloads are padded to a multiple of so many bytes.
UNIT = 64
#: Least and most bytes of a chunk, and the zero bits at which it is cut (2**BITS bytes on average after the least).
LEAST, MOST, BITS = 256, 131_072, 10
#: Slots of the filter of repeated chunks, a bit each: what is broadcast, however many there are.
SLOTS = 1 << 24
#: Documents from whose chunks the dictionary is trained, the largest of them in bytes, and its size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 16, 1 << 18
#: Bytes that the rolling hash sees.
SEEN = 32
RATE = 8000
LEVEL = 6
GEAR = np.random.default_rng(8_675_309).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text in UTF-8 with bytes 0 up to a positive multiple of UNIT)."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def stored(payload: bytes) -> bytes:
    """The payload as the samples of a mono 8-bit WAV file."""
    head = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload)) + head + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file."""
    kind, size, form = struct.unpack_from("<4sI4s", media)
    if kind != b"RIFF" or form != b"WAVE" or size + 8 != len(media):
        raise ValueError("not a WAV file")
    at = 12
    while True:
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last SEEN bytes, by doubling."""
    h, span = GEAR[data], 1
    while span < SEEN:
        new = h.copy()
        new[span:] += h[:-span] << np.uint32(span)
        h, span = new, span * 2
    return h


def cuts(media: bytes) -> list[int]:
    """The ends of the chunks."""
    data = np.frombuffer(media, np.uint8)
    marks = (np.flatnonzero(rolling(data) >> np.uint32(32 - BITS) == 0) + 1).tolist() if len(data) > LEAST else []
    out, start = [], 0
    while len(data) - start > LEAST:
        i = bisect_left(marks, start + LEAST)
        end = min(marks[i] if i < len(marks) else len(data), start + MOST, len(data))
        out.append(end)
        start = end
    if start < len(data):
        out.append(len(data))
    return out


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk in order."""
    start = 0
    for end in cuts(media):
        part = media[start:end]
        yield hashlib.sha256(part).digest(), part
        start = end


def manifests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, digests): each row's medium, named by the digest of its file, and its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, lists = [], [], []
            for text in batch.column(1).to_pylist():
                n, payload = payload_of(text)
                media = stored(payload)
                sizes.append(n)
                names.append(hashlib.sha256(media).digest())
                lists.append([d for d, _ in chunks(media)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "digests"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_bytes long, media binary, digests array<binary>")


class Slots:
    """A filter of digests: all that are in it, and a few that are not, are repeated."""

    def __init__(self, bits: bytes, n: int) -> None:
        self.bits, self.n = bits, n

    def __contains__(self, digest: bytes) -> bool:
        slot = int.from_bytes(digest[:3]) % self.n
        return bool(self.bits[slot >> 3] >> (slot & 7) & 1)


def repeated(manifest: DataFrame) -> Slots:
    """The filter of chunks that occur more than once in a manifest: bitmaps that Spark builds, SLOTS / 8 bytes in all."""
    each = manifest.select(F.explode("digests").alias("digest")).groupBy(F.substring("digest", 1, 10).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    place = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long") % SLOTS + 1
    maps = each.filter("n > 1").select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = bytearray(SLOTS // 8)
    for row in maps.collect():
        at = (row["bucket"] - 1) * len(row["bits"])
        bits[at : at + len(row["bits"])] = row["bits"]
    return Slots(bytes(bits), SLOTS)


def dictionary(docs: DataFrame) -> bytes:
    """A dictionary for chunks, trained on those of a bounded sample of documents; empty where they are too few."""
    rows = first_by_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length("text") <= SAMPLE_BYTES), SAMPLE, "doc_id").collect()
    parts = [part for r in rows for _, part in chunks(stored(payload_of(r["text"])[1]))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, k=256, d=8, level=LEVEL).as_bytes() if parts else b""
    except zstandard.ZstdError:
        return b""


def packer_of(zdict: bytes) -> zstandard.ZstdCompressor:
    if not zdict:
        return zstandard.ZstdCompressor(level=LEVEL)
    shared = zstandard.ZstdCompressionDict(zdict)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


def reader_of(zdict: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zdict)) if zdict else zstandard.ZstdDecompressor()


PACK = "media binary, n int, at array<int>, data array<binary>, lacks array<struct<at:int,digest:binary>>"
PACK_TYPES = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.struct([("at", pa.int32()), ("digest", pa.binary())]))]
PACK_NAMES = ["media", "n", "at", "data", "lacks"]


def _pack_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(PACK_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PACK_TYPES, strict=True)], names=PACK_NAMES)


def packs(docs: DataFrame, manifest: DataFrame, slots, zdict: bytes) -> DataFrame:
    """A row for each medium: its number of chunks, those of its own with their places, and the digests of the others.

    A medium with a chunk of its own occurs once and comes from its text; one without comes
    from the manifest, once.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, twice = packer_of(zdict), slots.value
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                media = stored(payload_of(text)[1])
                at, data, lacks, n = [], [], [], 0
                for digest, part in chunks(media):
                    if digest in twice:
                        lacks.append({"at": n, "digest": digest})
                    else:
                        at.append(n)
                        data.append(packer.compress(part))
                    n += 1
                if at:
                    rows.append((hashlib.sha256(media).digest(), n, at, data, lacks))
            yield _pack_batch(rows)

    def none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = slots.value
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _pack_batch([(media, len(digests), [], [], [{"at": i, "digest": d} for i, d in enumerate(digests)]) for media, digests in rows if all(d in twice for d in digests)])

    return docs.select("text").mapInArrow(own, PACK).unionByName(manifest.select("media", "digests").mapInArrow(none, PACK).dropDuplicates(["media"]))


def chunk_store(docs: DataFrame, slots, zdict: bytes) -> DataFrame:
    """(digest, data): every repeated chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, twice = packer_of(zdict), slots.value
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for text in batch.column(0).to_pylist():
                for digest, part in chunks(stored(payload_of(text)[1])):
                    if digest in twice and digest not in found:
                        found[digest] = packer.compress(part)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "data"])

    return docs.select("text").mapInArrow(run, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))


def described(payload: bytes) -> str:
    """Features of 8-bit samples: count, mean, deviation, crossings of the middle, different values."""
    x = np.frombuffer(payload, np.uint8)
    n, total, squares = len(x), int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    deviation = max(0, n * squares - total * total) ** 0.5 / n
    return f"n={n};mean={total / n:.4f};std={deviation:.4f};zc={crossings};values={np.count_nonzero(np.bincount(x, minlength=256))}"


READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described_batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """The values of media (name, file), each verified against its name."""
    out = []
    for media, whole in rows:
        name = hashlib.sha256(whole)
        if name.digest() != media:
            raise ValueError("a medium differs from its name")
        payload = samples(whole)
        out.append((media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(whole), name.hexdigest(), described(payload)))
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)


def read(packed: DataFrame, store: DataFrame, zdict: bytes) -> DataFrame:
    """Each medium put together from its pack and the store, verified and described."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(zdict)
        for batch in batches:
            rows = []
            for media, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(data) != n:
                    raise ValueError("a chunk is missing")
                rows.append((media, b"".join(map(reader.decompress, data))))
            yield _described_batch(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = reader_of(zdict), []
        for batch in batches:
            rows: list[tuple[bytes, bytes]] = []
            for media, at, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != len(held) or data is None:
                    raise ValueError(f"chunk {len(held)} is missing")
                held.append(reader.decompress(data))
                if len(held) == n:
                    rows.append((media, b"".join(held)))
                    held = []
            yield _described_batch(rows)
        if held:
            raise ValueError("the last chunks of a medium are missing")

    complete = packed.filter("size(lacks) = 0").select("media", "n", "data").mapInArrow(whole, READ)
    rest = packed.filter("size(lacks) > 0")
    lacking = rest.select("media", "n", F.explode("lacks").alias("c")).select("media", "n", "c.at", "c.digest").join(store, "digest", "left").select("media", "at", "n", "data")
    own = rest.select("media", "n", F.explode(F.arrays_zip("at", "data")).alias("c")).select("media", "c.at", "n", "c.data")
    parts = own.unionByName(lacking).repartition("media").sortWithinPartitions("media", "at")
    return complete.unionByName(parts.mapInArrow(joined, READ))


def write(docs: DataFrame, path: str) -> None:
    """Writes manifest, packs, chunks and dictionary of all rows as tables at path."""
    spark = docs.sparkSession
    put = lambda df, name: df.write.option("compression", "uncompressed").parquet(f"{path}/{name}")
    put(manifests(docs), "manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    zdict = dictionary(docs)
    put(spark.createDataFrame([(bytearray(zdict),)], "dictionary binary"), "dictionary")
    slots = spark.sparkContext.broadcast(repeated(manifest))
    put(packs(docs, manifest, slots, zdict), "packs")
    put(chunk_store(docs, slots, zdict), "chunks")


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, bytes]:
    """The manifest, packs, chunks and dictionary at path."""
    manifest, packed, store = (spark.read.parquet(f"{path}/{n}") for n in ("manifest", "packs", "chunks"))
    return manifest, packed, store, bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def stored_and_read(docs: DataFrame) -> DataFrame:
    """Writes the media of docs to the shared folder and reads them back, a row for each row of docs.

    docs needs doc_id and text; other columns are ignored. A null or empty text is a payload of
    UNIT bytes 0. Equal texts are one medium and have equal values; repeated rows stay. An empty
    table gives an empty result.
    """
    path = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    write(docs, path)
    manifest, packed, store, zdict = tables(docs.sparkSession, path)
    return manifest.select("doc_id", "n_bytes", "media").join(read(packed, store, zdict), "media").drop("media")
