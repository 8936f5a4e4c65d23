"""Dictionary-compressed WARC archives.

A Zstandard dictionary is trained on a bounded sample of records and stands in a skippable
frame at the start of each archive; every record is a frame of its own. Equal payloads are
written once, other records revisit the one that holds them. Archives are rows of bytes in a
table in the shared folder, which Spark's committer writes, so that a lost executor leaves no
partial archive; export() has the executors make files of them, in any file system.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, first_by_hash, parted, shared_dir

#: Records to train on, the largest of them in bytes, and the dictionary's size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 16, 1 << 16
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 4 << 20
LEVEL = 3
# Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    """The same for the same page, payload and number among rows equal in both, and for no other record."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}' + (f'/{copy}' if copy else ''))}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, block: bytes, fields: dict[str, str]) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, is_response: bool, copy: int = 0) -> bytes:
    """The record of a page: a response with its payload, or a revisit of page first's; copy numbers equal rows."""
    digest = base32(hashlib.sha1(payload).digest())
    fields = {"WARC-Record-ID": record_id(page_id, digest, copy), "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        fields["WARC-Target-URI"] = clean(url)
    fields["WARC-Payload-Digest"] = f"sha1:{digest}"
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if not is_response:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(first, digest)}
        if first is not None:
            fields["X-Refers-To-Page-Id"] = str(first)
    fields["Content-Type"] = "application/http; msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("response" if is_response else "revisit", http + payload if is_response else http, fields)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:n]


def train(pages: DataFrame, sample: int = SAMPLE) -> bytes:
    """A dictionary from whole records: about the first sample by hash, those over SAMPLE_BYTES left out."""
    first = first_by_hash(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), sample, "page_id")
    rows = first.filter(F.octet_length(F.coalesce("html", F.lit(""))) <= SAMPLE_BYTES).collect()
    records = [page_record(r["page_id"], r["url"], (r["html"] or "").encode(), None, True) for r in rows]
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few records: their own bytes serve
        return b"".join(records)[:DICTIONARY_BYTES]


def archive_start(dictionary: bytes) -> bytes:
    """The leading skippable frame, which holds the dictionary."""
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def frames(archive: bytes) -> Iterator[tuple[int, int]]:
    """Where each frame after the leading one starts and ends, from the block headers."""
    at = 0
    while at < len(archive):
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError("not a Zstandard frame")
        start = at
        about = archive[at + 4]
        single = about >> 5 & 1
        at += 5 + (not single) + (0, 1, 2, 4)[about & 3] + (single, 2, 4, 8)[about >> 6]
        last = False
        while not last:
            head = int.from_bytes(archive[at : at + 3], "little")
            last = bool(head & 1)
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        at += 4 * (about >> 2 & 1)
        yield start, at


def records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, read with the dictionary that it carries."""
    dictionary = None
    if len(archive) >= 8:
        magic, size = struct.unpack_from("<II", archive)
        if magic == SKIPPABLE:
            dictionary = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    for a, b in frames(archive):
        yield reader.decompress(archive[a:b])


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first, copy): for each page, the page whose record holds its payload, and its number among equal rows.

    Of equal payloads of at least least_bytes, the one with the largest page_id; smaller ones
    hold their own. Only digests are grouped, and only payloads of several rows are joined.
    """
    payload = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    # written, so that adaptive execution can split the join at a hot payload
    light = own.select("page_id", "digest", "n")
    shared = cut(light.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).filter("rows > 1").select("digest", "largest", (F.col("n") >= least_bytes).alias("long")))
    # rows equal in page and payload, numbered: their hosts and texts need not differ
    again = cut(light.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.lit(True).alias("again")))
    key = F.xxhash64("digest")
    maybe, unique = parted(own.withColumn("key", key), shared.select(key.alias("key")), "key")
    once = unique.select("page_id", "url", "html", F.col("page_id").alias("first"), F.lit(0).cast("long").alias("copy"))
    first = F.when(F.coalesce("long", F.lit(False)), F.col("largest")).otherwise(F.col("page_id"))
    known = maybe.join(shared, "digest", "left").select("page_id", "url", "html", "digest", first.alias("first"))
    if again.isEmpty():
        return once.unionByName(known.drop("digest").withColumn("copy", F.lit(0).cast("long")))
    same = known["page_id"].eqNullSafe(again["p"]) & (known["digest"] == again["d"])
    alone = known.join(again, same, "left_anti").drop("digest").withColumn("copy", F.lit(0).cast("long"))
    # written with numbers; of equal rows the least numbered has the id that revisits refer to
    numbered = cut(known.join(again, same).drop("again", "p", "d").withColumn("id", F.monotonically_increasing_id()))
    least = numbered.groupBy(F.col("page_id").alias("p"), F.col("digest").alias("d")).agg(F.min("id").alias("least"))
    copies = numbered.join(least, numbered["page_id"].eqNullSafe(least["p"]) & (numbered["digest"] == least["d"]))
    return once.unionByName(alone).unionByName(copies.select("page_id", "url", "html", "first", F.when(F.col("id") == F.col("least"), 0).otherwise(F.col("id") + 1).alias("copy")))


def write(pages: DataFrame, path: str, least_bytes: int = 0, dictionary: bytes | None = None) -> None:
    """Writes archives of all pages as a table (archive, records, data) at path."""
    zdict = train(pages) if dictionary is None else dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(zdict) if zdict else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True) if shared else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        number, part = 0, TaskContext.get().partitionId()

        def opened() -> list[bytes]:
            info = f"software: furrow\r\nformat: WARC File Format 1.1\r\nisPartOf: {part}-{number}\r\n".encode()
            fields = {"WARC-Record-ID": record_id(None, f"{part}-{number}"), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Filename": f"pages-{part:06d}-{number:06d}.warc.zst", "Content-Type": "application/warc-fields"}
            return [archive_start(zdict), packer.compress(record("warcinfo", info, fields))]

        def closed(parts: list[bytes], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{number:06d}.warc.zst"]), pa.array([n], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["archive", "records", "data"])

        parts, n, size = opened(), 0, 0
        for batch in batches:
            for page_id, url, html, first, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frame = packer.compress(page_record(page_id, url, (html or "").encode(), first, first == page_id, copy))
                parts.append(frame)
                n, size = n + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    yield closed(parts, n)
                    number += 1
                    parts, n, size = opened(), 0, 0
        if n:
            yield closed(parts, n)

    decided(pages, least_bytes).mapInArrow(run, "archive string, records long, data binary").write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records of the archives at path.

    A response's digest and length are those of the payload read; they must be as its header says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for raw in records(data.as_py()):
                    fields, block = parse(raw)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n, digest = int(http.rpartition(b"Content-Length: ")[2]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload), base32(hashlib.sha1(payload).digest())) != (n, digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its header")
                    page, refers = (int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
                    rows.append((page, fields.get("WARC-Target-URI"), n, digest, fields["WARC-Type"], refers))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.parquet(path).select("data").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(spark: SparkSession, path: str, folder: str) -> int:
    """Writes each archive at path as a file in folder, a path or URI that the executors reach; the number of files.

    Each task writes under a name of its own and then moves the file to its place, so that a
    task that is lost and run again leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        system.create_dir(top, recursive=True)
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                part = f"{top}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(data.as_buffer())
                system.move(part, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["archive"])

    return spark.read.parquet(path).select("archive", "data").mapInArrow(run, "archive string").count()


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, a row for each page.

    pages needs page_id, url and html; other columns are ignored. A null html is empty, a null
    url is left out. A null page_id counts as less than every other. Rows equal in page_id and
    payload are of the same type, so a repeated response is written again, under an id of its own;
    revisits refer to one of them. An empty table
    gives no archive and no row.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least_bytes)
    return read(pages.sparkSession, path)
