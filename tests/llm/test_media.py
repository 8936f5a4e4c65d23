"""Media: short documents are cut too, and what is read comes from written tables."""

from __future__ import annotations

import hashlib

import numpy as np

from furrow.llm import common, media


def test_short_media_share_chunks():
    draws = np.random.default_rng(5)
    a, b, passage = (draws.integers(97, 123, n, dtype=np.uint8).tobytes().decode() for n in (600, 600, 2400))
    one, other = (set(media.chunks(media.stored(media.payload_of(text)[1]))) for text in (a + passage, b + passage))
    assert sum(len(data) for _, data in one & other) > 0


def test_media_are_stored_and_read_from_there(spark):
    texts = ["one passage " * 900, "one passage " * 900 + "and more", "short", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = media.stored_and_read(docs)
    folders = {f.partition("/media-")[2].partition("/")[0] for f in got.inputFiles()}
    assert len(folders) == 1 and folders != {""}
    path = f"{common.shared_dir(spark)}/media-{folders.pop()}"
    manifest, packed, store, zdict = media.tables(spark, path)
    reader = media.reader_of(zdict)
    own = {(x["media"], a): d for x in packed.collect() for a, d in zip(x["at"], x["data"], strict=True)}
    shared = {x["digest"]: x["data"] for x in store.collect()}
    assert packed.count() == packed.select("media").distinct().count() and store.count() == len(shared)
    for x in manifest.collect():  # each chunk stands in one place
        parts = [own.get((x["media"], i), shared.get(d)) for i, d in enumerate(x["digests"])]
        assert all(((x["media"], i) in own) != (d in shared) for i, d in enumerate(x["digests"]))
        assert b"".join(map(reader.decompress, parts)) == media.stored(media.payload_of(texts[x["doc_id"]])[1])
    assert len({hashlib.sha256(reader.decompress(d)).digest() for d in own.values()}) == len(own)
    assert shared and own
    assert {x["doc_id"]: x["media_sha256"] for x in got.collect()} == {d: hashlib.sha256(media.stored(media.payload_of(t)[1])).hexdigest() for d, t in enumerate(texts)}
