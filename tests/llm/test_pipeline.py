"""The corpus pipeline on the smallest tables."""

from __future__ import annotations

import re

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir)
        if name != "mixing":
            assert out.columns == columns
            assert out.count() <= now.count()
        now = spark.createDataFrame(out.collect(), out.schema)
    assert now.count() > 0 and "mix_copy" in now.columns
    ids = {r["doc_id"] for r in docs.collect()}
    for r in now.collect():
        assert r["doc_id"] in ids and r["n_chars"] == len(r["text"])
        assert not re.search(r"@mail\d\.example", r["text"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "personal data", "mixing"]


def test_run_equals_stages(spark, sf_dir, tmp_path):
    """run() gives what the stages give that are applied by hand, each on what the one before has kept."""
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [now.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == now.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, now.collect()))


def test_awkward_tables(spark, sf_dir, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names and an empty table go through all stages."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, __own string, k int, spans string"
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "a plain text of some words here"), (3, "a plain text of some words here"), (None, "no id but words in it too"), (None, None), (4, long), (5, "mail me at a.b@mail.example.com"), (6, "a plain text of some words here")]
    docs = spark.createDataFrame([(i, t, "en", None if i == 2 else "s", len(t or ""), "r", "o", 1, "x") for i, t in rows], columns)
    for now in (docs, docs.limit(0)):
        n = now.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf_dir)
            path = f"{tmp_path}/{name.replace(' ', '_')}-{n}"
            out.write.parquet(path)
            if name != "mixing":
                assert out.columns == docs.columns
            now = spark.read.parquet(path)
        got = now.collect()
        if not n:
            assert got == []
            continue
        texts = {r["text"] for r in got}
        assert "mail me at <email>" in texts or not any("mail me" in (t or "") for t in texts)
        assert {r["doc_id"] for r in got} <= {1, 3, 4, 5, None} and all(r["row"] == "r" and r["__own"] == "o" for r in got)
