"""The Merkle manifest against trees built one node after the other."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from furrow.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """The root, and of each leaf its proof as (before, after) texts."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = p // fanout * fanout
            proofs[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + fanout])))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        place = [p // fanout for p in place]
    return nodes[0], proofs


def expected(rows, fanout=16):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r[:5]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fanout) for s in names}
    root, above = tree([subroots[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above):
        for (_, _, own, r), low in zip(sorted(by[s], key=lambda x: x[:3]), subroots[s][1]):
            new = list(r[:5])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                new[4] = "".join(c.lower() if c.isascii() else c for c in r[4])
            d = leaf(new)
            for before, after in low + up:
                d = h(before, d, after)
            out.append((r[0], own, subroots[s][0], root, h(*[b + a for b, a in low + up]), d, d == root))
    return sorted(out, key=str)


def rows_of(n):
    """Sources of very different sizes, nulls in every column, repeated rows and ids, empty and long texts."""
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(n)]
    rows += [(i, f"s{i:03}", None, None, "ÄB") for i in range(300, 320)]
    rows += [(1, None, "en", 3, None), (None, "hot", None, None, None), (7, "ß", "de", 0, ""), (7, "ß", "de", 0, ""), (7, "ß", "de", 1, "A" * 100_000), (None, None, None, None, "X")]
    return [(*r, "clash", 1) for r in rows]


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 530])
def test_report(spark, n):
    rows = rows_of(n)
    got = manifest.report(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_more_rounds(spark):
    """Superblocks of two levels of three: many rounds up and down."""
    rows = [(i, "a" if i % 5 else "b", "en", i, "t") for i in range(400)]
    frame = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    leaves = frame.select(frame["source"].alias("tree"), frame["doc_id"].alias("id"), manifest.leaf_of([frame[c] for c in manifest.COLUMNS]).alias("leaf"), frame["doc_id"].alias("row"))
    out = manifest.manifest(leaves, 3, 2).withColumn("again", manifest.folded(manifest.F.col("leaf"), manifest.F.col("proof")))
    want = {r[0]: r for r in expected([(*r, "", 0) for r in rows], 3)}
    got = out.collect()
    assert len(got) == 400 and all(r["again"] == r["root"] and (r["leaf"], r["subroot"], r["root"]) == want[r["row"]][1:4] for r in got)


def test_one_and_none(spark):
    assert manifest.report(spark.createDataFrame([], SCHEMA)).collect() == []
    only = (5, "a", "en", 1, "T", "", 0)
    assert [tuple(r) for r in manifest.report(spark.createDataFrame([only], SCHEMA)).collect()] == expected([only])
