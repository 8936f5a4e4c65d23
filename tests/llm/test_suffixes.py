"""Repeated byte strings against a count of every string of 200 bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from furrow.llm import suffixes

SCHEMA = "doc_id long, text string, r long, place string"


def expected(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def awkward():
    """Nulls, short and long texts, repeated rows, runs of one letter, passages of 199 to 201 bytes at many offsets, and copies that differ in one place."""
    pick = random.Random(4)
    text = lambda n, of="abcdefgh éß": "".join(pick.choice(of) for _ in range(n))
    rows = [(1, None), (None, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201), (6, "ab" * 150), (7, "q" * 900 + text(300)), (8, text(30_000)), (None, text(400))]
    base = text(1500, "abcdefgh ")
    rows += [(20 + i, text(pick.randint(0, 300)) + base[s : s + n] + text(pick.randint(0, 300))) for i, (s, n) in enumerate((pick.randint(0, 900), pick.choice((199, 200, 201, 260, 420, 600))) for _ in range(40))]
    rows += [(80 + i, base[:k] + "#" + base[k + 1 :]) for i, k in enumerate((0, 1, 150, 199, 200, 700, 1499))]
    rows += [(90, base)] * 3 + [(91, rows[9][1]), (92, "é" * 100 + text(40)), (93, "x" + "é" * 100)] + [(95, None)] * 2
    return rows


@pytest.fixture(scope="module")
def cases():
    rows = awkward()
    return rows, expected(rows)


def test_report(spark, cases):
    rows, want = cases
    got = suffixes.report(spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_many_seeds(spark):
    """Texts of few different letters, so that repeats start and end everywhere."""
    for seed in range(3):
        pick = random.Random(seed)
        parts = ["".join(pick.choice("ab") for _ in range(pick.randint(60, 400))) for _ in range(12)]
        rows = [(i, "".join(pick.choice(parts)[pick.randint(0, 50) :] for _ in range(pick.randint(1, 8)))) for i in range(60)]
        got = suffixes.report(spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)).collect()
        assert sorted(map(tuple, got), key=str) == expected(rows)


def test_sql(cases):
    rows, want = cases
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(suffixes.SQL).fetchall(), key=str) == want


def test_ranges(spark):
    """The operator's own output: where the repeats are; and an empty table."""
    rows = [(1, "a1" * 10 + "b" * 100 + "c" * 100), (2, "b" * 100 + "c" * 100)]
    found, ranges = suffixes.repeats(spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA))
    own = {r["r"]: r["doc_id"] for r in found.collect()}
    assert {own[r["r"]]: [tuple(x) for x in r["ranges"]] for r in ranges.collect()} == {1: [(20, 220)], 2: [(0, 200)]}
    assert suffixes.report(spark.createDataFrame([], SCHEMA)).collect() == []
