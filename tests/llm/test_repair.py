"""Conversation repair against all edits tried one by one, and against whole audits carried along."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from furrow.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, fault string, at int"
BLANK = " \t\n\x0b\x0c\r"
FULL = re.compile(r"(s?(ua)+)?\Z")
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(BLANK)[-1:]
        out.append(1 if not end else 2 if (role, text) in seen else 3 if end not in ".!?" else 0)
        seen.add((role, text))
    return out


def tried(rows, kinds):
    """The least (cost, audit, lines) of all edits, at most two turns inserted at a place."""
    best = None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    choices = [[("D", 4, None)] + ([] if k in (1, 2) else [("K", 3 * (k == 3), r[2]), *[("R", 3 + 3 * (k == 3), n) for n in NAMES.values()]]) for r, k in zip(rows, kinds)]
    for picked in itertools.product(*choices):
        for between in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c for _, c, _ in picked) + 3 * sum(map(len, between))
            if best and cost > best[0]:
                continue
            lines, audit = [], ""
            for new, edit, row in itertools.zip_longest(between, picked, rows):
                lines += [(NAMES[i], "") for i in new]
                audit += "I" * len(new)
                if edit:
                    audit += edit[0]
                    lines += [(edit[2], row[3])] if edit[2] is not None else []
            if FULL.match("".join(r[:1] or "?" for r, _ in lines)):
                best = min(best or (cost, audit, lines), (cost, audit, lines))
    return best


def carried(rows, kinds):
    """The same by whole audits and texts, row by row."""
    need = repair.BETWEEN
    states = {"-": (0, "", [])}
    for (_, _, role, text), k in zip(rows, kinds):
        new = {}
        for p, (cost, audit, lines) in states.items():
            found = [(p, (cost + 4, audit + "D", lines))]
            for q in () if k in (1, 2) else "sua":
                keeps = role[:1] == q
                if (p, q) in need and (keeps or q != "s"):
                    n = need[p, q]
                    more = [(NAMES["a" if q == "u" else "u"], "")] * n + [(role if keeps else NAMES[q], text)]
                    found.append((q, (cost + 3 * n + 3 * (not keeps) + 3 * (k == 3), audit + "I" * n + ("K" if keeps else "R"), lines + more)))
            for q, x in found:
                new[q] = min(new.get(q, x), x)
        states = new
    ends = {"-": [], "a": [], "u": [("assistant", "")], "s": [("user", ""), ("assistant", "")]}
    return min((c + 3 * len(ends[q]), a + "I" * len(ends[q]), x + ends[q]) for q, (c, a, x) in states.items())


def expected(rows, best=carried):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(damage([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds, turns = faults(own), [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        cost, audit, lines = best(own, kinds)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *[kinds.count(i) for i in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, most, roles=("system", "user", "assistant", "tool", "", None, "u", "S")):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "cut off", "", " \t", None, "Yes. \n", "é…", "a.b"]
    return [(c, pick.choice([None, *range(20)]) if c % 3 == 0 else t, pick.choice(roles if c % 2 else roles[:3]), pick.choice(texts)) for c in range(convs) for t in range(pick.randint(1, most))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


def test_all_edits(spark):
    rows = made(3, 40, 3)
    assert expected(rows) == expected(rows, tried)
    got = repair.report(frame(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


@pytest.mark.parametrize(("unit", "fan"), [(4, 2), (7, 3), (4096, 1024)])
def test_blocks(spark, unit, fan):
    """Conversations of one row to hundreds over many blocks and rounds, equal rows and null ids."""
    rows = made(5, 30, 12) + [(99, i, r, f"{i % 7} {r}.") for i in range(300) for r in ("user", "assistant")] + [(98, 5, "user", "Again.")] * 60
    rows += [(None, t, "user", "Hm.") for t in (None, 1, 9)] + [(97, None, None, None), (96, 1, "user", "x" * 200_000 + ".")]
    assert sorted(map(tuple, repair.report(frame(spark, rows), unit, fan).collect()), key=str) == expected(rows)


def test_sql(spark):
    rows = made(11, 25, 9) + [(99, i, "user", f"{i}.") for i in range(40)] + [(None, None, "user", "Hm.")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(repair.SQL).fetchall(), key=str) == expected(rows)


def test_turns(spark):
    """The operator's own output is the repaired conversation; all rows gone, and no rows at all."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", ""), (2, 0, "user", " ")]
    found, edits = repair.repaired(frame(spark, rows))
    turns = {c: [(t["role"], t["text"]) for r in edits.orderBy("at").collect() if r["conv_id"] == c for t in r["turns"]] for c in (1, 2)}
    assert turns == {1: [("system", "Be kind."), ("user", ""), ("assistant", "Hello.")], 2: []}
    assert {r["conv_id"]: (r["cost"], r["blank"]) for r in found.collect()} == {1: (7, 1), 2: (4, 1)}
    assert repair.report(frame(spark, [])).collect() == []
    dropped = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert [tuple(r) for r in repair.report(frame(spark, [(5, dropped, "user", "Gone.")])).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
