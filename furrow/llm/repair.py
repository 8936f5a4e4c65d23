"""Repair of the structure of conversations by the cheapest edits.

A retained-subsequence program: turns are kept or given another role, the rest are deleted, and
the roles of two retained turns that follow each other tell what is inserted between them. Costs
are kept less the deletion sum of all rows so far, so that deleting a row changes nothing and each
state (nothing retained, or the last role retained) keeps a running minimum; a retained row gets
its own cost less its deletion. Edits of equal cost are told apart by their initials: as states
never have equal audits and none of these is the start of another, their order is all that a
row needs to know of them.

Rows are numbered over all conversations and walked in blocks. A conversation within a block is
settled there; of one that goes over an edge each block gives the cheapest way from every state
to every state, and ways are joined, many blocks at a time, until the conversation is whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, numbered
from .manifest import CRC

#: Rows in a block, and blocks joined at once.
BLOCK, FAN = 4096, 1024
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing retained yet, or the initial of the last role retained. What is inserted between two, and at the end.
STATES = "-sua"
BETWEEN = {("-", "s"): 0, ("-", "u"): 0, ("-", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1}
AT_END = {"-": 0, "s": 2, "u": 1, "a": 0}
LEGAL = ("su", "ua", "au")

Way = tuple[str, str, int, object]


def ways_of(initial: str, fault: int) -> list[Way]:
    """(from, to, cost less the row's deletion, letters): what can be done with a row."""
    out: list[Way] = [(p, p, 0, "D") for p in STATES]
    if fault not in (BLANK, DUPLICATE):
        for (p, q), n in BETWEEN.items():
            if q == initial or q != "s":
                cost = (0 if q == initial else REROLE) + n * INSERT + (UNFINISHED if fault == TRUNCATED else 0)
                out.append((p, q, cost - DELETE, "I" * n + ("K" if q == initial else "R")))
    return out


def walked(steps: list[list[Way]], entry: str) -> tuple[dict[str, int], list[str], list[dict[str, tuple[str, object]]]]:
    """(least cost by last state, states by their audits, back pointers) of all ways through the steps from a state.

    A step's ways end in something that orders those from the same state.
    """
    cost, rank, back = {entry: 0}, {entry: 0}, []
    for ways in steps:
        best: dict[str, tuple] = {}
        for p, q, c, key in ways:
            if p in cost:
                found = (cost[p] + c, rank[p], key, p)
                if q not in best or found < best[q]:
                    best[q] = found
        order = sorted(best, key=lambda q: best[q][1:3])
        cost, rank = {q: b[0] for q, b in best.items()}, {q: i for i, q in enumerate(order)}
        back.append({q: (b[3], b[2]) for q, b in best.items()})
    return cost, sorted(rank, key=rank.get), back


def traced(back: list[dict[str, tuple[str, object]]], state: str) -> list[tuple[str, object, str]]:
    """(from, letters, to) of each step of the best way to a last state."""
    out = []
    for step in reversed(back):
        before, letters = step[state]
        out.append((before, letters, state))
        state = before
    return out[::-1]


def ended(cost: dict[str, int], order: list[str]) -> tuple[int, str]:
    """(cost, last state) of a whole conversation."""
    return min((cost[q] + INSERT * AT_END[q], order.index(q), q) for q in cost)[::2]


PATHS = "array<struct<p:string,q:string,cost:long,rank:int>>"
SEGMENT = "conv_id long, start long, n long, opening string, closing string, illegal long, closed boolean, cost long, last string"
FIRST = f"{SEGMENT}, audit string, states string, paths {PATHS}, audits array<struct<p:string,q:string,audit:string,states:string>>"
JOINED = f"{SEGMENT}, paths {PATHS}, children array<struct<start:long,paths:{PATHS}>>"


def _runs(rows: list[dict]) -> Iterator[list[dict]]:
    first = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i]["conv_id"] != rows[first]["conv_id"]:
            yield rows[first:i]
            first = i


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _paths(steps: list[list[Way]], base: int) -> tuple[list[dict], dict]:
    paths, backs = [], {}
    for p in STATES:
        cost, order, back = walked(steps, p)
        backs[p] = back
        paths += [{"p": p, "q": q, "cost": cost[q] + base, "rank": i} for i, q in enumerate(order)]
    return paths, backs


def _open(start: int, end: int, unit: int, block: int) -> bool:
    """Whether rows from start to end of a block meet an edge over which they may go on."""
    return (block > 0 and start == block * unit + 1) or end == (block + 1) * unit


def _first(unit: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Settles the conversations of a block of unit rows (conv_id, at, initial, fault), or gives their ways."""
    schema = _schema(FIRST)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        out = []
        for rows in _runs(group.sort_by("at").to_pylist()):
            start, n, initials = rows[0]["at"], len(rows), [r["initial"] for r in rows]
            one = {"conv_id": rows[0]["conv_id"], "start": start, "n": n, "opening": initials[0], "closing": initials[-1], "illegal": _illegal(initials), "closed": not _open(start, start + n - 1, unit, key[0].as_py())}
            steps = [ways_of(r["initial"], r["fault"]) for r in rows]
            if one["closed"]:
                cost, order, back = walked(steps, "-")
                total, last = ended(cost, order)
                way = traced(back, last)
                one |= {"cost": total + DELETE * n, "last": last, "audit": "".join(w[1] for w in way), "states": "".join(w[2] for w in way)}
            else:
                paths, backs = _paths(steps, DELETE * n)
                ways = {(p["p"], p["q"]): traced(backs[p["p"]], p["q"]) for p in paths}
                one |= {"paths": paths, "audits": [{"p": p, "q": q, "audit": "".join(w[1] for w in way), "states": "".join(w[2] for w in way)} for (p, q), way in ways.items()]}
            out.append(one)
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _steps(paths: list[list[dict]]) -> list[list[Way]]:
    return [[(x["p"], x["q"], x["cost"], x["rank"]) for x in child] for child in paths]


def _joined(unit: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Joins what follows each other of the same conversation in a group of unit rows."""
    schema = _schema(JOINED)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        out = []
        for parts in _runs(group.sort_by("start").to_pylist()):
            start, n = parts[0]["start"], sum(x["n"] for x in parts)
            met = _illegal([i for x in parts for i in (x["opening"], x["closing"])]) - sum(x["opening"] + x["closing"] not in LEGAL for x in parts)
            one = {"conv_id": parts[0]["conv_id"], "start": start, "n": n, "opening": parts[0]["opening"], "closing": parts[-1]["closing"], "illegal": met + sum(x["illegal"] for x in parts), "closed": not _open(start, start + n - 1, unit, key[0].as_py())}
            one["children"] = [{"start": x["start"], "paths": x["paths"]} for x in parts]
            steps = _steps([x["paths"] for x in parts])
            if one["closed"]:
                cost, order, _ = walked(steps, "-")
                one["cost"], one["last"] = ended(cost, order)
            else:
                one["paths"] = _paths(steps, 0)[0]
            out.append(one)
        return pa.Table.from_pylist(out, schema=schema)

    return run


CHOSEN = "start long, p string, q string"


def _chosen() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(start, p, q) of each child of joined rows whose own states p and q are known."""
    schema = _schema(CHOSEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                back = walked(_steps([c["paths"] for c in row["children"]]), row["p"])[2]
                out += [{"start": c["start"], "p": w[0], "q": w[2]} for c, w in zip(row["children"], traced(back, row["q"]), strict=True)]
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()

    return run


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) numbered in at, with fault: blank, else a repeat of role and text, else truncated.

    They come by conversation and turn, nulls first, then role and text; null roles and texts are
    one space. Repeated rows follow each other.
    """
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    # equal rows are told apart, so that any number of them can be dealt to many tasks
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("__row")]
    placed = numbered(plain.withColumn("__row", F.monotonically_increasing_id()), "at", *order).drop("__row")
    firsts = placed.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    return placed.join(firsts, "at", "left").withColumn("fault", fault).drop("first")


def settled(rows: DataFrame, unit: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Of rows with at and fault: conversations (conv_id, cost, illegal, last state), and each row's edit (at, letters, state)."""
    slim = rows.select("conv_id", "at", F.left("role", F.lit(1)).alias("initial"), "fault", F.floor((F.col("at") - 1) / unit).alias("block"))
    segments = cut(slim.groupBy("block").applyInArrow(_first(unit), FIRST))
    rounds, left = [], segments.filter("not closed")
    while not left.isEmpty():
        unit *= fan
        dealt = left.select("conv_id", "start", "n", "opening", "closing", "illegal", "paths", F.floor((F.col("start") - 1) / unit).alias("block"))
        joined = cut(dealt.groupBy("block").applyInArrow(_joined(unit), JOINED))
        rounds.append(joined)
        left = joined.filter("not closed")
    conversations, known = segments.filter("closed").select("conv_id", "cost", "illegal", "last"), None
    for joined in reversed(rounds):
        conversations = conversations.unionByName(joined.filter("closed").select("conv_id", "cost", "illegal", "last"))
        whole = joined.filter("closed").select("children", F.lit("-").alias("p"), F.col("last").alias("q"))
        if known is not None:
            whole = whole.unionByName(joined.filter("not closed").join(known, "start").select("children", "p", "q"))
        known = cut(whole.mapInArrow(_chosen(), CHOSEN))
    edits = segments.filter("closed").select("start", "audit", "states")
    if known is not None:
        own = F.filter("audits", lambda x: (x["p"] == F.col("p")) & (x["q"] == F.col("q")))[0]
        edits = edits.unionByName(segments.filter("not closed").join(known, "start").select("start", own.alias("x")).select("start", "x.audit", "x.states"))
    each = edits.select("start", "states", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]"), F.lit(0))).alias("i", "letters"))
    return conversations, each.select((F.col("start") + F.col("i")).alias("at"), "letters", F.substring(F.col("states"), F.col("i") + 1, F.lit(1)).alias("state"))


def _turn(role: Column | str, text: Column | str) -> Column:
    of = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(of(role).alias("role"), of(text).alias("text"))


def repaired(rows: DataFrame, unit: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, cost, illegal, gaps, blank, duplicate, truncated), and their edits in order (conv_id, at, letters, turns).

    rows needs conv_id, turn, role and text; other columns are ignored. turns are the turns that an
    edit leaves, inserted ones included: none for a deleted row. The last edit of a conversation,
    which may be empty, is what is inserted at its end. A null conv_id is a conversation. An empty
    table gives empty results.
    """
    found = cut(faults(rows))
    conversations, edits = settled(found, unit, fan)
    own = {n: F.count_if(F.col("fault") == k).alias(n) for n, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0).cast("long"))
    stats = found.groupBy(F.col("conv_id").alias("conv")).agg(gaps.alias("gaps"), *own.values())
    conversations = cut(conversations.join(stats, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv"))
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    before = F.when(F.startswith("letters", F.lit("I")), F.array(_turn(F.when(F.col("state") == "u", "assistant").otherwise("user"), ""))).otherwise(nothing)
    own_turn = F.when(F.endswith("letters", F.lit("K")), F.array(_turn(F.col("role"), F.col("text")))).when(F.endswith("letters", F.lit("R")), F.array(_turn(name(F.col("state")), F.col("text")))).otherwise(nothing)
    inside = found.join(edits, "at").select("conv_id", "at", "letters", F.concat(before, own_turn).alias("turns"))
    user, assistant = _turn("user", ""), _turn("assistant", "")
    more = F.when(F.col("last") == "s", F.array(user, assistant)).when(F.col("last") == "u", F.array(assistant)).otherwise(nothing)
    ends = conversations.select("conv_id", F.lit((1 << 63) - 1).alias("at"), more.alias("turns")).select("conv_id", "at", F.repeat(F.lit("I"), F.size("turns")).alias("letters"), "turns")
    return conversations.drop("last"), inside.unionByName(ends)


def digests(edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of the edits of each conversation, in order.

    A digest is made from start to end, so that all edits of a conversation stream through one
    task; it holds no more than a batch, a digest and the initials of one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, audit, first = None, None, [], True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv", "audit", "repaired_sha256"])

        for batch in batches:
            for conv, letters, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now:
                        yield done()
                    now, digest, audit, first = (conv,), hashlib.sha256(), [], True
                audit.append(letters)
                for line in lines:
                    digest.update((line if first else "\n" + line).encode())
                    first = False
        if now:
            yield done()

    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    dealt = edits.select("conv_id", "at", "letters", lines.alias("lines")).repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "at")
    return dealt.select("conv_id", "letters", "lines").mapInArrow(run, "conv long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, unpunctuated, repeated or given to the user, by the CRC of their conversation and turn; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    new_text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), copies.alias("copy")).drop("copy")


def report(conversations: DataFrame, unit: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation, damaged and repaired."""
    found, edits = repaired(damaged(conversations), unit, fan)
    all_of = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    got = found.withColumnRenamed("conv_id", "own").join(digests(edits), F.col("own").eqNullSafe(F.col("conv"))).drop("conv")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return all_of.join(got, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


SQL = f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
 kinds AS (SELECT *, {CRC.format('k')} % 20 AS kind FROM keyed), dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
 rn AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS tail FROM dam),
 fl AS MATERIALIZED (SELECT *, left(role, 1) AS ini, coalesce(lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1), 'su') NOT IN ('su', 'ua', 'au') AS bad,
  CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM rn),
 st AS (SELECT any_value(conv_id) AS conv_id, c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(bad) AS illegal FROM fl GROUP BY c),
 tr(p, q, n) AS (VALUES {', '.join(f"('{p}', '{q}', {n})" for (p, q), n in BETWEEN.items())}),
 ways AS MATERIALIZED (SELECT c, i, p, q, 3 * n + CASE WHEN q = ini THEN 0 ELSE 3 END + CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cost, repeat('I', n::INT) || CASE WHEN q = ini THEN 'K' ELSE 'R' END AS letters,
   concat(CASE WHEN n = 1 THEN CASE WHEN q = 'u' THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE '' END, CASE WHEN q = ini THEN role WHEN q = 'u' THEN 'user' ELSE 'assistant' END, ':', text, chr(10)) AS lines FROM fl JOIN tr ON q = ini OR q <> 's' WHERE fault NOT IN (1, 2)
  UNION ALL SELECT c, i, p, p, 4, 'D', '' FROM fl CROSS JOIN (VALUES ('-'), ('s'), ('u'), ('a')) v(p)),
 dp(c, i, q, best) AS (SELECT DISTINCT c, 0::BIGINT, '-', {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} FROM fl
  UNION ALL SELECT d.c, d.i + 1, w.q, min({{'cost': (d.best.cost + w.cost)::BIGINT, 'audit': d.best.audit || w.letters, 'lines': d.best.lines || w.lines}}) FROM dp d JOIN ways w ON w.c = d.c AND w.i = d.i + 1 AND w.p = d.q GROUP BY d.c, d.i, w.q),
 en AS (SELECT c, min({{'cost': best.cost + 3 * n, 'audit': best.audit || repeat('I', n::INT), 'lines': best.lines || t}}) AS best FROM dp JOIN (SELECT c, max(i) AS i FROM fl GROUP BY c) USING (c, i)
  JOIN (VALUES ('-', 0, ''), ('a', 0, ''), ('u', 1, 'assistant:' || chr(10)), ('s', 2, 'user:' || chr(10) || 'assistant:' || chr(10))) v(q, n, t) USING (q) GROUP BY c)
 SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(CASE WHEN best.lines IS NULL OR best.lines = '' THEN '' ELSE best.lines[1:-2] END) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN st ON a.conv_id IS NOT DISTINCT FROM st.conv_id LEFT JOIN en USING (c)"""
