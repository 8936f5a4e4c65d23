"""A Merkle manifest of a dataset by superblock reduction.

Rows are leaves of one tree a source, whose roots are leaves of a last tree. A superblock holds
fanout^levels consecutive nodes of a tree: one task collapses it by that many levels at once, and
the superblocks' roots are the nodes of the next round, until a tree is one node. Proofs come back
down the same way: that of a node is its siblings in its superblock, then the proof of the
superblock's root, which is worked out once for all nodes below it.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

FANOUT = 16
#: Levels that one task collapses: a superblock holds FANOUT ** LEVELS nodes.
LEVELS = 2
#: Trees up to which the table with one row for each is broadcast.
FEW_TREES = 50_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<at:int,others:array<string>>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and itself, nulls as a dash."""
    text = [c.cast("string") for c in columns]
    return hashed(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def layers_of(nodes: list[str], n: int, fanout: int, levels: int) -> tuple[list[list[str]], str]:
    """The layers below the root of a superblock of a tree with n nodes, and that root."""
    layers = []
    while n > 1 and len(layers) < levels:
        layers.append(nodes)
        nodes = [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]
        n = -(-n // fanout)
    return layers, nodes[0]


def reduced(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of superblocks (tree, block, left, layers, root) of trees given as (tree, at, node, n), at from 0.

    left is how many nodes the tree has after the round; trees of one node have no superblock.
    """
    span = fanout**levels

    def collapsed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ordered, n = group.sort_values("at"), int(group["n"].iloc[0])
        layers, root = layers_of(ordered["node"].tolist(), n, fanout, levels)
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "left": [-(-n // span)], "layers": [layers], "root": [root]})

    rounds = []
    while True:
        dealt = nodes.filter("n > 1").withColumn("block", F.floor(F.col("at") / span))
        blocks = cut(dealt.select("tree", "block", "at", "node", "n").groupBy("tree", "block").applyInPandas(collapsed, "tree long, block long, left long, layers array<array<string>>, root string"))
        if blocks.isEmpty():
            return rounds
        rounds.append(blocks)
        nodes = blocks.select("tree", F.col("block").alias("at"), F.col("root").alias("node"), F.col("left").alias("n"))


def steps_of(layers: Column, i: Column, fanout: int) -> Column:
    """The proof of node i of a superblock up to its root: for each level its place in its run, and the run's others."""

    def step(layer: Column, level: Column) -> Column:
        j = F.floor(i / F.pow(F.lit(fanout), level)).cast("int")
        place = j % fanout
        run = F.slice(layer, j - place + 1, F.lit(fanout))
        return F.struct(place.alias("at"), F.concat(F.slice(run, F.lit(1), place), F.slice(run, place + 2, F.lit(fanout))).alias("others"))

    return F.transform(layers, step)


def unfolded(rounds: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The rounds, last first, with the proof of each superblock's root in a column above; top is (tree, above) of the trees' roots."""
    out, below = [], None
    for blocks in reversed(rounds):
        last = blocks.filter("left = 1").join(top, "tree")
        if below is None:
            known = last
        else:
            known = last.unionByName(blocks.filter("left > 1").join(below, ["tree", "block"]).select(*last.columns))
        out.append(known)
        n = F.transform(F.col("layers")[0], lambda _, i: F.struct((F.col("block") * fanout**levels + i).alias("block"), F.concat(steps_of(F.col("layers"), i, fanout), F.col("above")).alias("above")))
        below = known.select("tree", F.explode(n).alias("n")).select("tree", "n.block", "n.above")
    return out


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(row, leaf, subroot, root, proof) of leaves (tree, id, leaf, row): each row with its digests and its proof up to the root.

    Leaves of a tree ascend by id, nulls first, equal ids by their digest, so that repeated rows
    are leaves of their own; trees ascend by the bytes of their name, null first. proof has a
    struct a level: the node's place in its run and the run's other nodes, left to right. An
    empty table gives an empty result. row is handed on as it is.
    """
    placed = numbered(cut(leaves.select("tree", "id", "leaf", "row")), "at", F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"))
    trees = cut(placed.groupBy(F.col("tree").alias("name")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    few = trees.count()
    named = F.broadcast(trees) if few <= FEW_TREES else trees
    # a tree is known by the number of its first leaf, which also orders trees
    rows = placed.join(named, F.col("tree").eqNullSafe(F.col("name"))).select(F.col("first").alias("tree"), (F.col("at") - F.col("first")).alias("at"), "leaf", "n", "row")
    rounds = reduced(rows.select("tree", "at", F.col("leaf").alias("node"), "n"), fanout, levels)
    roots = rows.filter("n = 1").select("tree", F.col("leaf").alias("subroot"))
    for blocks in rounds:
        roots = roots.unionByName(blocks.filter("left = 1").select("tree", F.col("root").alias("subroot")))
    subroots = numbered(roots, "place", F.col("tree"))
    upper = reduced(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("place") - 1).alias("at"), F.col("subroot").alias("node"), F.lit(few).cast("long").alias("n")), fanout, levels)
    only = (upper[-1].select("root") if upper else subroots.select("subroot")).first()
    root = F.lit(only[0] if only else None).cast("string")
    nothing = F.array().cast(f"array<{STEP}>")
    top = subroots.select("tree", "subroot", nothing.alias("above"))
    if upper:
        whole = unfolded(upper, leaves.sparkSession.range(1).select(F.col("id").alias("tree"), nothing.alias("above")), fanout, levels)[-1]
        each = F.transform(F.col("layers")[0], lambda _, i: F.struct((F.col("block") * fanout**levels + i + 1).alias("place"), F.concat(steps_of(F.col("layers"), i, fanout), F.col("above")).alias("above")))
        top = subroots.join(whole.select(F.explode(each).alias("e")).select("e.place", "e.above"), "place").select("tree", "subroot", "above")
    top = cut(top)
    alone = rows.filter("n = 1").join(top, "tree").select("row", "leaf", "subroot", root.alias("root"), F.col("above").alias("proof"))
    if not rounds:
        return alone
    first = unfolded(rounds, top.select("tree", "above"), fanout, levels)[-1].join(top.select("tree", "subroot"), "tree")
    # the rows of a superblock meet it as one array, so that its digests are sent once
    own = rows.filter("n > 1").groupBy("tree", F.floor(F.col("at") / fanout**levels).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "leaf", "row"))).alias("rows"))
    proven = F.transform("rows", lambda x, i: F.struct(x["row"].alias("row"), x["leaf"].alias("leaf"), F.concat(steps_of(F.col("layers"), i, fanout), F.col("above")).alias("proof")))
    many = own.join(first, ["tree", "block"]).select("subroot", F.explode(proven).alias("x")).select("x.row", "x.leaf", "subroot", root.alias("root"), "x.proof")
    return alone.unionByName(many)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    joined = lambda others, first, n: F.array_join(F.slice(others, first, n), "")
    return F.aggregate(proof, leaf, lambda d, s: hashed(joined(s["others"], F.lit(1), s["at"]), d, joined(s["others"], s["at"] + 1, F.size(s["others"]))))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf up."""
    return hashed(F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), ""))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """(row, leaf, subroot, root, proof) of documents, row being doc_id and changed: the leaf once its text is lower-cased where 5 divides the id's CRC.

    docs needs doc_id, source, lang, n_chars and text; other columns are ignored. Any of them may
    be null; an id that is null is never tampered with and comes first in its source.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = [F.col(c) for c in COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_of([*plain[:-1], lower]))
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), tampered.alias("changed"))
    return manifest(docs.select(F.col("source").alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf_of(plain).alias("leaf"), row.alias("row")))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each document; see documents_manifest."""
    out = documents_manifest(docs).withColumn("folded_root", folded(F.coalesce("row.changed", "leaf"), F.col("proof")))
    return out.select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: A CRC-32 from bits, as DuckDB has none: the remainder of the reflected polynomial.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0}) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii({0}[i]) >> b) & 1)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
SQL = f"""WITH RECURSIVE lines AS (SELECT doc_id, source, text, concat({', '.join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode({c}::VARCHAR)), ':', {c}) END" for c in COLUMNS[:-1])}) AS head,
  {CRC.format('(doc_id::VARCHAR)')} % 5 = 0 AS changed, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
 leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', text) END)) AS leaf,
  sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', CASE WHEN changed THEN low ELSE text END) END)) AS new_leaf,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM lines),
 lower_t(level, tree, pos, node, n) AS (SELECT 0, tree, pos, leaf, n FROM leaves UNION ALL SELECT level + 1, tree, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), max((n + 15) // 16) FROM lower_t WHERE n > 1 GROUP BY level, tree, pos // 16),
 subroots AS (SELECT tree, level AS height, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lower_t WHERE n = 1),
 upper_t(level, pos, node, n) AS (SELECT 0, pos, subroot, n FROM subroots UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), max((n + 15) // 16) FROM upper_t WHERE n > 1 GROUP BY level, pos // 16),
 top AS (SELECT level AS height, node AS root FROM upper_t WHERE n = 1),
 steps AS (SELECT l.doc_id, s.level, coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < l.pos // (16 ** s.level)::BIGINT), '') AS before, coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > l.pos // (16 ** s.level)::BIGINT), '') AS after
   FROM leaves l JOIN lower_t s ON s.tree = l.tree AND s.n > 1 AND s.pos // 16 = l.pos // (16 ** (s.level + 1))::BIGINT GROUP BY ALL
  UNION ALL SELECT l.doc_id, b.height + s.level, coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < b.pos // (16 ** s.level)::BIGINT), ''), coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > b.pos // (16 ** s.level)::BIGINT), '')
   FROM leaves l JOIN subroots b USING (tree) JOIN upper_t s ON s.n > 1 AND s.pos // 16 = b.pos // (16 ** (s.level + 1))::BIGINT GROUP BY l.doc_id, b.height, s.level),
 walk(doc_id, level, d) AS (SELECT doc_id, 0, new_leaf FROM leaves UNION ALL SELECT w.doc_id, w.level + 1, sha256(concat(s.before, w.d, s.after)) FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.level = w.level),
 ends AS (SELECT doc_id, arg_max(d, level) AS folded_root FROM walk GROUP BY doc_id), proofs AS (SELECT doc_id, string_agg(concat(before, after), '' ORDER BY level) AS proof FROM steps GROUP BY doc_id)
 SELECT l.doc_id, l.leaf, b.subroot, t.root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = t.root AS verified
 FROM leaves l JOIN subroots b USING (tree) CROSS JOIN top t JOIN ends e USING (doc_id) LEFT JOIN proofs p USING (doc_id)"""
