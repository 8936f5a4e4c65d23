"""Quotation linking: quote levels, links to original messages, reply order.

DataFrame and SQL functions only. A line's level is the number of > before its text. A quoted
passage is a run of lines of one level; it and its lines are normalised and hashed, and joined
to the earliest earlier message of the conversation that has the same passage, paragraph or
line as its own. A message answers the latest of the originals of its outermost linked quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

MARKS = r"^(?:[ \t]*>)+"
#: Lines that only say whose text is quoted below.
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    """Lower-cased letters and digits, anything between them one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def key_of(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)


def own_text(text: Column) -> Column:
    """A message without quoted and attribution lines, and without blank ends.

    An attribution can be broken over two lines that stand right before a quoted one. Only texts
    with a mark are searched for that.
    """
    lines = _lines(text)

    def at(i: Column) -> Column:
        return F.coalesce(F.get(lines, i), F.lit(""))

    def broken(i: Column) -> Column:
        return F.concat(at(i), F.lit(" "), at(i + 1)).rlike(ATTRIBUTION) & at(i + 2).rlike(MARKS)

    plain = F.filter(lines, lambda line: ~line.rlike(ATTRIBUTION))
    own = F.filter(lines, lambda line, i: ~line.rlike(MARKS) & ~line.rlike(ATTRIBUTION) & ~broken(i) & ~((i > 0) & broken(i - 1)))
    own = F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(">")), own).otherwise(plain)
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def quoted_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, h, n, level, line) of every quoted line; h tells repeated turns apart."""
    some = messages.filter(F.col("text").rlike(r"(?:^|[\r\n])[ \t]*>") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    line = some.select("conv_id", "turn", F.xxhash64("text").alias("h"), F.posexplode(_lines(F.col("text"))).alias("n", "line")).filter(F.col("line").rlike(MARKS))
    marks = F.regexp_extract("line", MARKS, 0)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    return line.select("conv_id", "turn", "h", "n", level.alias("level"), F.regexp_replace("line", MARKS, "").alias("line"))


def passages(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, h, level, start, passage): runs of lines of one level."""
    run = F.col("n") - F.row_number().over(Window.partitionBy("conv_id", "turn", "h", "level").orderBy("n"))
    parts = lines.withColumn("run", run).groupBy("conv_id", "turn", "h", "level", "run").agg(F.min("n").alias("start"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("all"))
    return parts.select("conv_id", "turn", "h", "level", "start", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("passage"))


def origins(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, key, origin): the earliest turn with each wanted key as its own text, paragraph or line."""
    own = own_text(F.col("text"))
    pieces = F.array_distinct(F.flatten(F.array(F.array(own), F.split(own, r"\n\s*\n", -1), F.split(own, "\n", -1))))
    own_keys = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(pieces).alias("piece"))
    own_keys = own_keys.filter(normalised(F.col("piece")) != "").select("conv_id", "turn", key_of(F.col("piece")).alias("key"))
    return own_keys.join(wanted.select("conv_id", "key").distinct(), ["conv_id", "key"]).groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_quotes, n_linked, levels) of the turns that quote."""
    lines = cut(quoted_lines(messages))
    parts = passages(lines).select("conv_id", "turn", "h", "level", "start", "passage", F.posexplode(F.array_distinct(F.concat(F.array("passage"), F.split("passage", "\n", -1)))).alias("piece_at", "piece"))
    keyed = cut(parts.withColumn("key", key_of(F.col("piece"))).withColumn("full", normalised(F.col("piece")) != "").select("conv_id", "turn", "h", "level", "start", "piece_at", "key", "full"))
    found = keyed.filter("full").join(origins(messages, keyed.filter("full")), ["conv_id", "key"], "left").filter("origin is null or origin < turn")
    # of a passage its whole counts before its lines
    best = keyed.groupBy("conv_id", "turn", "h", "level", "start").count().drop("count").join(
        found.filter("origin is not null").groupBy("conv_id", "turn", "h", "level", "start").agg(F.min(F.struct("piece_at", "origin"))["origin"].alias("origin")), ["conv_id", "turn", "h", "level", "start"], "left"
    )
    outermost = F.min(F.when(F.col("origin").isNotNull(), F.struct("level", (-F.col("origin")).alias("late"))))
    return best.groupBy("conv_id", "turn").agg((-outermost["late"]).alias("parent"), F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked"), F.max("level").cast("long").alias("levels"))


def threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of the turns with a parent, by doubling the steps up."""
    up = cut(linked.filter("parent is not null").select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        new = cut(up.join(above, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("rose")))
        up = new.drop("rose")
        if new.filter("rose").isEmpty():
            return up


def linked_conversations(messages: DataFrame) -> DataFrame:
    """Messages without quotes, and their place in reply order: each conversation's threads by their first turn.

    messages needs conv_id, turn, role and text; other columns are ignored. One row for each
    row: conv_id, turn, role, body, n_quotes, n_linked, levels, parent_turn, root_turn, depth,
    place. A place is the number, from 1, of a message over all conversations by conv_id, root
    and turn, so that it comes after those that it answers; it is null without conv_id or turn.
    A message that quotes nothing known has no parent and is its own root. A null text is
    empty. Rows without conv_id or turn link to nothing. Rows of one conversation and turn are
    linked as one message, share its place and all stay. An empty table gives an empty result.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut(links(rows))
    messages = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    zero = F.lit(0).cast("long")
    threaded = messages.join(threads(found), ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", zero).alias("depth"))
    placed = numbered(threaded, "place", F.col("conv_id"), F.col("root"), F.col("turn"))
    out = rows.select("conv_id", "turn", "role", own_text(F.col("text")).alias("body")).join(found, ["conv_id", "turn"], "left").join(placed, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "body", *(F.coalesce(c, zero).alias(c) for c in ("n_quotes", "n_linked", "levels")),
        F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", zero).alias("depth"), "place",
    )


SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         string_split(regexp_replace(coalesce(text, ''), '\r\n?', E'\n', 'g'), E'\n') AS lines
  FROM conversations
), own AS (
  SELECT conv_id, turn, role, text, lines,
         regexp_replace(array_to_string(list_filter(lines, lambda x, i: NOT regexp_matches(x, '^(?:[ \t]*>)+')
           AND NOT regexp_matches(x, '(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$')
           AND NOT (regexp_matches(x || ' ' || coalesce(lines[i + 1], ''), '(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$')
             AND regexp_matches(coalesce(lines[i + 2], ''), '^(?:[ \t]*>)+'))
           AND NOT (i > 1 AND regexp_matches(lines[i - 1] || ' ' || x, '(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$')
             AND regexp_matches(coalesce(lines[i + 1], ''), '^(?:[ \t]*>)+'))), E'\n'),
           '^\s+|\s+$', '', 'g') AS body
  FROM m
), quoted AS (
  SELECT conv_id, turn, text, n, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^(?:[ \t]*>)+', '') AS line
  FROM (SELECT DISTINCT conv_id, turn, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM m)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND regexp_matches(line, '^(?:[ \t]*>)+')
), runs AS (
  SELECT *, n - row_number() OVER (PARTITION BY conv_id, turn, text, level ORDER BY n) AS run FROM quoted
), passages AS (
  SELECT conv_id, turn, text, level, min(n) AS start, string_agg(line, E'\n' ORDER BY n) AS passage
  FROM runs GROUP BY conv_id, turn, text, level, run
), pieces AS (
  SELECT conv_id, turn, text, level, start, pos, trim(regexp_replace(lower(piece), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
  FROM (SELECT *, unnest(list_concat([passage], string_split(passage, E'\n'))) AS piece,
               generate_subscripts(list_concat([passage], string_split(passage, E'\n')), 1) AS pos FROM passages)
), own_pieces AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(piece), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
  FROM (SELECT conv_id, turn, unnest(list_concat([body], regexp_split_to_array(body, '\n\s*\n'), string_split(body, E'\n'))) AS piece FROM own)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), origins AS (
  SELECT conv_id, key, min(turn) AS origin FROM own_pieces WHERE key <> '' GROUP BY conv_id, key
), best AS (
  SELECT p.conv_id, p.turn, p.text, p.level, p.start, arg_min(o.origin, p.pos) FILTER (o.origin < p.turn) AS origin
  FROM pieces p LEFT JOIN origins o ON p.conv_id = o.conv_id AND p.key = o.key
  GROUP BY p.conv_id, p.turn, p.text, p.level, p.start
), links AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked, max(level) AS levels,
         arg_min(origin, level * 1000000000 - origin) FILTER (origin IS NOT NULL) AS parent
  FROM best GROUP BY conv_id, turn
), up AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM links WHERE parent IS NOT NULL
  UNION ALL
  SELECT up.conv_id, up.turn, l.parent, up.depth + 1 FROM up JOIN links l ON l.conv_id = up.conv_id AND l.turn = up.root WHERE l.parent IS NOT NULL
), tops AS (
  SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn
)
SELECT own.conv_id, own.turn, own.role, own.body, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked,
       coalesce(levels, 0)::BIGINT AS levels, parent AS parent_turn, coalesce(root, own.turn) AS root_turn, coalesce(tops.depth, 0)::BIGINT AS depth,
       CASE WHEN own.conv_id IS NOT NULL AND own.turn IS NOT NULL THEN dense_rank() OVER (PARTITION BY own.conv_id IS NOT NULL AND own.turn IS NOT NULL ORDER BY own.conv_id, coalesce(root, own.turn), own.turn) END AS place
FROM own LEFT JOIN links USING (conv_id, turn) LEFT JOIN tops USING (conv_id, turn)
"""
