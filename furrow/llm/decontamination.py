"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of words of every item. Training words are streamed through
it while the longest match that ends at each word is tracked; where that reaches the window
length, or a whole item that is shorter, the words matched are hits. Only runs of words whose
k-grams all occur in some item are streamed: no window can lie outside them.

Items are dealt to blocks of bounded size, of which executors build an automaton each. Where
there are several, one pass over the texts finds the documents that hold a k-gram of any item,
and only those go through the automata, some at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import words
from .common import cut, text_slices

WINDOW = 13
#: A document is contaminated if hits are at least this part of its words.
COVERAGE = 20
#: Words of items in one automaton, on average; more items make more automata, each streamed in turn.
BLOCK_WORDS = 200_000
#: Most words of a gram that marks a run to be streamed.
MOST_GRAM = 4
#: Automata in one job; what they have found is written before the next go on.
AT_ONCE = 4
#: Bits of the filter over all items' grams, by length of gram.
FILTER_BITS = 1 << 24


def item_words(text: str | None) -> list[bytes]:
    """An item's normalised words."""
    data = words.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = words.split(data, np.array([0, len(data)]), words.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


class Automaton:
    """A generalised suffix automaton over word ids, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: items whose window, or which as a whole, ends here: by state, then by length
        self.windows: dict[int, set[str]] = {}
        self.shorts: dict[int, list[tuple[int, str]]] = {}
        self._ends: dict[int, list[tuple[int, str]]] = {}
        for _, tokens in items:
            last = 0
            for t in tokens:
                last = self._extend(last, self.vocabulary.setdefault(t, len(self.vocabulary)))
        for name, tokens in items:
            state = 0
            for n, t in enumerate(tokens, 1):
                state = self.holding(self.next[state][self.vocabulary[t]], window)
                if n >= window:
                    self.windows.setdefault(state, set()).add(name)
            if 0 < len(tokens) < window:
                self.shorts.setdefault(self.holding(state, len(tokens)), []).append((len(tokens), name))
        lengths = [len(tokens) for _, tokens in items if tokens]
        self.k = min(MOST_GRAM, window, *lengths) if lengths else 0
        self._grams([tokens for _, tokens in items if tokens])

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """Makes the target of c from p a state of its own, with the longest string of p and c."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def holding(self, state: int, n: int) -> int:
        """The state of the last n words of a state's strings, or of all of them if they have fewer.

        A walk that goes on from what it gave the word before takes constant time a word on average,
        as the links of a state grow by one a word at most.
        """
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _grams(self, items: list[list[bytes]]) -> None:
        """Hashes of all k-grams of the items, sorted, and a bit for their low bits."""
        found = [np.zeros(0, np.uint64)]
        for tokens in items:
            ends = np.cumsum([len(t) for t in tokens])
            data = np.frombuffer(b"".join(tokens), np.uint8)
            found.append(words.gram_hashes(words.word_hashes(data, ends - [len(t) for t in tokens], ends), self.k))
        self.grams = np.unique(np.concatenate(found))
        self._mark()

    def _mark(self) -> None:
        bits = max(16, min(24, int(len(self.grams) * 16).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[self.grams & self.mask] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("bits", "mask", "_ends")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ends = {}
        self._mark()

    def ends_here(self, state: int) -> list[tuple[int, str]]:
        """(length, item) of the short items that some string of the state ends with."""
        chain = []
        while state >= 0 and state not in self._ends:
            chain.append(state)
            state = self.link[state]
        got = self._ends.get(state, [])
        for below in reversed(chain):
            got = self._ends[below] = self.shorts.get(below, []) + got
        return got

    def stream(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (start, end) in order of end, the items found and the longest match."""
        spans, found, longest, seen = [], set(), 0, set()
        whole, near = (0, 0), (0, 0)  # the longest match, and that of the last words of a window: state and length
        for i, token in enumerate(tokens, 1):
            c = self.vocabulary.get(token)
            if c is None:
                whole = near = (0, 0)
                continue
            whole, (state, n) = self._step(*whole, c), self._step(*near, c)
            longest = max(longest, whole[1])
            state = self.holding(state, self.window)
            near = state, n = state, min(n, self.length[state])
            if n >= self.window:
                spans.append((i - self.window, i))
                if state not in seen:
                    found |= self.windows[state]
                    seen.add(state)
            for length, item in self.ends_here(state):
                if length <= n:
                    spans.append((i - length, i))
                    found.add(item)
        return spans, found, longest

    def _step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """The longest match that ends with word c, after one of n words in a state."""
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        state = self.next[state].get(c, 0)
        return state, n + 1 if state else 0

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[int], dict[int, tuple[list, set, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice: first row, words of each row, and for rows with hits (spans, items, longest)."""
        for first, _, data, offsets in text_slices(column):
            data = words.LOWER[data]
            starts, ends, at = words.split(data, offsets, words.ALNUM)
            yield first, np.diff(at), self._hits(data, starts, ends, at), starts, ends, at, offsets

    def _hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> dict[int, tuple[list, set, int]]:
        if not self.k or len(starts) < self.k:
            return {}
        grams = words.gram_hashes(words.word_hashes(data, starts, ends), self.k)
        maybe = np.flatnonzero(self.bits[grams & self.mask])
        place = np.searchsorted(self.grams, grams[maybe]).clip(max=len(self.grams) - 1)
        maybe = maybe[self.grams[place] == grams[maybe]]
        row = np.searchsorted(at, maybe, "right") - 1
        inside = maybe + self.k <= at[row + 1]
        maybe, row = maybe[inside], row[inside]
        out: dict[int, tuple[list, set, int]] = {}
        if not len(maybe):
            return out
        # k-grams that overlap make one run of words
        new = np.concatenate(([True], (maybe[1:] > maybe[:-1] + self.k) | (row[1:] != row[:-1])))
        run_starts, run_ends = maybe[new], maybe[np.concatenate((new[1:], [True]))] + self.k
        for a, b, r in zip(run_starts.tolist(), run_ends.tolist(), row[new].tolist(), strict=True):
            tokens = [data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
            spans, found, longest = self.stream(tokens)
            if spans:
                all_spans, items, most = out.get(r, ([], set(), 0))
                base = a - int(at[r])
                out[r] = (all_spans + [(x + base, y + base) for x, y in spans], items | found, max(most, longest))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


BUILT = "k int, filter binary, automaton binary"


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(k, filter, automaton) of each block of items: item_id and text; nulls have no words.

    Items are dealt by hash to blocks of about block_words words, those shorter than MOST_GRAM
    words apart from the others, since their automata mark runs by shorter grams. A task builds
    the automaton of a block; a filter over its grams goes with it. An item longer than a block is
    dealt in pieces that share all but one word of a window, so that no window is lost; its
    longest match is that within a piece.
    """
    step = max(block_words, window)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = item_words(text)
                pieces = [tokens[a : a + step + window - 1] for a in range(0, max(1, len(tokens) - window + 1), step)]
                n = [len(x) for x in pieces]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(n)), pa.array([b" ".join(x).decode() for x in pieces]), pa.array(n, pa.int64()), pa.array([min(MOST_GRAM, window, x) for x in n], pa.int32())], names=["item", "text", "n", "k"])

    def built(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["item"].to_pylist(), group["text"].to_pylist(), strict=True))
        automaton = Automaton([(name, item_words(text)) for name, text in rows], window)
        bits = np.zeros(FILTER_BITS, bool)
        bits[automaton.grams & np.uint64(FILTER_BITS - 1)] = True
        return pa.table({"k": pa.array([automaton.k], pa.int32()), "filter": pa.array([np.packbits(bits).tobytes()], pa.binary()), "automaton": pa.array([pickle.dumps(automaton)], pa.binary())})

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    sized = cut(named.mapInArrow(sizes, "item string, text string, n long, k int").filter("n > 0"))
    totals = sized.groupBy("k").agg(F.ceil(F.sum("n") / block_words).cast("int").alias("blocks"))
    dealt = sized.join(F.broadcast(totals), "k").withColumn("block", F.pmod(F.xxhash64("item", "text"), F.col("blocks")))
    return cut(dealt.select("k", "block", "item", "text").groupBy("k", "block").applyInArrow(built, BUILT))


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, longest int"


def _pass(blocks: list, keep: list[str], longest_run: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams the texts in a column row through the automata of blocks, adding to what has been found; keeps some of row's fields.

    With longest_run, runs of hits of more words are cut out of the texts kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [pickle.loads(b.value) for b in blocks]
        for batch in batches:
            row = batch.column(0)
            column, n = row.field("text"), batch.num_rows
            counts, spans, items, longest = batch.column(1).to_numpy(zero_copy_only=False).copy(), [], [], batch.column(4).to_pylist()
            for s, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                spans.append([(x["start"], x["end"]) for x in s])
                items.append(set(names))
            for automaton in loaded:
                for at, sizes, hits, *_ in automaton.scan(column):
                    counts[at : at + len(sizes)] = sizes
                    for r, (s, names, most) in hits.items():
                        spans[at + r], items[at + r], longest[at + r] = spans[at + r] + s, items[at + r] | names, max(longest[at + r], most)
            kept = pa.StructArray.from_arrays([row.field(f) for f in keep], fields=[row.type.field(f) for f in keep]) if keep != [f.name for f in row.type] else row
            runs = [merged(s) for s in spans]
            if longest_run is not None:
                kept = _shortened(kept, [[x for x in s if x[1] - x[0] > longest_run] for s in runs])
            found = [pa.array([[{"start": a, "end": b} for a, b in s] for s in runs], SPAN), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([kept, pa.array(counts, pa.int64()), *found, pa.array(longest, pa.int32())], names=["row", "n_words", "spans", "items", "longest"])

    return run


def _shortened(rows: pa.StructArray, runs: list[list[tuple[int, int]]]) -> pa.StructArray:
    """rows with the runs of words cut out of text, and n_chars, where it is a field, brought up to date."""
    touched = [i for i, r in enumerate(runs) if r]
    if not touched:
        return rows
    fields = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
    texts = fields["text"].to_pylist()
    for i in touched:
        texts[i] = cut_text(texts[i], runs[i])
    fields["text"] = pa.array(texts, fields["text"].type)
    if "n_chars" in fields:
        n = fields["n_chars"].to_pylist()
        for i in touched:
            n[i] = len(texts[i])
        fields["n_chars"] = pa.array(n, fields["n_chars"].type)
    return pa.StructArray.from_arrays(list(fields.values()), fields=list(rows.type))


def _marked(filters: dict[int, bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts words, and tells which texts hold a gram of any item, by the filters over their hashes, by length of gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.unpackbits(np.frombuffer(f, np.uint8)).astype(bool) for k, f in filters.items()}
        for batch in batches:
            column, n = batch.column(0).field("text"), batch.num_rows
            counts, maybe = np.zeros(n, np.int64), np.zeros(n, bool)
            for first, end, data, offsets in text_slices(column):
                data = words.LOWER[data]
                starts, ends, at = words.split(data, offsets, words.ALNUM)
                counts[first:end] = np.diff(at)
                own = words.word_hashes(data, starts, ends)
                for k, table in bits.items():
                    hit = np.flatnonzero(table[words.gram_hashes(own, k) & np.uint64(FILTER_BITS - 1)])
                    text = np.searchsorted(at, hit, "right") - 1
                    maybe[first + text[hit + k <= at[text + 1]]] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(maybe)], names=["row", "n_words", "maybe"])

    return run


def scanned(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS, longest_run: int | None = None) -> DataFrame:
    """(row, n_words, spans, items, longest): docs as a column row with the fields to keep, through every automaton."""
    context = docs.sparkSession.sparkContext
    blocks = automata(items, window, block_words)
    row = StructField("row", StructType([f for f in docs.schema.fields if f.name in keep]), False)
    found = StructType.fromDDL(FOUND).fields
    empty = {f.name: (F.lit(0) if f.name == "longest" else F.array()).cast(f.dataType) for f in found[1:]}
    now = docs.select(F.struct("*").alias("row")).withColumns({"n_words": F.lit(0).cast("long"), **empty})
    n = blocks.count()
    if n <= 1:  # all texts through the only automaton
        only = [context.broadcast(bytes(b["automaton"])) for b in blocks.select("automaton").collect()] or [context.broadcast(pickle.dumps(Automaton([], window)))]
        return now.mapInArrow(_pass(only, keep, longest_run), StructType([row, *found]))
    filters: dict[int, np.ndarray] = {}
    for b in blocks.select("k", "filter").toLocalIterator():
        filters[b["k"]] = filters.get(b["k"], 0) | np.frombuffer(b["filter"], np.uint8)
    whole = StructField("row", now.schema["row"].dataType, False)
    told = now.select("row").mapInArrow(_marked({k: f.tobytes() for k, f in filters.items()}), StructType([whole, found[0], StructField("maybe", BooleanType())]))
    # the others keep no text that is not asked for; candidates are written once
    light = F.struct(*[F.col("row")[f].alias(f) for f in docs.columns if f in keep]).alias("row")
    rest = told.filter("not maybe").withColumns(empty).select(light, *[f.name for f in found])
    left = cut(told.filter("maybe").withColumns(empty).select("row", *[f.name for f in found]))
    some: list = []
    for i, b in enumerate(blocks.select("automaton").toLocalIterator(), 1):
        some.append(context.broadcast(bytes(b["automaton"])))
        if len(some) == AT_ONCE and i < n:
            left, some = cut(left.mapInArrow(_pass(some, docs.columns), StructType([whole, *found]))), []
    return rest.unionByName(left.mapInArrow(_pass(some, keep, longest_run), StructType([row, *found])))


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def is_contaminated(hit: Column, n: Column, coverage: int = COVERAGE) -> Column:
    return (hit > 0) & (coverage * hit >= n)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of docs: its words, hit spans (in words), items found, longest match.

    docs needs doc_id and text, items item_id and text; other columns are ignored. A null or
    empty text has no words and is clean, a null item has no windows, equal item_ids count once.
    Repeated rows give repeated rows; empty tables give an empty result or no hits.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scanned(own, items, ["doc_id"], window, block_words).withColumn("n_hit", hit_words(F.col("spans")))
    return out.select("row.doc_id", "n_words", "n_hit", is_contaminated(F.col("n_hit"), F.col("n_words"), coverage).alias("contaminated"), "spans", "items", "longest")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS, longest: int | None = None) -> DataFrame:
    """The rows of docs that are not contaminated, all columns unchanged, whatever their names.

    With longest, a run of hits of more than so many words is cut out of those that stay, which may
    hold hits under the limit of coverage, and n_chars, where it is a column, is brought up to
    date. Null and empty texts are clean and stay, repeated rows stay or go alike, empty tables
    give an empty result or all rows.
    """
    out = scanned(docs, items, docs.columns, window, block_words, longest).filter(~is_contaminated(hit_words(F.col("spans")), F.col("n_words"), coverage))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans and what stands between them."""
    raw = text.encode()
    data = words.LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = words.split(data, np.array([0, len(data)]), words.ALNUM)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()
