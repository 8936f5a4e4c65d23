"""Personal data: base patterns, weakly supervised span candidates and redaction.

Base spans are fixed patterns and always count. Wider patterns find candidates; labelers with
votes for, against or none (strict format, check digit or range, gazetteer, context words,
shape) judge each. Expectation-maximisation over the counts of vote patterns of all candidates
estimates how reliable each labeler is. A logistic span classifier is trained on its posteriors:
it sees what the span looks like (shape, length, digits, separators), what stands beside it
(characters and words) and the votes. The candidates it accepts are added, the surest first,
where they touch no base span and none added before.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: As `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`: a match starts where a run of digits does, so none is read twice from its middle.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def in_range(s: str) -> bool:
    return all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from their @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def digits_in(text: str) -> int:
    """How many ASCII digits a text has; all but emails and secrets need some, and most texts have few."""
    return sum(map(text.count, "0123456789"))


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind; leftmost and non-overlapping for each kind."""
    out: list[Span] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    n = digits_in(text)
    if n >= 4 and "." in text:
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if in_range(m[0])]
    if n >= 12:
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if n >= 9 and "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# Candidates: wider patterns by kind.
WIDER = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*\s?(?:@|\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|\(|00)?[0-9][0-9\x20().-]{7,18}[0-9](?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_-])"),
}
# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk eu ch at nl be us ca au in jp cn ru br mx".split())
ISSUER_STARTS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "65", "2")
CALLING_STARTS = ("1", "20", "27", "3", "4", "5", "6", "7", "8", "9")
CONTEXT = {
    "email": re.compile(r"(?i)e-?mail|contact|write|correo|courriel|schreib"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|login|adresse"),
    "card": re.compile(r"(?i)card|visa|master|payment|account|karte|carte|tarjeta|iban"),
    "phone": re.compile(r"(?i)phone|call|tel\b|tel\.|fax|mobile|ruf|appel|llam"),
    "secret": re.compile(r"(?i)token|secret|passw|api.?key|\bkey\b|bearer|credential"),
}
LABELERS = ("format", "check", "gazetteer", "context", "shape")
KNOWN_NEGATIVE = 0.01
#: Characters before a span that the context labeler reads.
NEAR = 32


def votes(text: str, a: int, b: int, kind: str) -> list[int]:
    """Each labeler's vote on a candidate: 1 for, -1 against, 0 none."""
    s, digits = text[a:b], digits_of(text[a:b])
    before, after = text[a - 1 : a], text[b : b + 1]
    cue = 1 if CONTEXT[kind].search(text, max(0, a - NEAR), a) else 0
    glued = (before.isalnum() and kind != "email") or after.isalnum()
    if kind == "email":
        strict = "@" in s and not re.search(r"\s", s)
        last = re.split(r"[.\s\])]+", s)[-1].lower()
        return [1 if strict else 0, 1 if re.search(r"[A-Za-z]{2,}$", s) else -1, 1 if last in TOP_DOMAINS else -1, cue, -1 if glued else 1]
    if kind == "ip":
        parts = [int(x) for x in s.split(".")]
        return [1, 1 if max(parts) <= 255 else -1, -1 if parts[0] in (0, 127) or parts[0] > 239 else 1, cue, -1 if glued or after == "." and text[b + 1 : b + 2].isdigit() else 1]
    if kind == "card":
        return [1 if len(digits) in (13, 14, 15, 16, 19) else -1, 1 if luhn(digits) else -1, 1 if digits.startswith(ISSUER_STARTS) else -1, cue, -1 if glued or len(set(digits)) < 4 else 1]
    if kind == "phone":
        return [1 if s[0] == "+" else -1, 1 if 9 <= len(digits) <= 15 else -1, 1 if s[0] == "+" and digits.startswith(CALLING_STARTS) else 0, cue, 1 if re.search(r"[\x20().-]", s) and not IP.fullmatch(s) else -1]
    mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    spread = len(set(s)) / min(len(s), 16)
    return [1 if mixed else -1, 1 if len(s) in (32, 40, 64) or len(s) % 4 == 0 else 0, 1 if re.fullmatch(r"[0-9a-fA-F]+|(sk|pk|ghp|AKIA)[A-Za-z0-9_-]+", s) else -1, cue, 1 if spread > 0.5 and before in "\"'=: " else -1]


#: Digits in a text under which a kind has no candidate in it.
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 7, "secret": 0}
#: Slots of the classifier's features.
FEATURES = 512
WORD = re.compile(r"[^\W\d_]+")


def outline(s: str) -> str:
    """A span's shape: runs of digits and letters as one sign each, other characters as they are."""
    return re.sub(r"[0-9]+", "9", re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", s)))


def char_class(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def span_features(text: str, a: int, b: int, kind: str, ballot: list[int]) -> list[int]:
    """The classifier's slots that are on: look, neighbours and votes of a span, each with its kind."""
    s = text[a:b]
    before, after = WORD.findall(text, max(0, a - NEAR), a), WORD.search(text, b, b + NEAR)
    seen = {
        "length": len(s).bit_length(), "digits": digits_in(s), "outline": outline(s)[:12], "separators": "".join(c for c in " .-()@+/_" if c in s), "variety": min(16, len(set(s))),
        "left": char_class(text[a - 1 : a] if a else ""), "right": char_class(text[b : b + 1]), "word before": before[-1].lower() if before else "", "word after": after[0].lower() if after else "",
        **dict(zip(LABELERS, ballot, strict=True)),
    }
    return sorted({zlib.crc32(f"{kind}|{name}|{value}".encode()) % FEATURES for name, value in [("", ""), *seen.items()]})


Candidate = tuple[int, int, int, int, list[int]]


def candidates(text: str) -> list[Candidate]:
    """(start, end, kind's number, code of kind and votes, features) of every candidate."""
    out, n = [], digits_in(text)
    for k, kind in enumerate(KINDS):
        if n < LEAST_DIGITS[kind] or (kind == "email" and not any(x in text for x in ("@", "at)", "at]", "at}"))):
            continue
        for m in WIDER[kind].finditer(text):
            if digits_in(m[0]) < LEAST_DIGITS[kind]:
                continue
            code, ballot = k, votes(text, m.start(), m.end(), kind)
            for v in ballot:
                code = code * 3 + v + 1
            out.append((m.start(), m.end(), k, code, span_features(text, m.start(), m.end(), kind, ballot)))
    return out


def decode(code: int) -> tuple[int, list[int]]:
    got = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        got.append(v - 1)
    return code, got[::-1]


def reliabilities(kinds: np.ndarray, ballots: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, prior of each kind, P(vote | class) by labeler) by EM.

    kinds and ballots (one of -1, 0, 1 for each labeler) describe patterns seen counts times.
    Pseudo-counts hold the labelers to being better than chance, and patterns that fail the check
    digit or range are known negatives; the two settle which class is which.
    """
    n_kinds, (n, n_labelers) = len(KINDS), ballots.shape
    start = np.array([[6.0, 2.0, 1.0], [1.0, 2.0, 6.0]])  # class by vote
    tables = np.repeat(start[None] / start.sum(1)[None, :, None], n_labelers, 0)
    prior = np.full(n_kinds, 0.5)
    post = np.full(n, 0.5)
    failed = ballots[:, LABELERS.index("check")] < 0
    for _ in range(rounds):
        like = np.log(np.stack((1 - prior[kinds], prior[kinds]), 1))
        for j in range(n_labelers):
            like += np.log(tables[j][:, ballots[:, j] + 1].T)
        post = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))
        post[failed] = KNOWN_NEGATIVE
        for j in range(n_labelers):
            for v in (-1, 0, 1):
                here = (ballots[:, j] == v) * counts
                tables[j, 1, v + 1], tables[j, 0, v + 1] = start[1, v + 1] + here @ post, start[0, v + 1] + here @ (1 - post)
            tables[j] /= tables[j].sum(1, keepdims=True)
        for k in range(n_kinds):
            own = (kinds == k) * counts
            prior[k] = (own @ post + 1) / (own.sum() + 2)
    return post, prior, tables


def train(slots: list[list[int]], y: np.ndarray, ridge: float = 1.0, rounds: int = 25, step: int = 2048) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method, some rows at a time."""
    w = np.zeros(FEATURES)
    for _ in range(rounds):
        bend, slope = ridge * np.eye(FEATURES), -ridge * w
        for at in range(0, len(slots), step):
            part = slots[at : at + step]
            x = np.zeros((len(part), FEATURES))
            x[np.repeat(np.arange(len(part)), [len(s) for s in part]), np.concatenate(part)] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (y[at : at + step] - p)
            bend += (x.T * (p * (1 - p))) @ x
        move = np.linalg.solve(bend, slope)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def chosen(base: list[Span], scored: list[tuple[float, Span]]) -> list[Span]:
    """The scored spans, the surest first and of equals the leftmost, that touch no base span and none chosen before."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(base):  # base spans of different kinds can overlap
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for _, span in sorted(scored, key=lambda c: (-c[0], c[1])):
        at = bisect_left(starts, span[1])
        if at and ends[at - 1] > span[0]:
            continue
        starts.insert(at, span[0])
        ends.insert(at, span[1])
        out.append(span)
    return out


class SpanModel:
    """What EM has found of the labelers, and the classifier trained on its posteriors."""

    def __init__(self, codes: list[int] = (), counts: list[int] = ()) -> None:
        self.tables = self.prior = self.weights = None
        self.posterior: dict[int, float] = {}
        if len(codes):
            kinds, ballots = (np.array(x) for x in zip(*map(decode, codes), strict=True))
            post, self.prior, self.tables = reliabilities(kinds, ballots, np.array(counts, float))
            self.posterior = dict(zip(codes, post.tolist(), strict=True))

    def learn(self, codes: list[int], slots: list[list[int]]) -> SpanModel:
        """Trains the classifier on candidates with these codes and features."""
        if codes:
            self.weights = train(slots, np.array([self.posterior[c] for c in codes]))
        return self

    def added(self, base: list[Span], found: list[Candidate]) -> list[Span]:
        """The candidates that are accepted and fit beside the base spans."""
        if self.weights is None or not found:
            return []
        scored = ((float(self.weights[slots].sum()), (a, b, KINDS[k])) for a, b, k, _, slots in found)
        return chosen(base, [c for c in scored if c[0] >= 0])

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans)."""
        base = base_spans(text)
        return base, every(base, self.added(base, candidates(text)))


def every(base: list[Span], added: list[Span]) -> list[Span]:
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if added else base


#: Candidates of a kind, the first by hash, that the classifier learns from.
SAMPLE = 2000
FOUND = "array<struct<a:int,b:int,kind:int,code:int,slots:array<int>>>"
FOUND_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.int32()), ("code", pa.int32()), ("slots", pa.list_(pa.int32()))]))


def _packed(found: list[list[Candidate]]) -> pa.Array:
    return pa.array([[dict(zip(("a", "b", "kind", "code", "slots"), c, strict=True)) for c in row] for row in found], FOUND_TYPE)


def fit(found: DataFrame) -> SpanModel:
    """A span model from a column found of candidates of every text.

    The driver gets one count for each of at most 1,215 patterns of votes, and of each kind's
    candidates about SAMPLE with their features.
    """
    each = found.select(F.explode("found").alias("c")).select("c.*")
    counts = each.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    model = SpanModel([r["code"] for r in counts], [r["n"] for r in counts])
    slots_of_hash = 1 << 30
    place = F.pmod(F.xxhash64("a", "b", "code", "slots"), F.lit(slots_of_hash))
    shares = {k: 0 for k in range(len(KINDS))}
    for r in counts:
        shares[decode(r["code"])[0]] += r["n"]
    within = [(F.col("kind") == k) & (place < (slots_of_hash if n <= 2 * SAMPLE else int(slots_of_hash * SAMPLE / n))) for k, n in shares.items() if n]
    if not within:
        return model
    chosen_rows = within[0]
    for w in within[1:]:
        chosen_rows |= w
    # equal candidates have equal hashes: each once, with how often it was seen
    rows = each.filter(chosen_rows).groupBy("code", "slots").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("code", "slots"), "code", "slots").limit(2 * SAMPLE * len(KINDS)).collect()
    codes, slots = [], []
    for r in rows:
        codes += [r["code"]] * min(r["n"], SAMPLE)
        slots += [list(r["slots"])] * min(r["n"], SAMPLE)
    return model.learn(codes, slots)


SCANNED = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<a:int,b:int,kind:int>>, found {FOUND}"
BASE_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.int32())]))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans with their counts and digest, and candidates of each row; texts are read once."""
    names = [x.split()[0] for x in SCANNED.split(", ")[:7]] + ["found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            digests, bases, found = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                bases.append([{"a": a, "b": b, "kind": KINDS.index(k)} for a, b, k in base])
                found.append(candidates(text) if text else [])
            arrays = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(bases, BASE_TYPE), _packed(found)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: base counts, a digest of the base spans, and all spans.

    docs needs doc_id and text; other columns are ignored. A null or empty text has no spans
    (an empty string, and its digest). Repeated rows give repeated rows. Offsets are code points.
    Of spans that the classifier is equally sure of the leftmost is taken. An empty table gives
    an empty result. A text with n candidates takes n log n steps.
    """
    once = cut(scanned(docs))
    model = fit(once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, found in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                own = [(s["a"], s["b"], KINDS[s["kind"]]) for s in base]
                spans.append(joined(every(own, model.added(own, [tuple(c.values()) for c in found]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(spans, pa.string())], names=[x.split()[0] for x in REPORT.split(", ")])

    return once.mapInArrow(run, REPORT)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by <kind> of the first."""
    out, at, end = [], 0, 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[at:a], f"<{kind}>"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def found_in(docs: DataFrame) -> DataFrame:
    """A column found of the candidates of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for c in map(candidates, filter(None, batch.column(0).to_pylist())) if c]
            yield pa.RecordBatch.from_arrays([_packed(found)], names=["found"])

    return docs.select("text").mapInArrow(run, f"found {FOUND}")


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs with all spans in text replaced by their kind, and n_chars, where it is a column, brought up to date.

    Null and empty texts stay, as do all other columns, whatever their names, and repeated
    rows; an empty table stays empty. Texts are read twice, to learn and to redact, so that no
    copy of them is written in between.
    """
    model = fit(cut(found_in(docs)))
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t, model.spans(t)[1]) for t in batch.column(text_at).to_pylist()]
            arrays = list(batch.columns)
            arrays[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if chars_at is not None:
                new = [n if t is None else len(t) for t, n in zip(texts, batch.column(chars_at).to_pylist(), strict=True)]
                arrays[chars_at] = pa.array(new, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
