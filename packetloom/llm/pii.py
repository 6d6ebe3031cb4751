"""Personal data: fixed patterns, plus a semi-Markov conditional random field.

The field scores whole candidate spans of at most 24 tokens with features of the span and its
surroundings; dynamic programming chooses boundaries and types together. It is trained by maximum
likelihood on a bounded sample of the given documents: the patterns mark the spans, and copies in
other spellings (a phone number without its country prefix, a spelled-out ``at`` and ``dot``) teach it
what the patterns miss. Its spans are added only where no pattern span lies.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import count_kind, joined_spans, map_rows, span_digest

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
CONTEXT, MAX_TOKENS, MIN_DIGITS = 24, 24, 4
CUES = {"phone": 0, "tel": 0, "call": 0, "mobile": 0, "fax": 0, "mail": 1, "email": 1, "contact": 1, "ip": 2, "host": 2, "server": 2, "address": 2,
        "card": 3, "visa": 3, "credit": 3, "account": 3}
FEATURES = 44
MAX_DOCS, MAX_WINDOWS = 2_000, 250


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans, by start then kind."""
    found, edge = [], 0
    at = text.find("@")
    while at >= 0:  # every match holds exactly one @, so the search goes from one to the next
        start = at
        while start > edge and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            edge = m.end()
        else:
            edge = at + 1
        at = text.find("@", edge)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                found.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum("0" <= c <= "9" for c in m.group()) <= PHONE_DIGITS[1]:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs that could hold an entity: an at sign, or four digits."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.start() <= out[-1][1] + 6:
            out[-1][1] = m.end()
            out[-1][2] += m.group() in "0123456789"
            out[-1][3] |= m.group() not in "0123456789"
        else:
            out.append([m.start(), m.end(), int(m.group() in "0123456789"), m.group() not in "0123456789"])
    return [(max(0, a - CONTEXT), min(len(text), b + CONTEXT)) for a, b, digits, sign in out if sign or digits >= MIN_DIGITS]


def features(text: str, start: int, end: int, tokens: int, cue: int) -> list[int]:
    """Numbers of the features that a candidate span has."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in span)
    signs, dots, spaces = span.count("@"), span.count("."), sum(c.isspace() for c in span)
    n = len(digits)
    has = [0, 1 + min(signs, 2), 4 + (0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 10 else 4 if n < 14 else 5 if n < 20 else 6)]
    has.append(11 + min(dots, 4))
    if letters == 0:
        has.append(16)
        if not span.strip("0123456789 -"):
            has.append(17)
            if 14 <= n <= 19:
                has.append(18 if luhn(digits) else 19)
        if n and not span.strip("0123456789."):
            parts = span.split(".")
            if len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts):
                has.append(20)
        if n and re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}", span):
            has.append(21)
    else:
        has.append(22)
        if signs == 1 and re.fullmatch(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", span):
            has.append(23)
        if re.fullmatch(r"[\w.%+-]+\s?(?:@|[\[(]at[\])]|\sat\s)\s?[\w-]+(?:\s?(?:\.|[\[(]dot[\])]|\sdot\s)\s?[\w-]+)+", span, re.I):
            has.append(24)
        if spaces:
            has.append(25)
    has.append(26 if span[0] == "+" else 27 if span[0] == "(" else 28 if span[0].isdigit() else 29 if span[0].isalpha() else 30)
    has.append(31 if span[-1].isdigit() else 32 if span[-1].isalpha() else 33)
    before, after = text[start - 1:start], text[end:end + 1]
    has.append(34 if not before or before.isspace() else 35 if before.isalnum() else 36)
    has.append(37 if not after or after.isspace() else 38 if after.isalnum() else 39)
    if cue >= 0:
        has.append(40 + cue)
    return has


def lattice(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token borders of a window, and candidate segments (first border, last border, features)."""
    borders, cue_at, cue = [start], [-1], -1
    words = []
    for m in TOKEN.finditer(text, start, end):
        word = m.group()
        words.append(word)
        borders.append(m.end())
        cue = CUES.get(word.lower(), cue)
        cue_at.append(cue)
    marked = [bool(TRIGGER.search(w)) for w in words]
    for i in range(len(words) - 2):
        if words[i] in "[(" and words[i + 1].lower() == "at" and words[i + 2] in "])":
            marked[i + 1] = True
    segments = []
    for i, first in enumerate(words):
        if first.isspace() or not (first[0].isalnum() or first in "+("):
            continue
        hit = False
        for j in range(i, min(len(words), i + MAX_TOKENS)):
            hit = hit or marked[j]
            if "\n" in words[j]:
                break
            if hit and words[j][-1].isalnum():
                segments.append((i, j + 1, features(text, borders[i], borders[j + 1], j + 1 - i, cue_at[i])))
    return borders, segments


@dataclass
class Field:
    """Feature weights per entity type, and transitions between labels (0 is outside)."""

    weights: np.ndarray  # [types, features]
    moves: np.ndarray  # [types + 1, types + 1]

    @classmethod
    def empty(cls) -> "Field":
        weights = np.zeros((len(KINDS), FEATURES))
        weights[:, 0] = -5.0  # without training nothing but the patterns is reported
        return cls(weights, np.zeros((len(KINDS) + 1,) * 2))

    def scores(self, segments) -> np.ndarray:
        return np.array([self.weights[:, f].sum(axis=1) for _, _, f in segments]).reshape(-1, len(KINDS))

    def decode(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        """Entities of the best segmentation of a window."""
        borders, segments = lattice(text, start, end)
        if not segments:
            return []
        scored, n, types = self.scores(segments), len(borders) - 1, len(KINDS) + 1
        ending: dict[int, list[int]] = {}
        for s, (_, j, _) in enumerate(segments):
            ending.setdefault(j, []).append(s)
        best, back = np.full((n + 1, types), -np.inf), {}
        best[0, 0] = 0.0
        for j in range(1, n + 1):
            arrive = best[j - 1] + self.moves[:, 0]
            best[j, 0], back[j, 0] = arrive.max(), (j - 1, int(arrive.argmax()))
            for s in ending.get(j, ()):
                i = segments[s][0]
                arrive = best[i][:, None] + self.moves[:, 1:]
                total, source = arrive.max(axis=0) + scored[s], arrive.argmax(axis=0)
                for y in np.flatnonzero(total > best[j, 1:]):
                    best[j, y + 1], back[j, y + 1] = total[y], (i, int(source[y]))
        at, y, found = n, int(best[n].argmax()), []
        while at:
            before, source = back[at, y]
            if y:
                found.append((KINDS[y - 1], borders[before], borders[at]))
            at, y = before, source
        return found[::-1]


def prepare(text: str, spans: list[tuple[str, int, int]]):
    """Lattice of one training window and the labels of its true segments, or None if a span is no candidate."""
    borders, segments = lattice(text, 0, len(text))
    place = {(borders[i], borders[j]): s for s, (i, j, _) in enumerate(segments)}
    truth = {}
    for kind, a, b in spans:
        if (a, b) not in place:
            return None
        truth[place[a, b]] = KINDS.index(kind)
    matrix = np.zeros((len(segments), FEATURES))
    for row, (_, _, f) in zip(matrix, segments):
        row[f] = 1
    starts, ends = np.array([s[0] for s in segments], int), np.array([s[1] for s in segments], int)
    by_end = [np.flatnonzero(ends == j) for j in range(len(borders))]
    by_start = [np.flatnonzero(starts == j) for j in range(len(borders))]
    path, at = [], 0
    inside = {segments[s][0]: (segments[s][1], s, y + 1) for s, y in truth.items()}
    while at < len(borders) - 1:
        nxt, s, y = inside.get(at, (at + 1, None, 0))
        path.append((s, y))
        at = nxt
    return len(borders) - 1, starts, ends, by_end, by_start, matrix, path


def expectation(window, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected feature and transition counts of one window."""
    n, starts, ends, by_end, by_start, matrix, path = window
    types = len(KINDS) + 1
    scored = matrix @ field.weights.T
    ahead, behind = np.full((n + 1, types), -np.inf), np.full((n + 1, types), -np.inf)

    def soft(x, axis):
        top = x.max(axis=axis, keepdims=True)
        top = np.where(np.isfinite(top), top, 0)
        return np.log(np.exp(x - top).sum(axis=axis) + 1e-300) + np.squeeze(top, axis)

    into = np.full((n + 1, types), -np.inf)  # score of reaching a border and starting a segment of a type there
    ahead[0, 0] = 0.0
    for j in range(n + 1):
        if j:
            ahead[j, 0] = into[j - 1, 0]
            if len(by_end[j]):
                s = by_end[j]
                ahead[j, 1:] = soft(into[starts[s], 1:] + scored[s], 0)
        into[j] = soft(ahead[j][:, None] + field.moves, 0)
    total = float(soft(ahead[n], 0))
    behind[n] = 0.0
    leave = np.full((n + 1, types), -np.inf)  # score of everything from a segment of a type that starts here
    for j in range(n - 1, -1, -1):
        leave[j, 0] = behind[j + 1, 0]
        if len(by_start[j]):
            s = by_start[j]
            leave[j, 1:] = soft(scored[s] + behind[ends[s], 1:], 0)
        behind[j] = soft(field.moves + leave[j][None], 1)
    gradient, moves = np.zeros_like(field.weights), np.zeros_like(field.moves)
    if len(starts):
        p = np.exp(np.minimum(into[starts, 1:] + scored + behind[ends, 1:] - total, 0))
        gradient -= p.T @ matrix
    for j in range(n):
        moves -= np.exp(np.minimum(ahead[j][:, None] + field.moves + leave[j][None] - total, 0))
    before = 0
    for s, y in path:
        moves[before, y] += 1
        if y:
            gradient[y - 1] += matrix[s]
        before = y
    return gradient, moves


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 30, rate: float = 0.3, decay: float = 2e-3) -> Field:
    """Maximum likelihood with adaptive steps over (window text, spans) examples."""
    ready = [w for w in (prepare(t, s) for t, s in examples) if w is not None]
    if not any(y for w in ready for _, y in w[-1]):
        return Field.empty()
    field = Field(np.zeros((len(KINDS), FEATURES)), np.zeros((len(KINDS) + 1,) * 2))
    shape, size = field.weights.shape, field.weights.size
    m, v = np.zeros(size + field.moves.size), np.zeros(size + field.moves.size)
    for step in range(1, rounds + 1):
        both = [expectation(w, field) for w in ready]
        gradient = sum(g for g, _ in both) / len(ready) - decay * field.weights
        moves = sum(t for _, t in both) / len(ready) - decay * field.moves
        g = np.concatenate([gradient.ravel(), moves.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        field = Field(field.weights + move[:size].reshape(shape), field.moves + move[size:].reshape(field.moves.shape))
    return field


def respelled(text: str, spans: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]] | None:
    """The window with its only span in a spelling that the patterns miss."""
    if len(spans) != 1:
        return None
    kind, a, b = spans[0]
    old = text[a:b]
    if kind == "phone":
        new = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", old)
    elif kind == "email":
        name, _, domain = old.partition("@")
        new = f"{name} [at] {domain}" if a % 2 else f"{name} (at) {domain.replace('.', ' (dot) ')}"
    else:
        return None
    return (text[:a] + new + text[b:], [(kind, a, a + len(new))]) if new != old else None


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS) -> Field:
    """Field from the windows of at most ``max_docs`` documents that hold a digit or an at sign, first by a hash of id and text;
    at most ``max_windows`` windows are used, shared out evenly over the kinds and windows without a span. Of a document the
    first eight windows, and of those the ones of at most 400 characters, may be used; equal rows count once."""
    order = F.xxhash64("doc_id", "text")
    sample = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]")).withColumn("order", order)
    chosen = sample.select("order").orderBy("order").limit(max_docs)
    rows = sample.join(chosen.distinct(), "order", "left_semi").dropDuplicates(["order"])

    def start():
        def cut(key, text):
            spans = base_spans(text)
            out = []
            for a, b in windows(text)[:8]:
                own = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
                if b - a <= 400 and len(own) == sum(s < b and e > a for _, s, e in spans):
                    out.append((own[0][0] if own else "none", text[a:b], [{"kind": k, "start": s, "end": e} for k, s, e in own]))
            return out

        return cut

    found = map_rows(rows, ["order", "text"], start, "kind string, text string, spans array<struct<kind:string,start:long,end:long>>").collect()
    found = sorted((r["kind"], r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in found)
    share, examples = max_windows // (len(KINDS) + 1), []
    for kind in (*KINDS, "none"):
        own = [(t, s) for k, t, s in found if k == kind]
        own = own[::max(1, len(own) // share)][:share]
        other = [x for x in (respelled(t, s) for t, s in own) if x is not None]
        examples += own + other
    return train(examples)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id``, ``spans``: array of (kind, start, end) by start then kind; kinds of the field carry ``crf_``.

    Offsets are code points, ends exclusive. A null or empty text has no spans; every input row returns
    once, repeated and null ids included. Without a given field one is fitted to the documents.
    """
    field = field or fit(docs)
    order = {k: i for i, k in enumerate((*KINDS, *(f"crf_{k}" for k in KINDS)))}

    def start():
        def find(key, text):
            spans = []
            if text and TRIGGER.search(text):
                spans = base_spans(text)
                known = sorted((a, b) for _, a, b in spans)
                extra = []
                for a, b in windows(text):
                    inside = [k for k in known if k[0] < b and k[1] > a]
                    for kind, s, e in field.decode(text, a, b):
                        if not any(s < y and e > x for x, y in inside) and not (extra and extra[-1][2] > s):
                            extra.append((f"crf_{kind}", s, e))
                spans = sorted(spans + extra, key=lambda x: (x[1], order[x[0]]))
            return [(key, [{"kind": k, "start": a, "end": b} for k, a, b in spans])]

        return find

    return map_rows(docs, ["doc_id", "text"], start, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and checksums per document of what ``scan`` found."""
    added = F.size(F.filter("spans", lambda s: s["kind"].startswith("crf_"))).cast("long")
    return found.select("doc_id", *[count_kind("spans", k).alias(f"n_{k}") for k in KINDS], span_digest("spans", KINDS).alias("base_sha256"),
                        joined_spans(F.col("spans")).alias("spans"), added.alias("n_added"))
