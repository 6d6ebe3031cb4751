"""Secret scan: fixed patterns, plus guess-cost dynamic programming over credential values.

A value next to a credential name is cut into the cheapest sequence of dictionary words, dates,
repeats, keyboard walks, sequences and brute-force spans. The cost is the number of guesses an
attacker who knows those families needs: (number of parts)! times the product of the parts'
guesses, plus 10,000 to the power (parts - 1). A value that costs enough is reported.
"""

from __future__ import annotations

import math
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import count_kind, joined_spans, map_rows, span_digest

KINDS = ("assign", "access", "hex")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20
#: Names that open a credential context; the value may hold any visible character.
CONTEXT = re.compile(r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?(?:key|token)|credentials?|bearer)["']?"""
                     r"""\s{0,8}(?::|=>|=)\s{0,8}(?:"([^"\s]{4,})"|'([^'\s]{4,})'|([^\s"'<>,;]{4,}))""", re.I | re.A)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")
#: Common passwords, most frequent first; replace by a longer ranked list through ``words``.
COMMON = ("123456 password qwerty admin welcome letmein dragon monkey football baseball master sunshine princess shadow "
          "iloveyou abc123 login starwars hello freedom whatever trustno1 secret token changeme default example test guest root "
          "user none null true false required optional your here my key pass word value string insert enter change summer winter "
          "spring autumn love angel charlie michael jordan hunter batman superman killer soccer hockey ranger buster thomas tigger "
          "robert access flower cheese computer internet database server oracle mysql postgres redis system service private public").split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("43105$@7", "aeiossat")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
REPEAT = re.compile(r"(.{1,12}?)\1+", re.S)
LETTERS = re.compile(r"[A-Za-z]+")
UNKNOWN_WORD = 1 << 17
FAMILIES = ("brute force", "word", "date", "repeat", "walk", "sequence")
MAX_PARTS = 24  # with more, the additive term alone passes 10**92


def keyboard() -> dict[str, set[str]]:
    """Neighbours of every key: same row, and the two nearest keys of the rows above and below."""
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            around = [(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x), (y + 1, x - 1)]
            near[key] = {ROWS[j][i] for j, i in around if 0 <= j < len(ROWS) and 0 <= i < len(ROWS[j])}
    return near


def piece_finder(words: list[str] | None = None):
    """``pieces(value)``: everything in a value that is cheaper than brute force may be."""
    ranks = {w: i + 1 for i, w in reversed(list(enumerate(words or COMMON)))}
    longest = max(map(len, ranks))
    heads, tails = {w[:3] for w in ranks}, {w[:-4:-1] for w in ranks}  # first letters of a word, and of one written backwards
    near = keyboard()
    log = math.log10

    def variations(piece: str) -> float:
        """Factor for capital letters: none, first or all cost 2, others every choice of positions."""
        up = sum(c.isupper() for c in piece)
        if not up:
            return 0.0
        if up == len(piece) or piece[0].isupper() and up == 1:
            return log(2)
        low = len(piece) - up
        return log(sum(math.comb(up + low, i) for i in range(1, min(up, low) + 1)))

    def pieces(value: str) -> dict[int, list[tuple[int, float, str]]]:
        """By end: (start, log10 guesses, family)."""
        found: dict[int, list[tuple[int, float, str]]] = {}
        plain, n = value.lower(), len(value)
        if len(plain) != n:
            plain = value
        leet = plain.translate(LEET)

        def add(start, end, cost, family):
            found.setdefault(end, []).append((start, cost, family))

        for i in range(n):
            if plain[i:i + 3] not in heads and leet[i:i + 3] not in heads and plain[i:i + 3] not in tails:
                continue
            for j in range(i + 3, min(n, i + longest) + 1):
                for text, extra in ((plain[i:j], 0.0), (leet[i:j], log(2)), (plain[i:j][::-1], log(2))):
                    if rank := ranks.get(text):
                        add(i, j, log(rank) + variations(value[i:j]) + extra, "word")
                        break
        for m in LETTERS.finditer(value):  # a readable run that no list has is a word of a large dictionary
            run = m.group().lower()
            vowels = sum(c in "aeiouy" for c in run)
            if 3 <= len(run) <= 16 and 0.2 <= vowels / len(run) <= 0.7 and not re.search(r"[^aeiouy]{5}|(.)\1\1", run):
                add(m.start(), m.end(), log(UNKNOWN_WORD) + variations(m.group()), "word")
        for i in range(n):
            if m := DATE.match(value, i):
                add(i, m.end(), log(365 * 120) + (log(4) if re.search(r"\D", m.group()) else 0), "date")
        for m in REPEAT.finditer(value):
            unit = len(m.group(1))
            add(m.start(), m.end(), unit + log((m.end() - m.start()) // unit), "repeat")
        for family, joined, base in (("walk", lambda a, b: b in near.get(a, ()), log(48 * 5)),
                                     ("sequence", lambda a, b: abs(ord(a) - ord(b)) == 1, log(26))):
            start = 0
            for i in range(1, n + 1):
                if i == n or not joined(plain[i - 1], plain[i]):
                    if i - start >= 3:
                        turns = sum(ord(plain[k]) - ord(plain[k - 1]) != ord(plain[k - 1]) - ord(plain[k - 2]) for k in range(start + 2, i))
                        add(start, i, base + log(i - start) + (0.6 * turns if family == "walk" else 0), family)
                    start = i
        return found

    return pieces


def guess_matcher(words: list[str] | None = None):
    """``cost(value) -> (log10 guesses, parts)`` where parts are (family, start, end)."""
    pieces, log = piece_finder(words), math.log10

    def cost(value: str) -> tuple[float, list[tuple[str, int, int]]]:
        """Between the ends and starts of pieces an open brute-force part only grows by one a character, so rows are kept at those places alone."""
        by_end, n, far = pieces(value), len(value), math.inf
        top = min(MAX_PARTS, n)
        if not top:
            return 0.0, []
        starts = {start for found in by_end.values() for start, _, _ in found}
        # best[k][l]: cheapest l parts over the first k characters; back[k][l]: start of the last one and its family
        best = {0: array("d", [0.0] + [far] * top)}
        back: dict[int, array] = {}
        # the open brute-force part after ``at`` characters: cost with l parts, and where it began
        at, brute, open_at = 0, array("d", [far, 0.0] + [far] * (top - 1)), array("q", [0] * (top + 1))
        for k in sorted((starts | by_end.keys() | {n}) - {0}):
            brute = array("d", [c + (k - at) for c in brute])
            row, source, fixed, at = brute[:], array("q", [o * len(FAMILIES) for o in open_at]), array("d", [far] * (top + 1)), k
            for start, guesses, family in by_end.get(k, ()):
                code, before = start * len(FAMILIES) + FAMILIES.index(family), best[start]
                for parts in range(1, top + 1):
                    if (total := before[parts - 1] + guesses) < fixed[parts]:
                        fixed[parts] = total
                        if total < row[parts]:
                            row[parts], source[parts] = total, code
            best[k], back[k] = row, source
            for parts in range(1, top + 1):
                if fixed[parts - 1] < brute[parts]:
                    brute[parts], open_at[parts] = fixed[parts - 1], k
        guesses, parts = min((max(best[n][p] + log(math.factorial(p)), 4.0 * (p - 1)), p) for p in range(1, top + 1))
        steps, end = [], n
        while end and parts:
            start, family = divmod(back[end][parts], len(FAMILIES))
            steps.append((FAMILIES[family], start, end))
            end, parts = start, parts - 1
        return guesses, steps[::-1]

    return cost


def scan(docs: DataFrame, min_log10: float = 8.0, words: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``spans``: array of (kind, start, end, log10_guesses, parts), by start then kind.

    Kinds ``assign``, ``access`` and ``hex`` are the patterns; ``guess`` is the value of a credential
    context that costs at least 10**``min_log10`` guesses. Offsets are code points, ends exclusive.
    Assigned and context values carry their cost and parts. A null or empty text has no spans; every
    input row returns once, repeated and null ids included. Values are priced whole, in time that grows with their
    length and at most 0.4 KB of memory a character (a tenth of it for random ones).
    """
    order = {k: i for i, k in enumerate((*KINDS, "guess"))}

    def start():
        cost = guess_matcher(words)

        def priced(value):
            guesses, parts = cost(value)
            return round(guesses, 6), ",".join(f"{f}:{a}:{b}" for f, a, b in parts)

        def find(key, text):
            spans = []
            if text:
                lower = text.lower()
                if any(w in lower for w in CONTEXT_WORDS):
                    for m in ASSIGN.finditer(text):
                        if len(m.group(2)) >= ASSIGN_MIN:
                            spans.append(("assign", m.start(), m.end(), *priced(m.group(2))))
                    for m in CONTEXT.finditer(text):
                        g = m.lastindex
                        guesses, parts = priced(m.group(g))
                        if guesses >= min_log10:
                            spans.append(("guess", m.start(g), m.end(g), guesses, parts))
                if "AKIA" in text:
                    spans += [("access", m.start(), m.end(), None, None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
                spans += [("hex", m.start(), m.end(), None, None) for m in HEX.finditer(text)]
                spans.sort(key=lambda s: (s[1], order[s[0]]))
            return [(key, [dict(zip(("kind", "start", "end", "log10_guesses", "parts"), s)) for s in spans])]

        return find

    return map_rows(docs, ["doc_id", "text"], start,
                    "doc_id long, spans array<struct<kind:string,start:long,end:long,log10_guesses:double,parts:string>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and checksums per document of what ``scan`` found."""
    guesses = F.array_max(F.transform("spans", lambda s: s["log10_guesses"]))
    return found.select("doc_id", *[count_kind("spans", k).alias(f"n_{k}") for k in KINDS],
                        span_digest("spans", KINDS).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"),
                        count_kind("spans", "guess").alias("n_guess"), guesses.alias("max_log10_guesses"))
