"""Order-preserving packing: dynamic programming over cut points with a monotone queue.

Each input partition is one token stream, in row order. A window may end at a document end (free),
at a sentence end or, in sentences longer than ``hard_step`` tokens, at every ``hard_step``-th token;
the last two pay a truncation penalty. The cheapest chain of windows pays padding plus penalties:
``best[j] = pen[j] + min(best[i] + window - (pos[j] - pos[i]))`` over cuts i at most one window back,
whose minimum a monotone queue keeps in constant time; windows of a power of two pay no padding.
Streams are solved in runs of bounded size, and what follows a run's last cut opens the next run.
"""

from __future__ import annotations

import os
import sys
import types
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from packetloom.llm.common import arrow_schema, to_batch

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CACHE_WORDS = 1_000_000
#: White space to Python's split() but not to the tokenizer.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
# Fixed value: how the tokenizer file cuts a run without white space, for lower-case Latin text.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LAST_LATIN = "\u024f"


def byte_letters() -> dict[int, str]:
    """Letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class WordEncoder:
    """Token ids of texts through a tokenizer that lower-cases and drops white space.

    Each run between white space is encoded once and remembered; the memory is bounded and outlives
    the task in a reused worker. Latin runs go piece by piece to the tokenizer's own merge model,
    any other run (and any text with odd white space) through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.vocab = self.tokenizer.model, self.tokenizer.get_vocab()
        self.pieces, self.letters = regex.compile(PIECE), byte_letters()
        self.known: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {}
        #: The piecewise path is used only if it gives what the whole tokenizer gives on a probe.
        self.piecewise = True
        probe = "Don't stop: ÉCOLE straße, 42 naïve--words... we'll see_it!"
        self.piecewise = b"".join(map(self.run, probe.split())) == self.whole(probe)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def run(self, word: str) -> bytes:
        if word.isascii():
            low = word.lower()
        elif self.piecewise and max(word) <= LAST_LATIN:
            low = unicodedata.normalize("NFC", word).lower()
        else:
            return self.whole(word)
        if not self.piecewise or "<|" in low:
            return self.whole(word)
        if low.isalpha():
            return self.known_pieces.get(low) or self.merge(low)
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return (self.known_pieces.get(low[:-1]) or self.merge(low[:-1])) + (self.known_pieces.get(low[-1]) or self.merge(low[-1]))
        return b"".join([self.known_pieces.get(p) or self.merge(p) for p in self.pieces.findall(low)])

    def merge(self, piece: str) -> bytes:
        seen = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        ids = self.known_pieces[piece] = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACE):
            return self.whole(text)
        words = text.split()
        parts = list(map(self.known.get, words))
        if None in parts:
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            if len(self.known_pieces) > CACHE_WORDS // 2:
                self.known_pieces = {}
            known = self.known
            for i, ids in enumerate(parts):
                if ids is None:
                    word = words[i]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = self.run(word)
                    parts[i] = ids
        return b"".join(parts)


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and path."""
    kept = sys.modules.setdefault("_word_encoders", types.ModuleType("_word_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def sentence_ends(vocab: dict[str, int]) -> np.ndarray:
    """Table over ids: does the token end a word and consist of closing punctuation with . ! or ?"""
    table = np.zeros(max(vocab.values(), default=0) + 1, bool)
    for token, number in vocab.items():
        word = token.removesuffix("</w>")
        table[number] = token.endswith("</w>") and word[:1] in (".", "!", "?") and not any(c.isalnum() for c in word if c.isascii())
    return table


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, window: int, least_power: int, until_end: bool) -> list[int]:
    """Positions of the chosen cuts, from ``pos[0]``; the last is ``pos[-1]`` if ``until_end``, else within a window of it."""
    at, pen = pos.tolist(), penalty.tolist()
    n, top = len(at), at[-1]
    exact: dict[int, list[int]] = {}  # cuts that lie a power of two behind
    for p in (1 << k for k in range(window.bit_length())):
        if least_power <= p < window:
            back_to = np.searchsorted(pos, pos - p)
            for j in np.flatnonzero(pos[back_to] == pos - p).tolist():
                exact.setdefault(j, []).append(int(back_to[j]))
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(best[0] + at[0], 0)])
    for j in range(1, n):
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        key, i = queue[0]
        cost = key + window - here
        if j in exact:
            for k in exact[j]:
                if best[k] < cost:
                    cost, i = best[k], k
        best[j] = cost = cost + pen[j]
        back[j] = i
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    last = n - 1
    if not until_end:
        near = range(int(np.searchsorted(pos, top - window, side="right")), n)
        last = min((j for j in near if j), key=lambda j: (best[j], -j))
    cuts = [last]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [at[j] for j in reversed(cuts)]


class Packer:
    """Packs one stream; ``add`` and ``finish`` yield piece tuples."""

    def __init__(self, window: int, ends: np.ndarray, first_id: int, sentence_cost: float, hard_cost: float, hard_step: int,
                 run_tokens: int):
        self.window, self.ends, self.sequence = window, ends, first_id
        self.sentence_cost, self.hard_cost, self.hard_step, self.run_tokens = sentence_cost, hard_cost, hard_step, run_tokens
        self.docs: list[tuple] = []  # (doc_id, start of what is left, its ids, tokens of the document)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)
        if self.held >= self.run_tokens:
            yield from self._flush(False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._flush(True)

    def _nodes(self, stream: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cost = np.full(len(stream) + 1, np.inf)
        cost[1:][self.ends[np.minimum(stream, len(self.ends) - 1)] & (stream < len(self.ends))] = self.sentence_cost
        cost[0], cost[doc_ends] = 0.0, 0.0
        pos = np.flatnonzero(cost < np.inf)
        for g in np.flatnonzero(np.diff(pos) > self.hard_step).tolist():
            cost[pos[g] + self.hard_step:pos[g + 1]:self.hard_step] = self.hard_cost
        pos = np.flatnonzero(cost < np.inf)
        penalty = cost[pos]
        return pos, penalty

    def _flush(self, final: bool) -> Iterator[tuple]:
        stream = np.concatenate([d[2] for d in self.docs])
        starts = np.cumsum([0] + [len(d[2]) for d in self.docs])
        pos, penalty = self._nodes(stream, starts[1:])
        cuts = choose_cuts(pos, penalty, self.window, self.window // 4, final)
        if final:
            cuts[-1:] = self._split_tail(cuts[-2], cuts[-1])
        doc = 0
        for a, b in zip(cuts, cuts[1:]):
            while starts[doc + 1] <= a:
                doc += 1
            k = doc
            while k < len(self.docs) and starts[k] < b:
                key, before, ids, total = self.docs[k]
                lo, hi = max(a - starts[k], 0), min(b - starts[k], len(ids))
                if hi > lo:
                    yield (key, int(before + lo), int(hi - lo), zlib.crc32(ids[lo:hi].tobytes()), total, self.sequence, int(starts[k] + lo - a))
                k += 1
            self.sequence += 1
        left = []
        for k, (key, before, ids, total) in enumerate(self.docs):
            if starts[k + 1] > cuts[-1]:
                lo = max(cuts[-1] - int(starts[k]), 0)
                left.append((key, before + lo, ids[lo:], total))
        self.docs, self.held = left, int(starts[-1] - cuts[-1])

    def _split_tail(self, a: int, b: int) -> list[int]:
        """The last window of a stream, in powers of two where that costs less than padding it."""
        size = b - a
        if size & (size - 1) == 0 or self.window - size <= self.hard_cost * (bin(size).count("1") - 1):
            return [b]
        cuts = []
        for k in range(size.bit_length() - 1, -1, -1):
            if size >> k & 1:
                a += 1 << k
                cuts.append(a)
        return cuts


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, sentence_cost: float = 2.0,
         hard_cost: float = 16.0, hard_step: int = 256, run_tokens: int = 1 << 18) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every input row is one document of its ids plus ``end_id``; a null or empty text is that id alone.
    Repeated rows are packed each, null ids stay null. Sequences never span input partitions; their
    ids are the partition number times 2**32 plus a count, so a repeated task repeats its rows.
    """

    arrow = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        packer = Packer(window, sentence_ends(coder.vocab), TaskContext.get().partitionId() << 32, sentence_cost, hard_cost, hard_step,
                        run_tokens)
        end, out = np.array([end_id], "<u4").tobytes(), []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out.extend(packer.add(key, np.frombuffer(coder.encode(text.as_py() or "") + end, "<u4")))
                if len(out) >= 10_000:
                    yield to_batch(out, arrow)
                    out = []
        out.extend(packer.finish())
        if out:
            yield to_batch(out, arrow)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
