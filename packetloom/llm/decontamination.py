"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a run of ``width`` consecutive words of a benchmark item (all its words where it has
fewer). The symbols are words: a table over blocks of three words says how far a search may jump,
blocks that end a pattern open a bucket of test strings, and comparing words confirms each hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import map_rows, saved

BLOCK = 3
HITS = "array<struct<start:long,end:long>>"


def word_table() -> bytes:
    """Byte table: A-Z to a-z, other ASCII but digits and letters to a space; bytes of longer characters stay."""
    return bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Matcher:
    """Shift tables and buckets for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(BLOCK, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket.setdefault(words[length - self.block:], []).append((words, items))

    def search(self, words: list[bytes]):
        """(start, end, items) of every occurrence."""
        length, block, shift, jump, bucket = self.length, self.block, self.shift.get, self.jump, self.bucket
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block:end])
            far = shift(key, jump)
            if far:
                end += far
                continue
            here = tuple(words[end - length:end])
            for pattern, items in bucket[key]:
                if pattern == here:
                    yield end - length, end, items
            end += 1


def windows(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``window`` (words joined by spaces), once per item; null or wordless texts have none."""

    def start():
        table = word_table()

        def cut(key, text):
            words = (text or "").encode().translate(table).split()
            if not words:
                return []
            return [(key, b" ".join(words[i:i + width]).decode()) for i in range(max(1, len(words) - width + 1))]

        return cut

    named = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    return map_rows(named, ["item_id", "text"], start, "item_id long, window string").distinct()


def search(docs: DataFrame, items: DataFrame, width: int = 10, max_windows: int = 500_000) -> DataFrame:
    """``doc_id``, ``n_words``, ``hits`` (merged word ranges) and ``items`` (distinct ids) per document row.

    Patterns reach the tasks in blocks of about ``max_windows`` (item, window) pairs, dealt by hash; a
    larger benchmark takes several passes, each over all documents, with the hits merged. Null texts
    have no words. An item without an id still marks words but is not listed. Every row returns once.
    """
    patterns = saved(windows(items, width), "windows")
    blocks = max(1, -(-patterns.count() // max_windows))
    dealt = F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks))
    found = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(HITS).alias("hits"),
                        F.lit(None).cast("array<long>").alias("items"))
    for block in range(blocks):
        rows = patterns.filter(dealt == block).collect()
        last = block == blocks - 1
        found = _pass(found, [(r["item_id"], r["window"]) for r in rows], last)
        if not last:
            found = saved(found, "scanned")
    return found.select("doc_id", "n_words", "hits", "items")


def _pass(found: DataFrame, rows: list[tuple[int | None, str]], last: bool) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(rows)

    def start():
        table = word_table()
        by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for item, window in shared.value:
            words = tuple(window.encode().split(b" "))
            by_length.setdefault(len(words), {}).setdefault(words, []).append(item)
        matchers = [Matcher(n, patterns) for n, patterns in sorted(by_length.items())]

        def scan(key, text, _, hits, items):
            words = (text or "").encode().translate(table).split()
            spans = [(h["start"], h["end"]) for h in hits or ()]
            listed = set(items or ())
            for matcher in matchers:
                for start, end, owners in matcher.search(words):
                    spans.append((start, end))
                    listed.update(owners)
            merged: list[list[int]] = []
            for start, end in sorted(spans):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            listed.discard(None)
            return [(key, None if last else text, len(words), [{"start": a, "end": b} for a, b in merged], sorted(listed))]

        return scan

    return map_rows(found, ["doc_id", "text", "n_words", "hits", "items"], start,
                    f"doc_id long, text string, n_words long, hits {HITS}, items array<long>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and checksums per document of what ``search`` found."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents of which no word lies in a benchmark window, decided by each row's own text whatever its id.

    Rows are told apart by a hash of id and text, so only rows that are equal in both go together.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))  # the table's own columns may have any names
    found = search(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), items)
    flagged = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(flagged, "key", "left_anti").select("row.*")
