"""Near duplicates by SimHash with anchor-point covering.

A 64-bit fingerprint is compared on 46 of its bits, as two words of 23 bits. The binary Golay code
of length 23 is perfect: every word lies within three bits of exactly one codeword, so a pair of
codewords, the *home anchor*, covers every fingerprint. Two fingerprints that differ in at most
two bits differ by e1 + e2 <= 2 in the two words; the second is therefore within 3 + e1 and
3 + e2 bits of the first one's home. Replicating each fingerprint to all those anchors (61 on
average) and joining replicas to homes finds every linked pair. Equal fingerprints are one class
before any of this, and a class has at most 2,080 partners, whatever the size of a group of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import map_rows, saved
from packetloom.llm.components import components
from packetloom.llm.near_copies import groups

GOLAY_GENERATOR = 0b101011100011  # fixed value: generator polynomial of the [23, 12] code
WORD, RADIUS, MAX_DISTANCE = 23, 3, 2


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fingerprint`` (signed long): a bit is 1 where over half of the shingle hashes have it.

    Words are ASCII-lower-cased runs between ASCII white space, shingles three words with repeats;
    fewer words make one shingle, none (or a null text) the fingerprint zero.
    """

    def start():
        digest = xxhash.xxh64_intdigest

        def fingerprint(key, text):
            words = (text or "").encode().lower().split()
            if not words:
                return [(key, 0)]
            n = max(1, len(words) - 2)
            ones, block = np.zeros(64, np.int64), 1 << 16
            for at in range(0, n, block):  # bounded memory for very long texts
                hashes = [digest(b" ".join(words[i:i + 3]), 42) for i in range(at, min(n, at + block))]
                bits = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return [(key, int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0]))]

        return fingerprint

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(named, ["id", "text"], start, "id long, fingerprint long")


def golay_tables() -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Syndrome of each word, coset leader of each syndrome, and per syndrome the codewords to add to a word's own
    codeword to reach the anchors at distance <= 3, 4 and 5 from the word (three shells)."""
    generator = np.uint32(GOLAY_GENERATOR)
    messages = np.arange(1 << 12, dtype=np.uint32)
    code = np.zeros(1 << 12, np.uint32)
    for bit in range(12):
        code ^= np.where(messages >> np.uint32(bit) & np.uint32(1), generator << np.uint32(bit), np.uint32(0)).astype(np.uint32)
    syndrome = np.arange(1 << WORD, dtype=np.uint32)
    for bit in range(WORD - 1, 10, -1):
        hit = (syndrome >> np.uint32(bit)) & np.uint32(1)
        syndrome ^= (hit * (generator << np.uint32(bit - 11))).astype(np.uint32)
    words = np.arange(1 << WORD, dtype=np.uint32)
    light = words[np.bitwise_count(words) <= RADIUS]
    leader = np.zeros(1 << 11, np.uint32)
    leader[syndrome[light]] = light
    shells = []
    for error in leader:
        away = np.bitwise_count(code ^ error).astype(int) - RADIUS
        shells.append([code[away <= 0], code[away == 1], code[away == 2]])
    return syndrome, leader, shells


def covering(fps: DataFrame) -> DataFrame:
    """``anchor``, ``fingerprint``, ``home`` for every anchor that must see a fingerprint."""

    def run(batches):
        syndrome, leader, shells = golay_tables()
        mask = (1 << WORD) - 1
        for batch in batches:
            anchors, owners, homes = [], [], []
            for value in batch.column(0).to_pylist():
                low, high = value & mask, (value >> WORD) & mask
                s1, s2 = int(syndrome[low]), int(syndrome[high])
                c1, c2 = low ^ int(leader[s1]), high ^ int(leader[s2])
                near1, near2 = shells[s1], shells[s2]
                found = [((near2[j].astype(np.int64) ^ c2)[:, None] << WORD | (near1[i].astype(np.int64) ^ c1)).ravel()
                         for i in range(MAX_DISTANCE + 1) for j in range(MAX_DISTANCE + 1 - i)]
                found = np.concatenate(found)
                anchors.append(found)
                owners.append(np.full(len(found), value, np.int64))
                homes.append(found == (c2 << WORD | c1))
                if len(anchors) >= 2000:
                    yield _rows(anchors, owners, homes)
                    anchors, owners, homes = [], [], []
            if anchors:
                yield _rows(anchors, owners, homes)

    return fps.select("fingerprint").mapInArrow(run, "anchor long, fingerprint long, home boolean")


def _rows(anchors, owners, homes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(np.concatenate(owners)),
                                       pa.array(np.concatenate(homes))], names=["anchor", "fingerprint", "home"])


def links(classes: DataFrame) -> DataFrame:
    """``a``, ``b``: pairs of distinct fingerprints (a < b) at most two bits apart, each once."""
    cover = covering(classes)
    replicas = cover.select("anchor", F.col("fingerprint").alias("b"))
    homes = cover.filter("home").select("anchor", F.col("fingerprint").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    return replicas.join(homes, (replicas["anchor"] == homes["anchor"]) & (F.col("a") < F.col("b")) & near).select("a", "b")


def rooted(prints: DataFrame) -> DataFrame:
    """``fingerprint``, ``root`` of every distinct fingerprint; linked ones share a root."""
    classes = prints.select("fingerprint").distinct()
    roots = components(links(classes)).withColumnRenamed("node", "fingerprint")
    return classes.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long), ``component_id`` (smallest doc_id reachable over links).

    Every input row returns once. Repeated ids are rows of their own; a null id belongs to its
    component but names it only where all ids are null (the name is then null).
    """
    prints = saved(fingerprints(docs), "fingerprints")
    least = prints.groupBy("fingerprint").agg(F.min("id").alias("least_id"))
    classes = least.join(rooted(prints), "fingerprint")
    named = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    answer = classes.join(named, "root").select("fingerprint", "component_id")
    return prints.join(answer, "fingerprint").select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def anchored(prints: DataFrame) -> DataFrame:
    """``a``, ``b``: ids whose fingerprints are equal or linked; each id with the least of its fingerprint, and the least ids of linked ones."""
    least = saved(prints.groupBy("fingerprint").agg(F.min("id").alias("a")), "least")
    equal = prints.join(least, "fingerprint").filter("id <> a").select("a", F.col("id").alias("b"))
    ends = [least.select(F.col("fingerprint").alias(f"fingerprint_{x}"), F.col("a").alias(x)) for x in "ab"]
    linked = links(least).select(F.col("a").alias("fingerprint_a"), F.col("b").alias("fingerprint_b"))
    return equal.unionByName(linked.join(ends[0], "fingerprint_a").join(ends[1], "fingerprint_b").select("a", "b"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of every group of near copies, columns unchanged: the smallest doc_id, null ids last, then the smallest row hash.

    Near copies have a Jaccard similarity of at least ``similarity`` between their sets of ``width``-word shingles. The anchors
    propose rows whose fingerprints are at most two bits apart, and these are compared on their shingles. That radius is far
    narrower than the bound, so rows still in different groups are proposed by bands of minima (see ``near_copies``).
    Only rows with equal id and text share a row hash; one of them stays.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns])  # the table's own columns may have any names
    rows = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), "doc_id", "text", whole.alias("row"))
    prints = saved(fingerprints(rows, "key").distinct(), "fingerprints")
    found = saved(groups(rows.select("key", "text"), "key", width, similarity, anchored(prints)), "groups")
    keyed = found.groupBy(F.col("id").alias("key"), "root").agg(F.count("*").alias("copies"))
    ids = rows.select("key", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "copies")
    first = keyed.join(ids, "key").groupBy("root").agg(F.min(order).alias("first"))
    kept = saved(first.select("first.key", "first.copies"), "kept")
    single = rows.join(kept.filter("copies = 1"), "key", "left_semi")
    repeated = rows.join(kept.filter("copies > 1"), "key", "left_semi").dropDuplicates(["key"])
    return single.unionByName(repeated).select("row.*")
