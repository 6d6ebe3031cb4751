"""Ranked lexical search over whole documents by pipelined term partitioning.

Documents are dealt into shards of at most ``SHARD`` rows, and each shard's postings of benchmark
terms are split among owners by weight class, rarest terms first. A shard's bundle holds, per
item, a sparse accumulator (document, score so far). It visits the owners one after another,
each visit a cogroup of bundle and postings, and gains the integer contributions of that owner's
terms. Terms that every document holds are thus spread over all shards, and no task sees more than one shard.

Bundles stay small without losing a result. For each item an owner knows the most that all later owners
can still add; documents that cannot reach the shard's tenth score any more leave the
bundle, and where even the owner's own terms and all later ones together cannot, no new document
enters it. The last owner keeps each shard's best documents, from which the final selection is made.

Only terms behind a filter of ``FILTER_BITS`` bits, made of the items' terms, get postings; its false
positives meet no item. Items travel to the tasks in blocks of at most ``max_pairs`` (item, term) pairs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import arrow_schema, map_rows, saved, to_batch
from packetloom.llm.decontamination import word_table
from packetloom.operators.ordering import first_n

SHARD, SHARD_TERMS = 4096, 4_000_000
FILTER_BITS = 1 << 24  # 2 MB, the only thing that grows with the benchmark until it is full
CLASSES = (256, 32, 4)  # an owner's terms are in at most every 256th, 32nd, 4th document; the last owner has the rest
POSTINGS = "shard long, term string, docs binary, tfs binary, ids binary, n binary, df long, total long, most long, shortest long"
BUNDLE = "shard long, item int, docs binary, scores binary, least long"
RESULT = "item_id long, rank int, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``item_id``, ``term``; rows of equal id are one item."""

    def start():
        table = word_table()
        return lambda key, text: [(key, w.decode()) for w in set((text or "").encode().translate(table).split())]

    return map_rows(items, ["item_id", "text"], start, "item_id long, term string").distinct()


def term_filter(terms: DataFrame) -> bytes:
    """Bitmap of the terms' hashes: at most 512 rows of 4 KB reach the driver."""
    spot = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS)) + 1
    parts = terms.groupBy(F.bitmap_bucket_number(spot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for row in parts.collect():
        bits[(row["part"] - 1) * 4096:row["part"] * 4096] = row["bits"]
    return bytes(bits)


def index(docs: DataFrame, bits: bytes, shard_rows: int = SHARD) -> DataFrame:
    """Postings per (shard, term), and one row without a term per shard: ids in order, lengths, count and sum of lengths."""
    shared, arrow = docs.sparkSession.sparkContext.broadcast(bits), arrow_schema(POSTINGS)

    def flush(shard: int, rows: list) -> list[tuple]:
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0))  # so that places inside a shard follow the ids
        n = np.array([r[1] for r in rows], "<i8")
        found: dict[bytes, list] = {}
        for at, (_, _, counts) in enumerate(rows):
            for term, tf in counts:
                found.setdefault(term, []).append((at, tf))
        ids = np.array([r[0] for r in rows if r[0] is not None], "<i8")  # rows without an id come last
        out = [(shard, None, None, None, ids.tobytes(), n.tobytes(), len(rows), int(n.sum()), None, None)]
        for term, pairs in found.items():
            at, tf = np.array(pairs).T
            out.append((shard, term.decode(), at.astype("<u2").tobytes(), tf.astype("<u4").tobytes(), None, None, len(at), None, int(tf.max()), int(n[at].min())))
        return out

    def run(batches):
        bitmap, table, digest = shared.value, word_table(), xxhash.xxh64_intdigest
        known: dict[bytes, bool] = {}
        shard, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().translate(table).split()
                if not words:
                    continue
                counts = []
                for word, tf in Counter(words).items():
                    wanted = known.get(word)
                    if wanted is None:
                        if len(known) > 500_000:
                            known.clear()  # a memory of answers only
                        spot = digest(word, 42) & (FILTER_BITS - 1)
                        wanted = known[word] = bool(bitmap[spot >> 3] >> (spot & 7) & 1)
                    if wanted:
                        counts.append((word, tf))
                rows.append((key, len(words), counts))
                size += len(counts)
                if len(rows) >= shard_rows or size >= SHARD_TERMS:
                    yield to_batch(flush(shard, rows), arrow)
                    shard, rows, size = shard + 1, [], 0
        if rows:
            yield to_batch(flush(shard, rows), arrow)

    return saved(docs.select("doc_id", "text").mapInArrow(run, POSTINGS), "postings")


def weights(postings: DataFrame, terms: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``item_id``, ``term``, weight ``w``, ``top`` (most that one document can gain from it), ``owner``."""
    per_term = postings.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("shortest").alias("shortest"))
    w = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = F.lit(len(CLASSES))
    for place, share in reversed(list(enumerate(CLASSES))):
        owner = F.when(F.col("df") * share <= n_docs, place).otherwise(owner)
    weighed = per_term.select("term", w.alias("w"), owner.alias("owner"), "most", F.expr(f"10 + (90 * shortest * {n_docs}L) div {n_terms}L").alias("m"))
    weighed = weighed.filter("w > 0").withColumn("top", F.expr("w * ((1000000000 * most) div (1000 * most + 8 * m))"))
    return terms.join(weighed, "term").select("item_id", "term", "w", "top", "owner")


class Block:
    """The items of one block: per owner their terms, and per item the most that an owner and all after it can add."""

    def __init__(self, rows: list):
        names = sorted({r["item_id"] for r in rows}, key=lambda i: (i is None, i or 0))
        number = {name: i for i, name in enumerate(names)}
        self.items = names
        self.terms: list[list[list[tuple[str, int]]]] = [[[] for _ in names] for _ in range(len(CLASSES) + 1)]
        self.rest = np.zeros((len(CLASSES) + 2, len(names)), np.int64)
        for r in rows:
            i = number[r["item_id"]]
            self.terms[r["owner"]][i].append((r["term"], r["w"]))
            self.rest[:r["owner"] + 1, i] += r["top"]


def visit(block: Block, owner: int, k: int, n_docs: int, n_terms: int, bundle: pd.DataFrame, postings: pd.DataFrame) -> list[tuple]:
    """The bundle of a shard after one owner: (item, documents, scores, least score that counts)."""
    heads = postings["term"].isna()
    n = np.frombuffer(postings.loc[heads, "n"].iloc[0], "<i8")
    m = 10 + (90 * n * n_docs) // n_terms
    held = {}
    for term, docs, tfs in postings.loc[~heads, ["term", "docs", "tfs"]].itertuples(index=False):
        at, tf = np.frombuffer(docs, "<u2"), np.frombuffer(tfs, "<u4").astype(np.int64)
        held[term] = at, (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
    carried = {item: (np.frombuffer(docs, "<u2"), np.frombuffer(scores, "<i8"), least)
               for item, docs, scores, least in bundle[["item", "docs", "scores", "least"]].itertuples(index=False)}
    out = []
    for item, terms in enumerate(block.terms[owner]):
        docs, scores, least = carried.get(item, (None, None, 0))
        gains = [(held[t], w) for t, w in terms if t in held]
        if docs is None and not gains:
            continue
        total = np.zeros(len(n), np.int64)
        if docs is not None:
            total[docs] = scores
        for (at, gain), w in gains:
            total[at] += w * gain
        at = docs if docs is not None and block.rest[owner, item] < least else np.flatnonzero(total)
        scores = total[at]
        if len(at) >= k:
            least = max(least, int(np.partition(scores, len(at) - k)[len(at) - k]))
        stay = scores + block.rest[owner + 1, item] >= max(least, 1)
        at, scores = at[stay], scores[stay]
        if owner == len(CLASSES):  # places follow the ids, so a stable sort settles ties
            first = np.argsort(-scores, kind="stable")[:k]
            at, scores = at[first], scores[first]
        out.append((item, at.astype("<u2"), scores, least))
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, max_pairs: int = 1_000_000, shard_rows: int = SHARD) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each item, ties to the smaller doc_id.

    Null texts have no terms. Every document row counts and is ranked, also under a repeated id; a null
    doc_id comes after all others in a tie. Benchmark rows of equal item_id (null too) are one item with the
    terms of all its rows. No terms, no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    terms = saved(item_terms(items), "terms")
    postings = index(docs, term_filter(terms), shard_rows)
    n_docs, n_terms = postings.filter("term is null").agg(F.sum("df"), F.sum("total")).first()
    empty = spark.createDataFrame([], RESULT)
    if not n_docs:
        return empty
    weighed = saved(weights(postings, terms, n_docs, n_terms), "weights")
    blocks = -(-weighed.count() // max_pairs)
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))
    found = [_pipeline(postings, weighed.filter(dealt == b), k, n_docs, n_terms) for b in range(blocks)]
    if not found:
        return empty
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = first_n(best, ["item_id"], order, k, F.xxhash64("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.select("item_id", "rank", "doc_id", "score")


def _pipeline(postings: DataFrame, weighed: DataFrame, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """``item_id``, ``doc_id``, ``score``: every shard's ``k`` best documents for the items of one block."""
    spark = postings.sparkSession
    block = spark.sparkContext.broadcast(Block(weighed.collect()))  # at most max_pairs rows, but for one larger item
    owners = F.broadcast(weighed.select("term", "owner").distinct())  # no more rows than the block has
    columns = ["shard", "term", "docs", "tfs", "n", "ids"]
    owned = postings.filter("term is not null").join(owners, "term").select(*columns, "owner")
    heads = postings.filter("term is null").select(*columns)
    bundles = spark.createDataFrame([], BUNDLE)
    last = len(CLASSES)

    def at(owner: int):
        def stage(key, bundle, held):
            rows = visit(block.value, owner, k, n_docs, n_terms, bundle, held)
            if owner < last:
                return pd.DataFrame([(key[0], item, at.tobytes(), s.tobytes(), least) for item, at, s, least in rows], columns=["shard", "item", "docs", "scores", "least"])
            ids = np.frombuffer(held.loc[held["term"].isna(), "ids"].iloc[0], "<i8").tolist()
            flat = [(block.value.items[item], ids[a] if a < len(ids) else None, score) for item, at, s, _ in rows for a, score in zip(at.tolist(), s.tolist())]
            return pd.DataFrame({c: pd.array([r[j] for r in flat], "Int64") for j, c in enumerate(("item_id", "doc_id", "score"))})

        return stage

    for owner in range(last + 1):
        here = owned.filter(F.col("owner") == owner).select(*columns).unionByName(heads.withColumn("ids", F.col("ids") if owner == last else F.lit(None).cast("binary")))
        bundles = bundles.groupBy("shard").cogroup(here.groupBy("shard")).applyInPandas(at(owner), BUNDLE if owner < last else "item_id long, doc_id long, score long")
    return bundles
