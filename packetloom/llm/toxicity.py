"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The vocabulary is every word of the labelled examples; document frequencies are counted over all
documents. Words of few examples have posting lists, which a query adds up in full. Words of many
examples are rows of a table; examples lie in blocks of 64, and the largest weight of such a word in
each block, or the length of what an example holds of such words, bounds what they can add. Only
examples whose bound reaches the k-th best similarity are completed. Similarity-weighted votes are
calibrated by a logistic curve.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import arrow_schema, map_rows, saved
from packetloom.llm.decontamination import word_table
from packetloom.llm.quality import held_out

BLOCK, NEIGHBOURS = 64, 20
MAX_PER_CLASS = 2_000
COMMON = 16  # a word in over a 16th of the examples is a table row


def counts(text: str | None, terms: dict[bytes, int], table: bytes) -> Counter:
    """Occurrences of vocabulary terms in a whole text."""
    found = map(terms.get, (text or "").encode().translate(table).split())
    return Counter(t for t in found if t is not None)


@dataclass
class Postings:
    """Examples and weights of each term: those of term t lie from ``start[t]`` to ``start[t + 1]``."""

    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, term: np.ndarray, example: np.ndarray, weight: np.ndarray, terms: int) -> "Postings":
        order = np.lexsort((example, term))
        start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))]).astype(np.int64)
        return cls(start, example[order].astype(np.int32), weight[order].astype(np.float32))

    def of_terms(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of these terms, and how many each has."""
        low = self.start[terms]
        n = self.start[terms + 1] - low
        return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()), n


@dataclass
class Index:
    terms: dict[bytes, int]
    idf: np.ndarray
    weights: Postings | np.ndarray  # of examples of unit length; an array is [terms, examples]
    ids: np.ndarray
    labels: np.ndarray  # padded to whole blocks
    curve: np.ndarray  # constant, vote, best similarity
    prior: float

    def __post_init__(self):
        if not isinstance(self.weights, Postings):
            term, example = np.nonzero(self.weights)
            self.weights = Postings.of(term, example, self.weights[term, example], len(self.weights))
        size, held = len(self.labels), self.weights
        many = np.flatnonzero(np.diff(held.start) > max(BLOCK, size // COMMON))
        self.row = np.full(len(held.start) - 1, -1, np.int32)  # of the terms that are table rows
        self.row[many] = np.arange(len(many))
        self.table = np.zeros((size // BLOCK, len(many), BLOCK), np.float32)
        at, n = held.of_terms(many)
        self.table[held.example[at] // BLOCK, np.repeat(np.arange(len(many)), n), held.example[at] % BLOCK] = held.weight[at]
        self.bounds = self.table.max(axis=2).T.copy()
        self.lengths = np.sqrt(np.einsum("ijk,ijk->ik", self.table, self.table)).max(axis=1, initial=0)

    def vector(self, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(found.keys(), int, len(found))
        n = np.fromiter(found.values(), float, len(found))
        order = np.argsort(terms)
        terms = terms[order]
        weight = (1 + np.log(n[order])) * self.idf[terms]
        length = np.linalg.norm(weight)
        return terms, weight / length if length else weight

    def nearest(self, found: Counter, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the best ``k`` examples with a positive cosine, best first, ties to the earlier position."""
        terms, weight = self.vector(found)
        size = len(self.labels)
        if not len(terms) or not size:
            return np.zeros(0, int), np.zeros(0)
        row = self.row[terms]
        few, many = row < 0, row >= 0
        at, n = self.weights.of_terms(terms[few])
        sims = np.bincount(self.weights.example[at], self.weights.weight[at] * np.repeat(weight[few], n), size).reshape(-1, BLOCK)
        rows, rest = row[many], weight[many].astype(np.float32)
        # einsum, since a task has one core and products of matrices start a thread on each
        most = np.minimum(np.einsum("r,rb->b", rest, self.bounds[rows]), np.sqrt(np.einsum("r,r->", rest, rest)) * self.lengths)
        bound = sims.max(axis=1) + most + 1e-6  # room for rounding
        order = np.argsort(-bound, kind="stable")
        limits = bound[order].tolist()
        places, best_sims, worst, opened = np.zeros(0, int), np.zeros(0), 0.0, 0
        while opened < len(order) and limits[opened] > worst:
            blocks = order[opened:opened + 8]
            opened += len(blocks)
            sim = (sims[blocks] + np.einsum("r,brk->bk", rest, self.table[blocks[:, None], rows])).ravel()
            columns = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            good = (sim >= worst) & (sim > 1e-12) & (columns != skip)
            places, best_sims = np.concatenate([places, columns[good]]), np.concatenate([best_sims, sim[good]])
            if len(places) > k:
                best = np.lexsort((places, -best_sims))[:k]
                places, best_sims = places[best], best_sims[best]
                worst = best_sims[-1]
        best = np.lexsort((places, -best_sims))
        return places[best], best_sims[best]

    def signals(self, places: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Constant, smoothed distance-weighted vote as log odds, and best similarity."""
        if not len(places):
            return np.array([1.0, 0.0, 0.0])
        weight = sims ** 2
        for_it = weight @ self.labels[places]
        vote = (for_it + 0.5 * self.prior) / (weight.sum() + 0.5)
        return np.array([1.0, np.log(vote / (1 - vote)) - np.log(self.prior / (1 - self.prior)), sims[0]])

    def score(self, places: np.ndarray, sims: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.signals(places, sims) @ self.curve, -30, 30))))


def calibrate(index: Index, found: list[Counter], share: float) -> None:
    """Logistic curve through leave-one-out votes; classes weigh as in the labelled population."""
    y = index.labels[:len(found)]
    x = np.array([index.signals(*index.nearest(c, skip=i)) for i, c in enumerate(found)])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    beta = np.array([np.log(share / (1 - share)), 1.0, 0.0])
    prior = beta.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.eye(3)
        beta = beta - np.linalg.solve(hessian, x.T @ (weight * (p - y)) + (beta - prior))
    index.curve = beta


def constant(sizes: dict[int, int]) -> Index:
    """No vocabulary: every text gets the share of toxic labels (one half without labels)."""
    rate = min(max(sizes.get(1, 0) / max(1, sum(sizes.values())), 0.01), 0.99) if sizes else 0.5
    return Index({}, np.zeros(0), np.zeros((0, 0), np.float32), np.zeros(0, int), np.zeros(0), np.array([np.log(rate / (1 - rate)), 0, 0]), rate)


def document_counts(docs: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """In how many documents each term is; a task counts its own documents and hands on one row per term."""
    arrow = arrow_schema("term int, n long")
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        table, held = word_table(), shared.value
        seen = np.zeros(len(held), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = map(held.get, set((text or "").encode().translate(table).split()))
                seen[[t for t in found if t is not None]] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], schema=arrow)

    counted = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms))
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return df


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Index:
    """Index of at most ``max_per_class`` labelled examples per class outside the held-out part, first by a hash of the id.

    Terms: all words of the examples. Class shares and document frequencies cover all labelled rows and all documents.
    """
    own = labels.filter(~held_out("doc_id", 5, 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    total = docs.count()
    if len(sizes) < 2 or not total:
        return constant(sizes)
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = None
    for label in (0, 1):
        part = own.filter(F.col("toxic") == label).distinct().orderBy(*order).limit(max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = saved(docs.select("doc_id", "text").join(chosen, "doc_id"), "examples")

    def start_words():
        table = word_table()

        def found(key, toxic, text):
            mine = Counter((text or "").encode().translate(table).split())
            return [(key, toxic, [w.decode() for w in mine], list(mine.values()))]

        return found

    rows = map_rows(sample, ["doc_id", "toxic", "text"], start_words, "doc_id long, toxic int, words array<string>, n array<int>").toArrow().combine_chunks()
    if not rows.num_rows or not sum(len(c.flatten()) for c in rows["words"].chunks):
        return constant(sizes)
    words, n = (pa.concat_arrays([c.flatten() for c in rows[name].chunks]) for name in ("words", "n"))
    vocabulary = pc.sort_indices(words.unique())
    vocabulary = words.unique().take(vocabulary)
    terms = {w.encode(): i for i, w in enumerate(vocabulary.to_pylist())}
    idf = np.log((1 + total) / (1 + document_counts(docs, terms))) + 1
    term, n = pc.index_in(words, vocabulary).to_numpy(), n.to_numpy()
    ends = np.cumsum(pc.list_value_length(rows["words"]).to_numpy())
    keys, toxic = rows["doc_id"].to_pylist(), rows["toxic"].to_pylist()
    found = [dict(zip(term[a:b].tolist(), n[a:b].tolist())) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    top = [max(((1 + np.log(c)) * idf[t], t) for t, c in mine.items())[1] if mine else -1 for mine in found]
    alike = sorted(range(len(found)), key=lambda i: (top[i], keys[i], toxic[i], sorted(found[i].items())))  # alike examples share a block
    found = [Counter(found[i]) for i in alike]
    share = sizes[1] / (sizes[0] + sizes[1])
    classes = Counter(toxic)
    n1, n0 = max(1, classes[1]), max(1, classes[0])
    labels_of = np.zeros(-(-len(found) // BLOCK) * BLOCK)
    labels_of[:len(found)] = [toxic[i] for i in alike]
    index = Index(terms, idf, np.zeros((len(terms), 0), np.float32), np.array([keys[i] for i in alike], np.int64), labels_of, np.zeros(3), n1 / (n0 + n1))
    vectors = [index.vector(c) for c in found]
    index.weights = Postings.of(np.concatenate([t for t, _ in vectors]), np.repeat(np.arange(len(found)), [len(t) for t, _ in vectors]),
                                np.concatenate([w for _, w in vectors]), len(terms))
    index.__post_init__()
    calibrate(index, found, share)
    # texts without a word of the examples vote by their own rate, which the curve's constant stands for
    without = Counter(toxic[i] for i, c in zip(alike, found) if not c)
    rate = share * (without[1] + 0.5) / (n1 + 1) / (share * (without[1] + 0.5) / (n1 + 1) + (1 - share) * (without[0] + 0.5) / (n0 + 1))
    index.blank = float(rate)
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """``doc_id``, ``score``, ``evidence`` (nearest labelled ids with cosine and label) of every row.

    Cosines are over the words that any example has. A text without such a word (null and empty texts too) has no
    neighbours and gets the rate of such texts. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    blank = getattr(index, "blank", None)

    def start():
        table, held = word_table(), shared.value

        def one(key, text):
            places, sims = held.nearest(counts(text, held.terms, table))
            value = blank if blank is not None and not len(places) else held.score(places, sims)
            evidence = ",".join(f"{held.ids[p]}:{s:.4f}:{int(held.labels[p])}" for p, s in zip(places[:3].tolist(), sims[:3].tolist()))
            return [(key, float(value), evidence)]

        return one

    return map_rows(docs, ["doc_id", "text"], start, "doc_id long, score double, evidence string")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``evidence``."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
