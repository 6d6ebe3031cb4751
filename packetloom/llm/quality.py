"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are shape measures of the line itself and of its two
neighbours; transition weights tie neighbouring labels. Marginals come from forward-backward, their
mean weighted by line length is the document's raw quality, and a logistic curve calibrates it.
Lines of a labelled document take its label in training, which runs on a bounded sample.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import map_rows

SHAPES = 22
FEATURES = 3 * SHAPES + 3
MAX_TRAIN_DOCS, MAX_TRAIN_LINES = 6_000, 64


def held_out(id_col: str, divisor: int, remainder: int) -> Column:
    """Is crc32 of the id as text congruent to the remainder? A null id is in neither part (false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def line_shapes(lines: list[bytes]) -> np.ndarray:
    """One row of shape measures per line (UTF-8 bytes)."""
    lower = bytes(range(97, 123)) + bytes(range(128, 256))
    upper, digits = bytes(range(65, 91)), b"0123456789"
    marks = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-")
    seen = Counter(lines)
    rows = np.zeros((len(lines), SHAPES), np.float32)
    for row, line in zip(rows, lines):
        n = len(line)
        if not n:
            row[0] = 1
            continue
        words = line.split()
        count = max(1, len(words))
        up, low = n - len(line.translate(None, upper)), n - len(line.translate(None, lower))
        sign = n - len(line.translate(None, marks))
        low_words = line.lower().split()
        distinct = len(set(low_words))
        pairs = len(set(zip(low_words, low_words[1:])))
        full = line.count(b".")
        row[1:] = (np.log1p(n), np.log1p(count), up / n, low / n, (n - len(line.translate(None, digits))) / n, sign / n, sign / count, n / count / 10,
                   distinct / count, pairs / count, full / count, line.count(b",") / count, line.count(b"|") / count,
                   line.count(b"!") / count, line.endswith((b".", b"!", b"?")), line[:1].isupper(), up / (up + low + 1) > 0.5,
                   seen[line] > 1, np.log1p(full), sum(len(w) <= 3 for w in words) / count, sum(len(w) > 12 for w in words) / count)
    return rows


def with_neighbours(shapes: np.ndarray) -> np.ndarray:
    """Own, previous and next shapes, with flags for the two ends and a constant."""
    n = len(shapes)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :SHAPES] = shapes
    out[1:, SHAPES:2 * SHAPES] = shapes[:-1]
    out[:-1, 2 * SHAPES:3 * SHAPES] = shapes[1:]
    out[0, -3], out[-1, -2], out[:, -1] = 1, 1, 1
    return out


def text_lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


@dataclass
class Model:
    """Weights of the label "good" against "bad", transition scores, and the calibration curve."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray  # [from, to]
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def empty(cls) -> "Model":
        return cls(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)))

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability of "good" for every line."""
        emit = np.zeros((1, len(features), 2))
        emit[0, :, 1] = ((features - self.centre) / self.scale) @ self.weights
        return forward_backward(emit, self.moves, np.array([len(features)]))[0][0, :, 1]

    def raw(self, lines: list[bytes]) -> float:
        size = np.array([len(line) for line in lines], float) + 1
        return float(size @ self.marginals(with_neighbours(line_shapes(lines))) / size.sum())

    def score(self, text: str | None) -> float:
        return calibrated(self.raw(text_lines(text)), self.slope, self.offset)


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def calibrated(p, slope, offset):
    return 1 / (1 + np.exp(-np.clip(slope * logit(p) + offset, -30, 30)))


def forward_backward(emit: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals [docs, lines, 2] and expected transition counts [docs, 2, 2] of padded chains."""
    docs, n, _ = emit.shape
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    forward[:, 0] = emit[:, 0]
    for t in range(1, n):
        forward[:, t] = emit[:, t] + np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1])
    for t in range(n - 2, -1, -1):
        ahead = backward[:, t + 1] + emit[:, t + 1]
        step = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
        backward[:, t] = np.where((t + 1 < lengths)[:, None], step, 0.0)
    both = forward + backward
    total = np.logaddexp(both[:, :, 0], both[:, :, 1])
    node = np.exp(both - total[:, :, None])
    edges = np.zeros((docs, 2, 2))
    if n > 1:
        pair = forward[:, :-1, :, None] + moves[None, None] + (emit + backward)[:, 1:, None, :] - total[:, :1, None, None]
        real = (np.arange(1, n)[None] < lengths[:, None])[:, :, None, None]
        edges = np.where(real, np.exp(np.minimum(pair, 0)), 0).sum(axis=1)
    return node, edges


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Maximum likelihood with adaptive steps. Examples: (line shapes, line sizes, label)."""
    if len({label for _, _, label in examples}) < 2:
        return Model.empty()
    chains = [with_neighbours(shapes) for shapes, _, _ in examples]
    stacked = np.concatenate(chains)
    centre, scale = stacked.mean(axis=0), stacked.std(axis=0) + 1e-3
    centre[-1], scale[-1] = 0, 1
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    groups = []
    for part in np.array_split(np.array(order), max(1, min(12, len(order) // 50))):
        lengths = np.array([len(chains[i]) for i in part])
        x = np.zeros((len(part), lengths.max(), FEATURES))
        for row, i in enumerate(part):
            x[row, :lengths[row]] = (chains[i] - centre) / scale
        groups.append((x, lengths, np.array([examples[i][2] for i in part]), np.arange(lengths.max())[None] < lengths[:, None]))
    weights, moves = np.zeros(FEATURES), np.zeros((2, 2))
    m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, rounds + 1):
        gradient, gradient_moves = decay * weights * len(chains), decay * moves * len(chains)
        for x, lengths, labels, real in groups:
            emit = np.zeros((*x.shape[:2], 2))
            emit[:, :, 1] = x @ weights
            node, edges = forward_backward(emit, moves, lengths)
            share = 1 / lengths  # every document weighs the same
            gradient = gradient + np.einsum("dtf,dt->f", x, np.where(real, node[:, :, 1] - labels[:, None], 0) * share[:, None])
            own = np.zeros((len(labels), 2, 2))
            own[np.arange(len(labels)), labels, labels] = lengths - 1
            gradient_moves = gradient_moves + ((edges - own) * share[:, None, None]).sum(axis=0)
        g = np.concatenate([gradient, gradient_moves.ravel()]) / len(chains)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        weights, moves = weights - move[:FEATURES], moves - move[FEATURES:].reshape(2, 2)
    model = Model(centre, scale, weights, moves)
    raw = np.array([float((s + 1) @ model.marginals(c) / (s + 1).sum()) for c, (_, s, _) in zip(chains, examples)])
    model.slope, model.offset = fit_curve(logit(raw), np.array([e[2] for e in examples], float))
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Logistic curve through (x, y) by Newton steps."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        beta = beta - np.linalg.solve(hessian, design.T @ (p - y) + ridge * (beta - np.array([1.0, 0.0])))
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES) -> Model:
    """Model from at most ``max_docs`` labelled documents outside the held-out part, of at most ``max_lines`` lines.

    The sample is the first by a hash of the id, so it does not depend on the storage order.
    """
    own = labels.filter(~held_out("doc_id", 3, 1) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    def start():
        def shapes(text, quality):
            lines = text_lines(text)
            if len(lines) > max_lines:
                return []
            return [(line_shapes(lines).astype("<f4").tobytes(), np.array([len(x) for x in lines], "<i8").tobytes(), quality)]

        return shapes

    found = map_rows(rows, ["text", "quality"], start, "shapes binary, sizes binary, quality int").collect()
    found = sorted((bytes(r["shapes"]), bytes(r["sizes"]), r["quality"]) for r in found)
    return train([(np.frombuffer(a, "<f4").reshape(-1, SHAPES), np.frombuffer(b, "<i8").astype(float), q) for a, b, q in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` of every row; null and empty texts are one empty line, repeated rows score alike."""

    def start():
        return lambda key, text: [(key, model.score(text))]

    return map_rows(docs, ["doc_id", "text"], start, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose own text scores at least one half, columns unchanged."""
    model = fit(docs, labels)
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [model.score(t.as_py()) >= 0.5 for t in batch.column(names.index("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
