"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins; the model is one lookup table for each feature and one for
each chosen pair of features, plus an intercept. Tables are learned by cyclic boosting: in turn each
feature gets a shallow tree on the gradients of its bins, shrunk and added to its table; then the
pairs that explain most of what is left are boosted in the same way. A score is the logistic of the
sum of table entries, looked up for a whole batch at once.

Learned from at most ``SAMPLE`` labelled documents, chosen by the md5 of their id; features are taken
from the text alone. Everything else covers all documents and whole texts.

Defined cases: null and empty texts are scored like any other (all counts 0); labels that are null
don't count, and of repeated labels of a document the smallest does; without labelled rows of both
kinds the score is the share of label 1 among them, or 0.5; null ids are returned as null and count
as the empty string for the split; extra columns aren't carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import documents, id_remainder

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 10, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15
RIDGE = 2.0
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "log_lines", "repeated_lines", "line_bytes", "upper", "digits",
    "white", "stops", "symbols", "bangs", "bars", "high_bytes", "brackets", "words_with_symbols", "upper_words", "one_byte_words",
)


def _class(chars: str) -> np.ndarray:
    return np.array([b for b in chars.encode()])


_UPPER, _DIGIT, _WHITE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(" \t\n\r\v\f")
_STOPS, _SYMBOLS, _BRACKETS = _class(".,;:?'\""), _class("#$%&*@^~+=_\\/`"), _class("()[]{}<>")


def features(text: str) -> list[float]:
    """The FEATURES of a whole text."""
    raw = text.encode()
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    filled = [x for x in lines if x]
    symbols = int(count[_SYMBOLS].sum())
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / w, len(set(words)) / w, math.log1p(len(lines)),
        1 - len(set(filled)) / len(filled) if filled else 0.0, len(raw) / len(lines), count[_UPPER].sum() / n, count[_DIGIT].sum() / n,
        count[_WHITE].sum() / n, count[_STOPS].sum() / n, symbols / n, count[33] / n, count[124] / n, count[128:].sum() / n, count[_BRACKETS].sum() / n,
        sum([not x.isalnum() for x in words]) / w, sum([x.isupper() for x in words]) / w, sum([len(x) == 1 for x in words]) / w,
    ]


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Bin edges and tables: all that scoring needs, a few hundred kilobytes at most."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for j, k, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[j], x[:, j], "right"), np.searchsorted(self.pair_edges[k], x[:, k], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> tuple[np.ndarray, float]:
    """Leaf values for each cell of a grid of gradient and curvature sums, and the gain; splits run along any axis."""
    value, best = np.full(g.shape, g.sum() / (h.sum() + RIDGE)), None
    if depth:
        for axis in range(g.ndim):
            rest = tuple(a for a in range(g.ndim) if a != axis)
            left_g, left_h = np.cumsum(g.sum(axis=rest))[:-1], np.cumsum(h.sum(axis=rest))[:-1]
            if not len(left_g):
                continue
            gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
            at = int(gains.argmax())
            if best is None or gains[at] > best[0]:
                best = gains[at], axis, at + 1
    if best is None or best[0] <= _gain(g.sum(), h.sum()) + 1e-9:
        return value, float(_gain(g.sum(), h.sum()))
    _, axis, at = best
    (a_g, b_g), (a_h, b_h) = np.split(g, [at], axis), np.split(h, [at], axis)
    (a, gain_a), (b, gain_b) = _tree(a_g, a_h, depth - 1), _tree(b_g, b_h, depth - 1)
    return np.concatenate([a, b], axis), gain_a + gain_b


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single features, then of the pairs with the largest gains."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = math.log(share / (1 - share))
    edges = [_cut(x[:, j], BINS) if len(x) else np.empty(0) for j in range(len(FEATURES))]
    coarse = [_cut(x[:, j], PAIR_BINS) if len(x) else np.empty(0) for j in range(len(FEATURES))]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not 0 < y.sum() < len(y):
        return Model(base if len(y) else 0.0, edges, tables, coarse, [])
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    total = np.full(len(y), base)

    def sums(cells: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        size = math.prod(shape)
        return np.bincount(cells, y - p, size).reshape(shape), np.bincount(cells, p * (1 - p), size).reshape(shape)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            step = RATE * _tree(*sums(binned[j], table.shape), 2)[0]
            table += step
            total += step[binned[j]]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    shapes = {(j, k): (len(coarse[j]) + 1, len(coarse[k]) + 1) for j in range(len(FEATURES)) for k in range(j)}
    cells = {jk: rough[jk[0]] * s[1] + rough[jk[1]] for jk, s in shapes.items()}
    chosen = sorted(shapes, key=lambda jk: -_tree(*sums(cells[jk], shapes[jk]), 2)[1])[:PAIRS]
    pairs = [(j, k, np.zeros(shapes[j, k])) for j, k in chosen]
    for _ in range(PAIR_ROUNDS):
        for j, k, table in pairs:
            step = RATE * _tree(*sums(cells[j, k], table.shape), 2)[0]
            table += step
            total += step.ravel()[cells[j, k]]
    return Model(base, edges, tables, coarse, pairs)


def train(df: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from labelled documents whose id's crc32 modulo 3 isn't 1, ``sample`` of them at most."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    known = known.filter(id_remainder(F.col("doc_id"), 3) != 1)
    known = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # At most ``sample`` ids are broadcast, and as many rows of numbers come to the driver.
    rows = documents(df).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x array<double>")
    got = rows.orderBy("doc_id", "x").limit(2 * sample).toPandas()
    return fit(np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES)), (got["y"].to_numpy() == 1).astype(np.float64))


def score_documents(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(feature_matrix([t.as_py() for t in batch.column(1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = documents(df).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def keep_good(df: DataFrame, model: Model) -> DataFrame:
    """The rows of ``df``, all columns, that the model doesn't reject (score of 0.5 or more)."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(feature_matrix([t.as_py() or "" for t in batch.column(at)])) >= 0.5))

    return df.mapInArrow(run, df.schema)
