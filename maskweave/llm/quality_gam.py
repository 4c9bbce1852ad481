"""Quality classifier: a generalised additive model with pairwise interactions.

Per-feature lookup tables are learned by cyclic boosting: round after round, each
feature in turn gets one shallow tree (up to four leaves over its bins) fitted to the
gradient of the log loss, added with a small step.  Then the pairs whose residuals a
small tree explains best get tables over two features in the same way.  A document's
score is the sigmoid of the intercept plus one table entry per feature and per pair.

Labels are learned from at most ``MAX_ROWS`` labelled documents, those with the smallest
seeded hash; the features of every document come from its whole text.

Defined results: null and empty texts have zero features and get a score all the same;
a document with several labels counts with its smallest; null labels do not count;
without labels of both kinds every score is the share of label 1 (0.5 without labels);
repeated rows give repeated results; an empty table gives an empty one; further columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import IS_BLANK, flat_bytes, frugal, held_out, shingle_hashes, steps, word_hashes

MAX_ROWS = 20_000
BINS = 32
ROUNDS = 120
RATE = 0.15
PAIRS = 6
PAIR_BINS = 8
PAIR_ROUNDS = 40
FEATURES = (
    "log_bytes", "upper", "symbols", "digits", "word_bytes", "stops", "lines", "repeated_next", "distinct_words", "distinct_runs", "high_bytes",
)
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 symbol, 3 digit, 4 sentence mark, 5 line end, 6 beyond ASCII
_CLASS[65:91] = 1
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 2
_CLASS[48:58] = 3
_CLASS[[ord("."), ord(",")]] = 4
_CLASS[[10, 13]] = 5
_CLASS[128:] = 6


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    flat, offsets = flat_bytes(column)
    kinds = _CLASS[flat]

    def per_text(hit: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    size = np.diff(offsets).astype(float)
    solid = np.maximum(per_text(~IS_BLANK[flat], offsets), 1)
    upper, symbols, digits, stops, lines, high = (per_text(kinds == k, offsets) for k in range(1, 7))
    hashes, before = word_hashes(flat, offsets)
    words = np.diff(before).astype(float)
    n = np.maximum(words, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[before[:-1][np.diff(before) > 0]] = False
    distinct = [np.diff(shingle_hashes(hashes, before, k)[1]) for k in (1, 3)]
    return np.column_stack([
        np.log1p(size), upper / solid, symbols / solid, digits / solid, solid / n, stops / n, lines / n,
        per_text(same, before) / n, distinct[0] / n, distinct[1] / n, high / solid,
    ])


class Gam:
    """The fitted tables; ``score`` adds up table entries by bin."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        share = float(np.mean(y)) if len(y) else 0.5
        self.edges, self.tables, self.pairs = [], [], []
        self.constant = share if share in (0.0, 1.0) or not len(y) else None
        self.base = 0.0 if self.constant is not None else float(np.log(share / (1 - share)))
        if self.constant is None:
            self._fit(x, y.astype(float))

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        inner = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, inner)) for c in x.T]
        bins = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        margin = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for b, t in zip(bins, self.tables):
                p = 1 / (1 + np.exp(-margin))
                g = np.bincount(b, y - p, len(t))
                h = np.bincount(b, p * (1 - p), len(t))
                add = RATE * _tree(g, h)
                t += add
                margin += add[b]
        coarse = [b * PAIR_BINS // len(t) for b, t in zip(bins, self.tables)]
        p = 1 / (1 + np.exp(-margin))
        cells = lambda i, j, w: np.bincount(coarse[i] * PAIR_BINS + coarse[j], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
        gain = []
        for i in range(len(bins)):
            for j in range(i):
                g, h = cells(i, j, y - p), cells(i, j, p * (1 - p))
                gain.append((float((_tree2(g, h) * g).sum()), i, j))
        chosen = [(i, j) for _, i, j in sorted(gain, reverse=True)[:PAIRS]]
        self.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in chosen]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-margin))
                add = RATE * _tree2(cells(i, j, y - p), cells(i, j, p * (1 - p)))
                t += add
                margin += add[coarse[i], coarse[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        bins = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]
        margin = self.base + sum(t[b] for t, b in zip(self.tables, bins))
        coarse = [b * PAIR_BINS // len(t) for b, t in zip(bins, self.tables)]
        margin = margin + sum(t[coarse[i], coarse[j]] for i, j, t in self.pairs)
        return 1 / (1 + np.exp(-margin))


def _split(g: np.ndarray, h: np.ndarray) -> int:
    """Where to cut ordered bins in two for the largest gain; 0 if nowhere."""
    if len(g) < 2:
        return 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1)
    at = int(np.argmax(gain))
    return at + 1 if gain[at] > g.sum() ** 2 / (h.sum() + 1) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree over ordered bins, as one value per bin."""
    at = _split(g, h) if depth else 0
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree that cuts one feature and then the other inside each part, as a table."""
    at = _split(g.sum(1), h.sum(1))
    parts = [slice(0, at), slice(at, None)] if at else [slice(0, None)]
    out = np.empty_like(g)
    for rows in parts:
        out[rows] = _tree(g[rows].sum(0), h[rows].sum(0), 1)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """The model of at most ``max_rows`` labelled documents outside the held-out fifth."""
    marked = labels.select("doc_id", "quality").filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out())
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # bounded by max_rows, so it can be broadcast
    sample = marked.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), *(pa.array(c) for c in x.T)], ["doc_id", "quality", *FEATURES])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"{f} double" for f in FEATURES)
    got = rows.mapInArrow(frugal(measure), f"doc_id {id_type}, quality int, {kinds}").toPandas()
    got = got.sort_values(["doc_id", *FEATURES])  # the order in which rows arrive must not matter
    return Gam(got[list(FEATURES)].to_numpy(float), got["quality"].to_numpy())


def score_quality(docs: DataFrame, model: Gam, at_least: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            s = model.score(features(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= at_least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(frugal(run), f"doc_id {id_type}, held_out boolean, score double, predicted int")
