"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over a window of ``WINDOW`` bytes,
each filter's maximum over the window goes through a rectifier, and a softmax layer
gives the languages.  The network is trained in numpy by Adam on windows of labelled
texts (the gradient of a maximum reaches one place only, so training costs little more
than scoring).  A text is cut into windows without overlap, the last one padded; its
prediction is the language with the largest probability, averaged over the windows by
their bytes, and its score is that average.

It learns from about ``DOCS_PER_LANG`` documents of each language, chosen by a seeded
hash, and at most ``WINDOWS_PER_DOC`` windows of each, spread over the document; the
number of languages is bounded by ``MAX_LANGS``, and more raise an error.  Every text is
predicted whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no
labelled text every text is ``und``; repeated rows give repeated results; an empty table
gives an empty one; further columns are left out (``keep_known`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import flat_bytes, frugal, held_out, steps

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 4
DOCS_PER_LANG = 1000
WINDOWS_PER_DOC = 3
MAX_LANGS = 1000
EPOCHS = 6
BATCH = 64
BLOCK = 512  # windows that are scored at once
UNKNOWN = "und"


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows × WINDOW bytes, windows before each text, bytes of each window)."""
    flat, offsets = flat_bytes(column)
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    before = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(before[-1]) * WINDOW, np.uint8)
    out[np.arange(len(flat)) + np.repeat(before[:-1] * WINDOW - offsets[:-1], sizes)] = flat
    first = np.repeat(before[:-1], counts)
    left = np.repeat(sizes, counts) - (np.arange(int(before[-1])) - first) * WINDOW
    return out.reshape(-1, WINDOW), before, np.minimum(left, WINDOW)


class ByteCnn:
    def __init__(self, langs: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.langs = langs
        self.p = {"e": normal(256, EMBED) * 0.5, "w": normal(FILTERS * len(WIDTHS), len(langs)) * 0.1, "b": np.zeros(len(langs), np.float32)}
        for k in WIDTHS:
            self.p[f"f{k}"] = normal(k * EMBED, FILTERS) / np.float32(np.sqrt(k * EMBED))
            self.p[f"c{k}"] = np.zeros(FILTERS, np.float32)

    def _pooled(self, x: np.ndarray, where: bool = False):
        """Filter maxima (windows × filters), and with ``where`` their places; x: windows × bytes."""
        t = np.ascontiguousarray(x.T)  # by place, so that maxima run over whole rows
        n = t.shape[1]
        e = self.p["e"][t]
        out, places = [], []
        for k in WIDTHS:
            m = len(t) - k + 1
            patch = np.concatenate([e[j : j + m] for j in range(k)], axis=2).reshape(-1, k * EMBED)
            got = (patch @ self.p[f"f{k}"]).reshape(m, n * FILTERS)
            out.append(got.max(axis=0).reshape(n, FILTERS) + self.p[f"c{k}"])
            if where:
                places.append(got.argmax(axis=0).reshape(n, FILTERS))
        return np.concatenate(out, axis=1), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x) if self.langs else 0, BLOCK):
            z = np.maximum(self._pooled(x[i : i + BLOCK])[0], 0) @ self.p["w"] + self.p["b"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + BLOCK] = z / z.sum(axis=1, keepdims=True)
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, places = self._pooled(x, where=True)
        act = np.maximum(pooled, 0)
        z = act @ self.p["w"] + self.p["b"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"w": act.T @ d, "b": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        back = (d @ self.p["w"].T) * (pooled > 0)
        for i, k in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            at = x[np.arange(len(x))[:, None, None], places[i][:, :, None] + np.arange(k)]  # windows × filters × width
            patch = self.p["e"][at].reshape(len(x), FILTERS, k * EMBED)
            g[f"f{k}"] = np.einsum("nf,nfd->df", part, patch)
            g[f"c{k}"] = part.sum(axis=0)
            np.add.at(g["e"], at, (part[:, :, None] * self.p[f"f{k}"].T[None]).reshape(len(x), FILTERS, k, EMBED))
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 6) -> "ByteCnn":
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                t += 1
                part = order[i : i + BATCH]
                for k, g in self._gradients(x[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * 0.5**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of every text."""
        x, before, sizes = windows(column)
        counts, n = np.diff(before), len(column)
        known = np.zeros((n, len(self.langs)))
        np.add.at(known, np.repeat(np.arange(n), counts), self.probabilities(x) * sizes[:, None])
        known /= np.maximum(known.sum(axis=1, keepdims=True), 1e-9)
        texts = np.zeros(n, bool)
        letters = ((x | 32) >= 97) & ((x | 32) <= 122)
        np.logical_or.at(texts, np.repeat(np.arange(n), counts), letters.any(axis=1))
        for i in np.flatnonzero(~texts & (counts > 0)):  # no ASCII letter: look for others
            texts[i] = any(c.isalpha() for c in column[int(i)].as_py())
        best = known.argmax(axis=1) if self.langs else np.zeros(n, int)
        found = texts & bool(self.langs)
        names = [self.langs[b] if f else UNKNOWN for b, f in zip(best, found)]
        return names, np.where(found, known.max(axis=1, initial=0.0), 0.0)


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> ByteCnn:
    """The network of documents outside the held-out fifth, from their texts and ``lang``."""
    rows = docs.select("doc_id", "lang", "text").filter("lang IS NOT NULL").filter(~held_out())
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return ByteCnn([])
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, docs_per_lang / r["count"]))])
    drawn = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < rate[F.col("lang")] * F.lit(1_000_000)

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            x, before, _ = windows(b.column("text"))
            n = np.minimum(np.diff(before), WINDOWS_PER_DOC)
            which = np.repeat(np.arange(len(n)), n)
            turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = before[:-1][which] + turn * np.diff(before)[which] // np.maximum(n[which], 1)
            data = pa.array([w.tobytes() for w in x[at]], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(which)), data], ["lang", "bytes"])

    got = rows.filter(drawn).select("lang", "text").mapInArrow(frugal(cut_windows), "lang string, bytes binary").toPandas()
    got = got.sort_values(["lang", "bytes"])  # the order in which rows arrive must not matter
    if not len(got):
        return ByteCnn([])
    x = np.frombuffer(b"".join(map(bytes, got["bytes"])), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(langs, got["lang"].to_numpy(str))
    return ByteCnn(langs).train(x, y)


def identify(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            names, score = model.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(frugal(run), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: ByteCnn, at_least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of ``at_least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            names, score = model.predict(b.column("text"))
            yield b.filter(pa.array((np.array(names) != UNKNOWN) & (score >= at_least)))

    return docs.mapInArrow(frugal(run), docs.schema)
