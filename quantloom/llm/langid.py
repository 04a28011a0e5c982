"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Weights are learned by follow-the-regularised-leader with an elastic net, so most stay zero; the
temperature of the softmax is then fitted on rows that were not trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import chunks, tidied

BITS = 14
SIZE = 1 << BITS
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed character 1- to 3-grams; letters in lower case, all else one kind of gap."""
    s = text.decode(errors="replace").lower()
    c = np.frombuffer(f" {s} ".encode("utf-32-le", errors="replace"), dtype=np.uint32).astype(np.uint64)
    c[(c < 0x61) | ((c > 0x7A) & (c < 0xC0))] = 0x20
    total = np.zeros(SIZE, np.int64)
    h = c
    for n in range(3):
        if n:
            if len(h) < 2:
                break
            h = (h[:-1] * np.uint64(1 << 21)) ^ c[n:]
        total += np.bincount(((h + np.uint64(n + 1)) * _ODD >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
    return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # SIZE x langs
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        counts = gram_counts(text)
        at = np.flatnonzero(counts)
        x = (1 + np.log(counts[at])) * self.idf[at]
        return at, x / (np.linalg.norm(x) or 1.0)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if text is None or not self.langs or not _LETTER.search(text.decode(errors="replace")):
            return UNKNOWN, 0.0
        at, x = self.vector(text)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Proximal per-coordinate updates; returns weights and bias (the bias is not regularised)."""
    z, n = np.zeros((SIZE + 1, n_langs)), np.zeros((SIZE + 1, n_langs))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        first, second = np.where(at == SIZE, 0.0, l1)[:, None], np.where(at == SIZE, 0.0, l2)[:, None]
        return np.where(np.abs(zi) <= first, 0.0, -(zi - np.sign(zi) * first) / ((beta + np.sqrt(n[at])) / alpha + second))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(y)):
            at, x = np.append(vectors[i][0], SIZE), np.append(vectors[i][1], 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y[i]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(z / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _document_frequencies(learnable: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all learnable documents each n-gram occurs; the table has ``SIZE`` rows whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, np.int64), 0
        for _, texts in chunks(batches):
            for t in texts:
                df += gram_counts(t) > 0
                n += 1
        at = np.append(np.flatnonzero(df), SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.append(df[at[:-1]], n), pa.int64())], names=["gram", "n"])

    df, n = np.zeros(SIZE + 1, np.int64), 0
    for r in learnable.select("text").mapInArrow(tidied(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        df[r["gram"]] = r["n"]
    n = int(df[SIZE])
    return df[:SIZE], n


def fit(docs: DataFrame, max_rows: int = 5000, calibration: int = 5) -> Model:
    """Learns from rows that are not held out and have a lang and a text.

    Document frequencies cover all of them. The weights come from ``max_rows`` at most, dealt evenly over
    the langs (of each those with the least hash of doc_id); one in ``calibration`` of them calibrates.
    """
    learnable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in learnable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()}
    if not counts:
        return Model([], np.zeros(SIZE), np.zeros((SIZE, 0)), np.zeros(0))
    langs, each = sorted(counts), max(1, max_rows // len(counts))
    df, n = _document_frequencies(learnable)
    idf = np.log((n + 1) / (df + 1)) + 1.0
    model = Model(langs, idf, np.zeros((SIZE, len(langs))), np.zeros(len(langs)))
    # a hash below the wanted share keeps about ``each`` rows of a lang; the limit then bounds what is collected
    share = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40)) / float(1 << 40)
    wanted = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / c))) for k, c in counts.items()])
    sample = learnable.where(share < wanted).select(F.xxhash64("doc_id", F.lit("part")).alias("h"), "doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            v = [model.vector(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("lang"), pa.array([a.astype(np.uint16).tobytes() for a, _ in v], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in v], pa.binary())], names=["h", "lang", "at", "x"])

    rows = sample.mapInArrow(tidied(run), "h long, lang string, at binary, x binary").orderBy("h", "lang", "at").limit(2 * max_rows).collect()
    vectors = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(np.float64)) for r in rows]
    y = np.array([langs.index(r["lang"]) for r in rows], dtype=np.int64)
    rest = np.array([r["h"] % calibration == 0 for r in rows], dtype=bool)
    train = np.flatnonzero(~rest) if (~rest).any() else np.arange(len(rows))
    if len(train):
        model.weights, model.bias = ftrl([vectors[i] for i in train], y[train], len(langs))
    if rest.any() and len(langs) > 1:
        z = np.stack([vectors[i][1] @ model.weights[vectors[i][0]] + model.bias for i in np.flatnonzero(rest)])
        model.temperature = temperature(z, y[rest])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned. Null
    doc_ids are never held out. Repeated rows are predicted each; no rows: no rows. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            found = [model.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
