"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are rates and densities of a text: words of a lexicon learned from the training labels,
their nearness to second-person words, capitals, punctuation, obfuscated words. Trees are grown on
binned features by histogram gains of the logistic loss; the raw score is made a probability by isotonic
regression on rows that no tree saw.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import checkpointed, chunks, tidied

#: Second-person words of the languages at hand.
SECOND_PERSON = {w.encode() for w in "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen ihre usted ustedes ti tus vosotros os su sus".split()}
#: What stands for a letter in obfuscated words.
LEET = bytes.maketrans(b"0134578@$!|", b"oleastbasii")
FEATURES = ["log_words", "lexicon_density", "lexicon_weight", "lexicon_most", "lexicon_kinds", "stem_density", "stem_weight", "hidden_density", "second_person", "near_second_person", "capitals", "all_caps", "exclamations", "questions", "punctuation", "obfuscated", "digits", "repeats", "mean_length", "distinct"]
_EDGE = re.compile(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")
_TRIM = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_MIXED = r"[A-Za-z\x{80}-\x{10FFFF}][0-9@$!|*#]+[A-Za-z\x{80}-\x{10FFFF}]"
_SECOND = pa.array(sorted(w.decode() for w in SECOND_PERSON))


def core(word: bytes) -> bytes:
    """The word in lower case without ASCII marks at its ends."""
    return _EDGE.sub(b"", word).lower()


def plain(words: pa.StringArray) -> pa.Array:
    """The words with look-alikes turned to letters and other marks taken out."""
    joined = b"\n".join(words.cast(pa.binary()).to_pylist()).lower().translate(LEET)
    return pa.array(re.sub(rb"[^a-z\n\x80-\xff]", b"", joined).split(b"\n"), pa.binary())


def stems(c: bytes) -> list[bytes]:
    """First four and five characters, marked, of words longer than that."""
    s = c.decode(errors="replace")
    return [b"\x01" + s[:k].encode() for k in (4, 5) if len(s) > k]


def thrice(words: pa.StringArray) -> np.ndarray:
    """Whether a byte of the word stands three times in a row."""
    out = np.zeros(len(words), bool)
    _, offsets, values = words.buffers()
    if values is not None:
        data = np.frombuffer(values, dtype=np.uint8)
        ends = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1][1:]
        at = np.flatnonzero((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]))
        word = np.searchsorted(ends, at, side="right")
        out[word[(word < len(ends)) & (at + 2 < ends[np.minimum(word, len(ends) - 1)])]] = True
    return out


class Lexicon:
    """The weights of words and stems, and the features of texts by them, a chunk of texts at a time."""

    def __init__(self, weights: dict[bytes, float]):
        self.terms = pa.array(list(weights), pa.binary())
        self.weights = np.append(np.array(list(weights.values()), dtype=np.float64), 0.0)

    def weight(self, terms: pa.Array) -> np.ndarray:
        """The weights of terms, 0 of unknown ones."""
        at = pc.index_in(terms.cast(pa.binary()), value_set=self.terms)
        return self.weights[np.asarray(pc.fill_null(at, len(self.weights) - 1))]

    def kinds(self, words: pa.StringArray) -> np.ndarray:
        """One row for each distinct word: (lexicon weight, stem weight, hidden weight, second person, capitals, all capitals, exclamations, questions, marks, mixed, digits, repeats, length)."""
        core = pc.ascii_lower(pc.ascii_trim(words, _TRIM))
        own = self.weight(core)
        size = np.asarray(pc.utf8_length(core))
        stem = np.maximum(*(np.where(size > k, self.weight(pc.binary_join_element_wise("\x01", pc.utf8_slice_codeunits(core, 0, k), "")), 0.0) for k in (4, 5)))
        mixed = np.asarray(pc.match_substring_regex(words, _MIXED))
        look = np.flatnonzero((own == 0) & (mixed | ~np.asarray(pc.match_substring_regex(core, "^[a-z]+$"))))
        hidden = np.zeros(len(words))
        if len(look):
            hidden[look] = self.weight(plain(words.take(pa.array(look))))
        length, upper, letters, digits = (np.asarray(x).astype(np.int64) for x in (pc.utf8_length(words), pc.count_substring_regex(words, r"\p{Lu}"), pc.count_substring_regex(words, r"\p{L}"), pc.count_substring_regex(words, r"\p{Nd}")))
        second = np.asarray(pc.is_in(core, value_set=_SECOND))
        shouts, asks = (np.asarray(pc.count_substring(words, m)) for m in "!?")
        return np.stack([own, stem, hidden, second, upper, (letters > 1) & (upper == letters), shouts, asks, length - letters - digits, mixed, digits > 0, thrice(core), length], axis=1).astype(np.float64)

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row of ``FEATURES`` for each text; null texts and texts without words have zeros."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        n_parts, words = np.asarray(pc.list_value_length(split)).astype(np.int64), pc.list_flatten(split)
        real = np.asarray(pc.binary_length(words)) > 0
        doc = np.repeat(np.arange(len(texts)), n_parts)[real]
        out = np.zeros((len(texts), len(FEATURES)))
        if not len(doc):
            return out
        coded = words.filter(pa.array(real)).dictionary_encode()
        code, table = np.asarray(coded.indices).astype(np.int64), self.kinds(coded.dictionary)
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        has, n = doc[starts], np.diff(np.r_[starts, len(doc)]).astype(np.float64)

        def total(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, starts, dtype=np.float64)

        strong = np.maximum(table[:, 0], table[:, 2])
        hit, second = (strong > 0)[code], (table[:, 3] > 0)[code]
        near = np.zeros(len(doc), bool)
        for d in range(-3, 4) if hit.any() and second.any() else ():
            a, b = (slice(0, max(len(doc) - abs(d), 0)), slice(abs(d), len(doc)))[:: 1 if d >= 0 else -1]
            near[a] |= hit[a] & second[b] & (doc[a] == doc[b])
        seen = np.unique(doc * len(table) + code)
        kinds, hits = (np.bincount(x // len(table), minlength=len(texts))[has] for x in (seen, seen[(strong > 0)[seen % len(table)]]))
        sums = [total(table[:, k][code]) for k in range(4, 13)]
        upper, shout, asks, marks, chars = sums[0], sums[2], sums[3], sums[4], sums[8]
        out[has] = np.stack([np.log1p(n), total(hit) / n, total(strong[code]) / n, np.maximum.reduceat(strong[code], starts), np.minimum(hits, 50), total((table[:, 1] > 0)[code]) / n, total(table[:, 1][code]) / n, total((table[:, 2] > 0)[code]) / n, total(second) / n, total(near) / n, upper / chars, sums[1] / n, shout / n, asks / n, marks / chars, sums[5] / n, sums[6] / n, sums[7] / n, chars / n, kinds / n], axis=1)
        return out


@dataclass
class Trees:
    """Boosted trees of the logistic loss over quantile-binned features; depth-wise, ``2 ** depth`` leaves each."""

    depth: int = 4
    rounds: int = 120
    rate: float = 0.1
    bins: int = 64
    penalty: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, k = self._bin(x), self.bins + 1
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feats, cuts = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, k, np.int64)
            for level in range(self.depth):
                width, best = 2**level, np.full(2**level, 1e-9)
                for j in range(x.shape[1]):
                    at = node * k + b[:, j]
                    gs = np.bincount(at, g, width * k).reshape(width, k).cumsum(axis=1)
                    hs = np.bincount(at, h, width * k).reshape(width, k).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hs < 2) | (ht - hs < 2)] = 0
                    c = gain.argmax(axis=1)
                    top = gain[np.arange(width), c]
                    better = top > best
                    best[better] = top[better]
                    at = width - 1 + np.flatnonzero(better)
                    feats[at], cuts[at] = j, c[better]
                here = width - 1 + node
                node = node * 2 + (b[np.arange(len(y)), feats[here]] > cuts[here])
            leaf = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.penalty)
            self.splits.append((feats, cuts, leaf))
            raw += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.splits:
            b, rows = self._bin(x), np.arange(len(x))
            for feats, cuts, leaf in self.splits:
                node = np.zeros(len(x), np.int64)
                for level in range(self.depth):
                    here = 2**level - 1 + node
                    node = node * 2 + (b[rows, feats[here]] > cuts[here])
                out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit, by pooling adjacent violators; ends drawn in by a pseudo-row each."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, r2 = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + v2, a[1] + n2, (a[2] * a[1] + r2 * n2) / (a[1] + n2)]
    mean = float(y.mean())
    return np.array([b[2] for b in blocks]), np.array([(b[0] + mean) / (b[1] + 1) for b in blocks])


@dataclass
class Model:
    weights: dict[bytes, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _per_text(docs: DataFrame, weights: dict[bytes, float]) -> DataFrame:
    """``docs`` (id columns and text) with the features in place of the text."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for part, _ in chunks(batches):
            x = lexicon.features(part.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), rows], names=[*names, "x"])

    ddl = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(tidied(run), f"{ddl}, x array<double>")


def _lexicon(sample: DataFrame, size: int, min_docs: int) -> dict[bytes, float]:
    """Log odds of the words and stems that mark label 1, at most ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            counts: dict[bytes, list[int]] = {}
            for t, y in zip(texts, part.column("y").to_pylist(), strict=True):
                terms = set()
                for w in set(t.split()):
                    if c := core(w):
                        terms.add(c)
                        terms.update(stems(c))
                for term in terms:
                    counts.setdefault(term, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([v[1] for v in counts.values()], pa.int64()), pa.array([v[0] for v in counts.values()], pa.int64())], names=["term", "a", "b"])

    n1, n0 = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not n1 or not n0:
        return {}
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    terms = sample.mapInArrow(tidied(run), "term binary, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = terms.where(F.col("a") >= min_docs).withColumn("odds", odds).where("odds > 1").orderBy((F.col("odds") * F.sqrt("a")).desc(), "term").limit(size)
    return {bytes(r["term"]): float(r["odds"]) for r in best.select("term", "odds").collect()}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, lexicon_size: int = 3000, min_docs: int = 4, calibration: int = 5) -> Model:
    """Fits on labelled documents that are not held out: ``max_rows`` at most, those with the least hash of doc_id.

    One in ``calibration`` of them, by hash, calibrates; the lexicon and the trees come from the others.
    Labels that are null, and ids without a document, are left out; of several labels of an id the largest
    holds. Without both classes the score is the mean label (0 without labels).
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = one.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(calibration))
    # the labels are at most max_rows rows of 12 bytes
    sample = checkpointed(texts.join(F.broadcast(chosen), "doc_id").withColumn("part", part))
    weights = _lexicon(sample.where("part <> 0").select("text", "y"), lexicon_size, min_docs)
    # max_rows rows of a few numbers
    rows = sorted(_per_text(sample, weights).collect(), key=lambda r: (r["doc_id"], r["x"]))
    x, y, own = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("x", "y", "part"))
    train, rest = own != 0, own == 0
    if not len(rows) or len(set(y[train].tolist())) < 2:
        mean = float(y.mean()) if len(rows) else 0.0
        return Model(weights, Trees(), (np.array([0.0]), np.array([mean])))
    trees = Trees().fit(x[train], y[train])
    use = rest if len(set(y[rest].tolist())) == 2 else train
    return Model(weights, trees, isotonic(trees.raw(x[use]), y[use]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts get the score of a text without words. Null doc_ids are never held out. Repeated
    rows are scored each; no rows: no rows. Extra columns are ignored.
    """
    plain_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.weights)
        for part, _ in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(lexicon.features(part.column("text"))), pa.float64())], names=["doc_id", "score"])

    scored = plain_rows.mapInArrow(tidied(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns and values are those of ``docs``.

    Null and empty texts are judged as texts without words, repeated rows each by itself, whatever their
    ids; null doc_ids are no labelled rows. Without usable labels every score is 0 and all rows stay. No
    documents: no rows.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.weights)
        for part, _ in chunks(batches):
            yield part.filter(pa.array(model.score(lexicon.features(part.column("text"))) < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
