"""Lempel-Ziv phrase fingerprints.

A text is parsed LZ78-wise into phrases, each the longest known phrase and one character more. The set of
phrase hashes is reduced to a minimum-hash signature by one permutation in ``BINS`` bins, 16 bits a bin.
Two signatures are as alike as the share of equal bins among those that either fills, an estimate of the
Jaccard likeness of the phrase sets: texts that compress well given one another share phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import groups_for, ids_are_keys, mix, row_key, text_bytes, tidied

BINS = 128
_MASK = (1 << 64) - 1
_PRIME = 0x9E3779B97F4A7C15


class Parse:
    """The phrases of a text; ``fork`` parses another ending after ``cut`` characters without starting anew."""

    def __init__(self, text: str, cut: int | None = None):
        self.root: dict = {0: 1}
        self.phrases: list[int] = []
        self.cut = len(text) if cut is None else cut
        self._node = self._go(self.root, text[: self.cut])
        self._known = len(self.phrases)
        self.rest = text[self.cut :]
        self._added: list[tuple[dict, str]] = []
        self._go(self._node, self.rest, self._added)

    def _go(self, node: dict, text: str, added: list | None = None) -> dict:
        root, phrases = self.root, self.phrases
        for c in text:
            below = node.get(c)
            if below is None:
                h = (node[0] * _PRIME + ord(c) + 1) & _MASK
                node[c] = {0: h}
                phrases.append(h)
                if added is not None:
                    added.append((node, c))
                node = root
            else:
                node = below
        return node

    def signature(self) -> np.ndarray:
        return signature(np.array(self.phrases, dtype=np.uint64))

    def fork(self, ending: str) -> np.ndarray:
        """Signature of the first ``cut`` characters followed by ``ending``. The parse itself is used up."""
        for node, c in reversed(self._added):
            del node[c]
        del self.phrases[self._known :]
        self._go(self._node, ending)
        return self.signature()


def signature(phrases: np.ndarray) -> np.ndarray:
    """16 bits of the least hash in each bin; 0: an empty bin."""
    h = np.sort(mix(phrases))
    edges = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    ends = np.append(edges[1:], len(h))
    out = np.zeros(BINS, np.uint16)
    full = edges < ends
    out[full] = (h[edges[full]] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Two empty signatures are alike (1), an empty and another one not (0)."""
    used = (a > 0) | (b > 0)
    n = int(used.sum())
    return float(((a == b) & used).sum() / n) if n else 1.0


def show(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _dealt(docs: DataFrame, n: int) -> DataFrame:
    """(bucket, tail 0, doc_id, row_key, text): rows by about ``n`` ranges of descending doc_id, null ids last; as tail 1 each range also has the first row of the next one.

    Ranges end at ids that occur (approximate percentiles, off by a millionth of the rows at most), so every
    range has rows and the first id of each is known.
    """
    unique = ids_are_keys(docs)
    docs = docs.withColumn("row_key", row_key(docs, unique))
    has_null, top = docs.agg(F.max(F.col("doc_id").isNull()), F.max("doc_id")).first()
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, min(20 * n, 1_000_000))).alias("cuts")).first()["cuts"] if n > 1 else None
    cuts = np.array(sorted({c for c in found or [] if c < top}), dtype=np.int64)  # ascending; bucket 0 is above the last one
    n_full = len(cuts) + (top is not None)
    n_all = n_full + bool(has_null)

    def bucket_of(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
        return np.where(valid, len(cuts) - np.searchsorted(cuts, ids, side="left"), n_full).astype(np.int32)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()))), ids, batch.column("row_key")], names=["bucket", "doc_id", "row_key"])

    # the first key of each range: the first id itself if ids are unique; a range is about BUCKET_BYTES of text, these are a few numbers each
    if unique:
        first = np.append(cuts, [] if top is None else [top]).astype(np.int64)[::-1]
    else:
        heads = docs.select("doc_id", "row_key").mapInArrow(firsts, "bucket int, doc_id long, row_key long").groupBy("bucket").agg(F.max(F.struct(F.col("doc_id"), F.col("row_key"))).alias("h")).collect()
        first = np.zeros(n_all, np.int64)
        for r in heads:
            first[r["bucket"]] = r["h"]["row_key"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            id_, valid, keys = np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), np.asarray(batch.column("row_key"))
            own = bucket_of(id_, valid)
            heads = np.flatnonzero((keys == first[own]) & (~valid | np.isin(id_, np.append(cuts, top or 0))))
            for rows, bucket, tail in ((None, own, 0), (heads, (own[heads] - 1) % max(n_all, 1), 1)):
                part = batch if rows is None else batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), tail), pa.int32()), *part.columns], names=["bucket", "tail", "doc_id", "row_key", "text"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(deal, "bucket int, tail int, doc_id long, row_key long, text string")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller doc_id; after the smallest comes the largest. Rows of one
    doc_id follow each other by a hash of their text; null doc_ids come after all others. Null texts are
    empty. A single document is its own next one. No documents: no rows. Extra columns are ignored.

    Documents are dealt by ranges of doc_id, so that each text is shuffled once; only the first document of
    each range goes to the range before, too.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = _dealt(docs, groups_for(text_bytes(docs)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, doc_id, text, parse, signature
        out: list[tuple] = []
        weight, done = 0, None

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return made

        for rows in batches:
            for i in range(rows.num_rows):
                bucket, tail, doc_id, text = (rows.column(c)[i].as_py() for c in ("bucket", "tail", "doc_id", "text"))
                if bucket == done:
                    continue
                parse = Parse(text, len(text) - len(text) // 3)
                sig = parse.signature()
                if held is not None:
                    _, own_id, own, own_parse, own_sig = held
                    edited = edited_text(own, text)
                    forked = own_parse.fork(edited[own_parse.cut :])
                    out.append((own_id, len(own), edited, show(own_sig), show(forked), likeness(own_sig, forked), likeness(own_sig, sig)))
                    weight += len(edited)
                held = None if tail else (bucket, doc_id, text, parse, sig)
                done = bucket if tail else done
                if weight > 4 << 20:
                    yield batch()
                    weight = 0
        if out:
            yield batch()

    ddl = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("row_key").desc()).mapInArrow(tidied(run), ddl)
