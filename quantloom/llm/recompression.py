"""Substring dedup by recompression of word sequences.

Each round names runs of equal symbols, then pairs of adjacent ones, with hashes of what they stand for:
names are global, every executor gives the same name to the same content without asking, so that no round
needs a numbering of its own. A symbol is of the left or the right kind by a bit of its name, drawn anew
in each round, and a left one followed by a right one becomes one symbol of the next round. Equal word
sequences get equal symbols in their interior, which reach higher the longer the sequences are.

1. A symbol is shown when it first covers 24 words (for windows of 13), then 96, 384 and so on, under a 128-bit hash of its
   words. Where a smaller doc_id shows the same symbol, all windows inside are known repeats: long repeats
   are found and verified symbol by symbol, and their words never travel.
2. Edges of repeats, and short ones, lie outside shared symbols. Where a phrase of the first round starts
   depends on at most two words to either side. Names of two, four and six words from there on are built
   pair by pair, and each window of ``window`` words picks one position in it, preferably a phrase start, with the least
   six-word name; equal windows pick alike. Names picked in one document only are done with.
3. The windows outside known repeats that picked a name which several documents have are verified: their whole words are
   hashed to 96 bits and the smallest doc_id of each is found.
4. Words under a window that a smaller doc_id also has are removed.

The smallest document of a window never has it inside a known repeat, so every window is still judged
against its first document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from quantloom.llm.common import chunks, groups_for, mix, row_key, text_bytes, tidied, WordHashes
from quantloom.llm.exchange import ROUTED_DDL, Router, group_starts, meet_documents, meet_in_buckets

NAMED = 6  #: words under the name of a picked position
ROUNDS = 64  #: rounds of naming at most; what is not yet one symbol then is left to the windows
BEFORE = 2  #: words before a position on which its being a phrase start depends
_ODD = np.uint64(0xA0761D6478BD642F)
_LOW = np.uint64((1 << 32) - 1)


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD + b)


def high_half(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32)


def phrase_starts(x: np.ndarray) -> np.ndarray:
    """Whether a phrase starts at each word, as far as two words to either side tell (else False)."""
    n = len(x)
    eq = np.zeros(n + 2, bool)
    eq[: n - 1] = x[1:] == x[:-1]  # word p equals word p + 1
    start = np.ones(n, bool)
    start[1:] = ~eq[: n - 1]
    short = ~(eq[:n] & eq[1 : n + 1])
    symbol = np.where(eq[:n], mix(x + np.uint64(1)), x)
    right = (mix(symbol ^ _ODD) >> np.uint64(63)).astype(bool)
    after_right = np.zeros(n, bool)
    after_right[1:] = start[:-1] & right[:-1]
    return start & short & (~right | after_right)


def symbols(x: np.ndarray, doc: np.ndarray, shown: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and sizes of the symbols over word names ``x`` of the documents numbered ``doc``, when they first cover ``shown`` words, four times as many and so on."""
    name, first, size, doc = x.copy(), np.arange(len(x)), np.ones(len(x), np.int64), doc.copy()
    out_first, out_size = [first[:0]], [size[:0]]

    def level(n: np.ndarray) -> np.ndarray:
        return np.searchsorted(shown * 4 ** np.arange(12), n, side="right")

    for k in range(ROUNDS):
        if len(name) < 2 or not (doc[1:] == doc[:-1]).any():
            break
        # runs of equal symbols
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        if not new.all():
            at = np.flatnonzero(new)
            times, total = np.diff(np.append(at, len(name))), np.add.reduceat(size, at)
            grown = (times > 1) & (level(total) > level(size[at]))
            out_first.append(first[at[grown]])
            out_size.append(total[grown])
            name = np.where(times > 1, mix(name[at] * _ODD + times.astype(np.uint64)), name[at])
            first, size, doc = first[at], total, doc[at]
        # pairs of a left and a right symbol
        right = (mix(name + _ODD * np.full(1, k + 1, np.uint64)) >> np.uint64(63)).astype(bool)
        left = np.flatnonzero(~right[:-1] & right[1:] & (doc[1:] == doc[:-1]))
        total = size[left] + size[left + 1]
        grown = level(total) > level(np.maximum(size[left], size[left + 1]))
        out_first.append(first[left[grown]])
        out_size.append(total[grown])
        name[left] = join_names(name[left], name[left + 1])
        size[left] = total
        stays = np.ones(len(name), bool)
        stays[left + 1] = False
        name, first, size, doc = name[stays], first[stays], size[stays], doc[stays]
    return np.concatenate(out_first), np.concatenate(out_size)


def picked(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The position that each window of ``x`` picks, and the name of every position."""
    two = join_names(x[:-1], x[1:])
    four = join_names(two[:-2], two[2:])
    name = join_names(four[:-2], two[4:])
    order = (name >> np.uint64(1)) | (np.uint64(1 << 63) * ~phrase_starts(x)[: len(name)])
    code = (order & ~_LOW) | np.arange(len(name), dtype=np.uint64)
    span, n = window - BEFORE - NAMED + 1, len(x) - window + 1
    least = code[BEFORE : BEFORE + n].copy()
    for k in range(1, span):
        np.minimum(least, code[BEFORE + k : BEFORE + k + n], out=least)
    return (least & _LOW).astype(np.int64), name


class Chunk:
    """The words of some documents one after another, with their windows inside one document."""

    def __init__(self, texts: list[bytes], window: int, hashes: WordHashes):
        split = [t.split() for t in texts]
        self.sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.words = [w for s in split for w in s]
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.window = window
        self.x = hashes.of(self.words)
        if len(self.words) >= window:
            pick, self.name = picked(self.x, window)
            self.at = np.flatnonzero(self.doc[: len(pick)] == self.doc[window - 1 :])
            self.pick = pick[self.at]
        else:
            self.name, self.at, self.pick = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def hashes_of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """128-bit hashes of the ``size`` words from ``at`` on."""
        joined = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))) + np.arange(len(self.words))
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([h(joined[a:b]) for a, b in zip(starts[at].tolist(), ends[at + size - 1].tolist(), strict=True)]), dtype=np.uint64).reshape(-1, 2)


def first_of_each(hi: np.ndarray, lo: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id than its own has the hash, for each element."""
    order = np.lexsort((ids, lo, hi))
    new = group_starts(hi[order], lo[order])
    later = np.empty(len(hi), bool)
    later[order] = ids[order] > ids[order][new][np.cumsum(new) - 1]
    return later


def runs(key: np.ndarray, pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, number of words) of the maximal ranges under windows at ``pos`` that start next to each other."""
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    at = np.flatnonzero(group_starts(key, pos - np.arange(len(pos))))
    last = np.append(at[1:], len(pos))[: len(at)] - 1
    return key[at], pos[at].astype(np.int32), (pos[last] - pos[at] + window).astype(np.int32)


def removed_ranges(docs: DataFrame, key: Column, window: int, groups: int) -> DataFrame:
    """Answers (keys, first words, numbers of words) per group: ranges whose windows a smaller doc_id also has."""
    plain = docs.select("doc_id", "text", key.alias("row_key")).where("doc_id is not null and text is not null")

    def name_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out = WordHashes(), Router(groups, groups)
        for part, texts in chunks(batches):
            keys, ids = np.asarray(part.column("row_key")).view(np.uint64), np.asarray(part.column("doc_id"))
            c = Chunk(texts, window, hashes)
            at = np.unique(c.pick)
            name, key = c.name[at], keys[c.doc[at]]
            order = np.lexsort((key, name))
            name, key = name[order], key[order]
            once = group_starts(name, key)
            name, key = name[once], key[once]
            first = group_starts(name)
            size = np.diff(np.append(np.flatnonzero(first), len(first)))
            several = np.repeat(size > 1, size)
            short = high_half(name)
            own = np.flatnonzero(first)[np.argsort(key[first], kind="stable")]
            out.records(name[own], short[own], key[own], several[own])
            own = np.flatnonzero(several)[np.argsort(key[several], kind="stable")]
            out.answers(key[own], short[own])
            at, n = symbols(c.x, c.doc, 2 * window - 2)
            if len(at):
                h, d = c.hashes_of(at, n), c.doc[at]
                hi, lo, pos, n = h[:, 0], h[:, 1], (at - c.first[d]).astype(np.int32), n.astype(np.int32)
                later = first_of_each(hi, lo, ids[d])
                out.answers(keys[d[later]], pos[later], n[later])
                own = np.flatnonzero(~later)
                own = own[np.lexsort((pos[own], keys[d[own]]))]
                out.records(hi[own], hi[own], lo[own], ids[d[own]], keys[d[own]], pos[own], n[own], kind=2)
            yield out.batch()
        yield out.batch(last=True)

    def shared_names(name: np.ndarray, key: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(name, kind="stable")
        name, key, told = name[order], key[order], told[order]
        size = np.diff(np.append(np.flatnonzero(group_starts(name)), len(name)))
        ask = np.flatnonzero(np.repeat(size > 1, size) & ~told)
        ask = ask[np.argsort(key[ask], kind="stable")]
        return key[ask], name[ask]

    def shared_symbols(hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, key: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        later = first_of_each(hi, lo, ids)
        key, pos, n = key[later], pos[later], n[later]
        order = np.lexsort((pos, key))
        return key[order], pos[order], n[order]

    # answers give half a name: a false one costs a comparison, since windows are verified
    def known(held: list[tuple]) -> tuple[np.ndarray, tuple[np.ndarray, ...], WordHashes]:
        names, ranges = [x for x in held if len(x) == 2], [x for x in held if len(x) == 3]
        shared = np.unique(np.concatenate([np.zeros(0, np.uint64), *(join_names(k, n.astype(np.uint64)) for k, n in names)]))
        return shared, by_key(ranges), WordHashes()

    def verify(ready: tuple, keys: np.ndarray, part: pa.RecordBatch, texts: list[bytes], out: Router) -> Iterator[pa.RecordBatch]:
        shared, ranges, hashes = ready
        c = Chunk(texts, window, hashes)
        key, pos, n, doc = of_documents(ranges, keys)
        out.answers(key, pos, n)
        # windows inside the ranges are known
        edge = np.zeros(len(c.words) + 1, np.int32)
        at = c.first[doc] + pos
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + n - window + 1, 1)
        open_ = np.cumsum(edge)[c.at] == 0
        hit = open_ & np.isin(join_names(keys[c.doc[c.pick]], high_half(c.name[c.pick]).astype(np.uint64)), shared)
        at = c.at[hit]
        if len(at):
            ids, h = np.asarray(part.column("doc_id")), c.hashes_of(at, window)
            d = c.doc[at]
            hi, lo, id_, pos = h[:, 0], high_half(h[:, 1]), ids[d], (at - c.first[d]).astype(np.int32)
            later = first_of_each(hi, lo, id_)
            out.answers(*runs(keys[d[later]], pos[later], window))
            own = ~later
            out.records(hi[own], hi[own], lo[own], id_[own], keys[d[own]], pos[own])
        yield from ()

    def later_windows(hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        later = first_of_each(hi, lo, ids)
        return runs(key[later], pos[later], window)

    names = plain.mapInArrow(tidied(name_positions), ROUTED_DDL)
    asked = meet_in_buckets(names, groups, shared_names, {2: shared_symbols})
    windows = meet_documents(plain.drop("row_key"), key, asked, groups, known, verify, answered_only=True)
    return meet_in_buckets(windows, groups, later_windows)


def by_key(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (key, first word, number of words), ordered by key."""
    key, pos, n = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    order = np.argsort(key, kind="stable")
    return key[order], pos[order], n[order]


def of_documents(ranges: tuple[np.ndarray, ...], keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges (of ``by_key``) of the documents with these keys, with their number among ``keys``. Rows that repeat have them each."""
    a, b = np.searchsorted(ranges[0], keys, "left"), np.searchsorted(ranges[0], keys, "right")
    doc = np.repeat(np.arange(len(keys)), b - a)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    return *(x[at] for x in ranges), doc


def dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """The documents with three more columns: kept_text (the words that stay, joined by one space), n_words, n_removed.

    A word goes if a window of ``window`` consecutive words over it also starts in a document with a
    smaller doc_id; windows are judged on the input. Repeats inside one document, and between rows of
    one doc_id, stay. Null text: no words, kept_text empty. A null doc_id is smaller or larger than none:
    such a row loses nothing and takes from none. Rows that repeat are treated alike. No documents: no
    rows. Columns of ``docs`` named like the three new ones are replaced.
    """
    if window < BEFORE + NAMED:
        raise ValueError(f"windows have {BEFORE + NAMED} words at least")
    new = {"kept_text": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType()}
    docs = docs.drop(*new)
    groups, key = groups_for(text_bytes(docs)), row_key(docs)
    marks = removed_ranges(docs, key, window, groups)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in new.items())])
    has_id = docs.columns.index("doc_id")

    def cut(ready: tuple[np.ndarray, ...], keys: np.ndarray, part: pa.RecordBatch, texts: list[bytes], _: Router) -> Iterator[pa.RecordBatch]:
        _, pos, n, doc = of_documents(ready, keys)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        known = np.asarray(part.column(has_id).is_valid())
        kept, n_words, n_removed = [], [], []
        for i, t in enumerate(texts):
            words = t.split()
            n_words.append(len(words))
            a, b = bounds[i], bounds[i + 1]
            if a < b and known[i]:
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, pos[a:b], 1)
                np.subtract.at(edge, pos[a:b] + n[a:b], 1)
                stays = np.cumsum(edge)[:-1] == 0
                words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
            kept.append(b" ".join(words))
            n_removed.append(n_words[-1] - len(words))
        arrays = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *new])

    return meet_documents(docs, key, marks, groups, by_key, cut, schema)
