"""Suffix-array dedup of repeated byte strings, by two-stage suffix sorting of the places where repeats can end.

1. Each window of ``length`` bytes picks the position with the least hash among its first bytes; equal
   windows pick alike. A picked position is known by the bytes that every window picking it has (its
   anchor) and by all bytes that any such window can have (its context).
2. Contexts that occur twice are repeats from end to end. An anchor with one occurrence has none. What is
   left are anchors whose contexts differ somewhere: only there the ends of repeats must be found.
3. Equal windows start at one distance before the position they pick. Distances are cut in ``PARTS`` ranges;
   the windows of a range have its core in common and lie in a piece of the context. Pieces meet by
   their cores, so that a frequent anchor is many small sets.
4. The pieces of a core are sorted together: suffixes smaller than their successors directly,
   the rest induced from them by a scan over the buckets of first bytes; windows with a common prefix of
   ``length`` bytes are then neighbours. A set above ``SORT_BYTES`` is cut further, by halves of the range
   and the cores of these, until it fits or its windows have one distance: then the core is the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import chunks, groups_for, mix, row_key, text_bytes, tidied
from quantloom.llm.exchange import ROUTED_DDL, Router, group_starts, meet_documents, meet_in_buckets

#: Bytes sorted as one text; a larger set of pieces is cut by ranges of distance first.
SORT_BYTES = 256 << 10
#: Ranges of the distance between a window's start and the position it picks.
PARTS = 4
_LOW = np.uint64((1 << 32) - 1)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def picked(buf: bytes, first: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Positions in ``buf`` that windows inside one document pick."""
    half = length // 2
    n = len(buf)
    if n < length:
        return np.zeros(0, np.int64)
    word = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=buf, strides=(1,))
    code = (mix(word) & ~_LOW) | np.arange(n - 7, dtype=np.uint64)
    least = sliding_minimum(code, half + 1)[: n - length + 1]
    inside = np.zeros(n + 1, np.int32)
    long = size >= length
    inside[first[long]] += 1
    np.subtract.at(inside, first[long] + size[long] - length + 1, 1)
    windows = np.cumsum(inside)[: len(least)] > 0
    return np.unique((least[windows] & _LOW).astype(np.int64))


def two_stage(text: bytes, first: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` bytes inside the pieces of ``text``, by their first ``length`` bytes.

    Pieces lie one after another, each followed by a zero byte, the last one also by a one. A suffix is small
    if it is less than its successor; the zero bytes are. The small suffixes up to the first one that ends the needed range of a piece are sorted as
    they are; each other one has a smaller successor that is in place before it, and takes the next slot
    of its first byte's bucket.
    """
    t = np.frombuffer(text, dtype=np.uint8)
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1]) + 1
    run_end = np.append(change, n)
    run_len = np.diff(np.concatenate([[0], run_end]))
    after = np.append(t[change], 0)
    small = np.repeat(t[np.concatenate([[0], change])] < after, run_len)
    last = first + size - length
    next_small = np.append(np.flatnonzero(small), n)
    stop = np.minimum(next_small[np.searchsorted(next_small, last)], first + size)
    need = np.zeros(n + 2, np.int32)
    np.add.at(need, first, 1)
    np.subtract.at(need, stop + 1, 1)
    needed = np.cumsum(need)[:n] > 0
    wanted = np.zeros(n + 2, np.int32)
    np.add.at(wanted, first, 1)
    np.subtract.at(wanted, last + 1, 1)
    is_start = np.cumsum(wanted)[:n] > 0
    direct = np.flatnonzero(needed & small).tolist()
    direct.sort(key=lambda i: text[i : i + length])
    # a bucket holds first the suffixes that are larger than their successor, then the small ones
    slots: list[list[int]] = [[] for _ in range(256)]
    tails: list[list[int]] = [[] for _ in range(256)]
    for i in direct:
        tails[text[i]].append(i)
    larger = (needed & ~small).tolist()
    out: list[int] = []
    for c in range(256):
        for part in (slots[c], tails[c]):
            for i in part:  # grows while it is read
                out.append(i)
                if i and larger[i - 1]:
                    slots[text[i - 1]].append(i - 1)
    sa = np.array(out, dtype=np.int64)
    return sa[is_start[sa]]


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, a group number for each window start (-1: its bytes start nowhere else in the pieces)."""
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    first = np.cumsum(size + 1) - size - 1
    text = b"\0".join(pieces) + b"\0\1"
    group = np.full(len(text), -1, np.int64)
    sa = two_stage(text, first, size, length).tolist()
    named, same = 0, False
    for a, b in zip(sa, sa[1:], strict=False):
        same, before = text[a : a + length] == text[b : b + length], same
        if same:
            named += not before
            group[a] = group[b] = named
    return [group[f : f + max(0, s - length + 1)] for f, s in zip(first, size, strict=True)]


def part_bounds(most: int) -> np.ndarray:
    """The ranges of distances 0 to ``most``: range j holds those from bound j to below bound j + 1."""
    return np.linspace(0, most + 1, PARTS + 1).round().astype(np.int64)


def core_of(piece: bytes, at: int, lo: int, hi: int, length: int) -> bytes:
    """The bytes of all windows that start ``lo`` to ``hi`` - 1 before position ``at`` of the piece."""
    return piece[at - lo : at - hi + 1 + length]


def sets_to_sort(members: list[int], pieces: list[bytes], at: list[int], lo: int, hi: int, length: int) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
    """Sets of pieces that can hold equal windows, with the byte range of each, of ``SORT_BYTES`` together or of one distance.

    ``members`` have the core of distances ``lo`` to ``hi`` - 1 in common, and at least one such window each.
    """
    cuts = [(max(0, at[i] - hi + 1), min(len(pieces[i]), at[i] - lo + length)) for i in members]
    if hi - lo == 1 or sum(b - a + 1 for a, b in cuts) <= SORT_BYTES - 2:
        yield members, cuts
        return
    mid = (lo + hi) // 2
    for x, y in ((lo, mid), (mid, hi)):
        sets: dict[bytes, list[int]] = {}
        for i in members:
            if at[i] - x >= 0 and at[i] - y + 1 + length <= len(pieces[i]):
                sets.setdefault(xxhash.xxh3_128_digest(core_of(pieces[i], at[i], x, y, length)), []).append(i)
        for own in sets.values():
            if len(own) > 1:
                yield from sets_to_sort(own, pieces, at, x, y, length)


def repeated_spans(docs: DataFrame, key: Column, length: int, groups: int) -> DataFrame:
    """Answers (keys, starts, ends) per group: byte ranges under strings that also start elsewhere."""
    half = length // 2
    bounds = part_bounds(half).tolist()
    plain = docs.select("doc_id", "text", key.alias("row_key")).where(F.octet_length("text") >= length)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Router(groups, groups)
        for part, texts in chunks(batches):
            keys = np.asarray(part.column("row_key")).view(np.uint64)
            size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            first = np.cumsum(size) - size
            buf = b"".join(texts)
            at = picked(buf, first, size, length)
            doc = np.searchsorted(first, at, side="right") - 1
            left = np.minimum(at - first[doc], half)
            right = np.minimum(first[doc] + size[doc] - at, length)
            anchor = np.fromiter((xxhash.xxh3_64_intdigest(buf[p : p + half]) for p in at.tolist()), dtype=np.uint64, count=len(at))
            ctx = np.frombuffer(b"".join([xxhash.xxh3_128_digest(buf[p - a : p + b], a) for p, a, b in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)]), dtype=np.uint64).reshape(-1, 2)
            order = np.lexsort((ctx[:, 1], ctx[:, 0], anchor))
            anchor, hi, lo, at, doc, left, right = anchor[order], ctx[order, 0], ctx[order, 1], at[order], doc[order], left[order], right[order]
            new = group_starts(anchor, hi, lo)
            several = np.repeat(n := np.diff(np.append(np.flatnonzero(new), len(new))), n) > 1
            key, pos = keys[doc], (at - first[doc]).astype(np.uint32)
            left, right = left.astype(np.uint16), right.astype(np.uint16)
            own = np.flatnonzero(new)
            own = own[np.lexsort((pos[own], key[own]))]
            out.records(anchor[own], anchor[own], hi[own], lo[own], key[own], pos[own], left[own], right[own], several[own])
            if several.any():
                own = np.flatnonzero(several)
                own = own[np.lexsort((pos[own], key[own]))]
                out.answers(key[own], pos[own], left[own], right[own], np.ones(len(own), np.uint8))
            yield out.batch()
        yield out.batch(last=True)

    def compare(anchor: np.ndarray, hi: np.ndarray, lo: np.ndarray, key: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((pos, key, lo, hi, anchor))
        anchor, hi, lo, key, pos, left, right, told = (x[order] for x in (anchor, hi, lo, key, pos, left, right, told))
        new = group_starts(anchor, hi, lo)
        count = np.diff(np.append(np.flatnonzero(new), len(new)))
        several = np.repeat(count > 1, count) | np.repeat(np.maximum.reduceat(told, np.flatnonzero(new)), count)
        wide = group_starts(anchor)
        contexts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(wide))
        mixed = np.repeat(contexts > 1, np.diff(np.append(np.flatnonzero(wide), len(wide))))
        # 1: a repeat from end to end; 2: its bytes are to be sorted; 4: it has a twin of its own
        act = (several & ~told) * 1 + (mixed & new) * 2 + several * 4
        ask = np.flatnonzero((act & 3) > 0)
        ask = ask[np.lexsort((pos[ask], key[ask]))]
        return key[ask], pos[ask], left[ask], right[ask], act[ask].astype(np.uint8)

    def by_key(held: list[tuple]) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(x[order] for x in columns)

    def fetch(ready: tuple[np.ndarray, ...], keys: np.ndarray, part: pa.RecordBatch, texts: list[bytes], out: Router) -> Iterator[pa.RecordBatch]:
        own_keys = np.unique(keys)
        a, b = np.searchsorted(ready[0], own_keys, "left"), np.searchsorted(ready[0], own_keys, "right")
        mine = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)])
        key, pos, left, right, act = (x[mine] for x in ready)
        whole = (act & 1) > 0
        pos, left, right = (x.astype(np.int64) for x in (pos, left, right))
        whole &= left + right >= length
        out.answers(key[whole], (pos - left)[whole].astype(np.int32), (pos + right)[whole].astype(np.int32))
        look = np.flatnonzero(((act & 2) > 0) & (left + right >= length))
        row = {k: i for i, k in enumerate(keys.tolist())}
        found: list[tuple] = []
        for k, p, x, y, twin in zip(key[look].tolist(), pos[look].tolist(), left[look].tolist(), right[look].tolist(), ((act[look] & 4) > 0).tolist(), strict=True):
            t = texts[row[k]][p - x : p + y]
            for j in range(PARTS):
                lo, hi = bounds[j], bounds[j + 1]
                lo_, hi_ = max(lo, length - y), min(hi, x + 1)  # the distances that this context has
                if lo_ < hi_:
                    start = x - hi_ + 1
                    found.append((xxhash.xxh3_64_intdigest(core_of(t, x, lo, hi, length), j), j, k, p - hi_ + 1, hi_ - 1, twin, t[start : x - lo_ + length]))
        if found:
            core, j, k, start, before, twin, pieces = zip(*found, strict=True)
            out.records(np.array(core, dtype=np.uint64), np.array(core, dtype=np.uint64), np.array(j, dtype=np.uint8), np.array(k, dtype=np.uint64), np.array(start, dtype=np.int32), np.array(before, dtype=np.uint16), np.array(twin), np.array(pieces, dtype=object))
        yield from ()

    def sort(core: np.ndarray, part: np.ndarray, key: np.ndarray, start: np.ndarray, before: np.ndarray, twin: np.ndarray, bytes_of: np.ndarray) -> tuple[np.ndarray, ...] | None:
        pieces, at, twin = bytes_of.tolist(), before.tolist(), twin.copy()
        order = np.lexsort((start, key, part, core))
        bounds_of = np.append(np.flatnonzero(group_starts(core[order], part[order])), len(order)).tolist()
        keys, starts, ends = [], [], []
        held: list[tuple[int, tuple[int, int]]] = []

        def solve() -> None:
            own, shift = np.array([i for i, _ in held]), np.array([a for _, (a, _) in held])
            groups_of = repeated_starts([pieces[i][a:b] for i, (a, b) in held], length)
            piece = np.repeat(np.arange(len(own)), [len(g) for g in groups_of])
            offset = np.concatenate([np.arange(len(g)) for g in groups_of])
            g = np.concatenate(groups_of)
            hit = g >= 0
            g, where = g[hit], offset[hit] + (shift + start[own])[piece[hit]]
            piece = own[piece[hit]]
            # one place of the corpus may lie in several pieces; a group needs two places, or one that has a twin
            o = np.lexsort((where, key[piece], g))
            g, piece, where = g[o], piece[o], where[o]
            new, own_place = group_starts(g), group_starts(g, key[piece], where)
            at_ = np.flatnonzero(new)
            if len(at_):
                size_of = np.diff(np.append(at_, len(g)))
                real = np.repeat((np.add.reduceat(own_place.astype(np.int64), at_) > 1) | np.maximum.reduceat(twin[piece], at_), size_of) & ~twin[piece]
                k, w = key[piece][real], where[real]
                o = np.lexsort((w, k))
                k, w = k[o], w[o]
                run = np.ones(len(k), bool)
                run[1:] = (k[1:] != k[:-1]) | (w[1:] > w[:-1] + 1)
                r = np.flatnonzero(run)
                keys.append(k[r])
                starts.append(w[r])
                ends.append(w[np.append(r[1:], len(w)) - 1] + length if len(r) else w[:0])
            held.clear()

        weight = 0
        for a, b in zip(bounds_of[:-1], bounds_of[1:], strict=True):
            if b - a < 2:
                continue
            # pieces that occur twice are repeats from end to end; one of them stays, for others to match
            equal: dict[bytes, list[int]] = {}
            for i in order[a:b].tolist():
                equal.setdefault(pieces[i], []).append(i)
            for same in equal.values():
                if len(same) > 1 and (twin[same].any() or len(set(zip(key[same].tolist(), start[same].tolist(), strict=True))) > 1):
                    own = np.array([i for i in same if not twin[i]], dtype=np.int64)
                    keys.append(key[own])
                    starts.append(start[own].astype(np.int64))
                    ends.append(start[own].astype(np.int64) + len(pieces[same[0]]))
                    twin[same[0]] = True
            members, j = [same[0] for same in equal.values()], int(part[order[a]])
            if len(members) < 2:
                continue
            # the distance of a piece's first window is the largest it has
            for own, cuts in sets_to_sort(members, pieces, at, bounds[j], bounds[j + 1], length):
                more = sum(y - x + 1 for x, y in cuts)
                if held and weight + more > SORT_BYTES - 2:
                    solve()
                    weight = 0
                held += zip(own, cuts, strict=True)
                weight += more
        if held:
            solve()
        if not keys:
            return None
        return np.concatenate(keys), np.concatenate(starts).astype(np.int32), np.concatenate(ends).astype(np.int32)

    found = meet_in_buckets(plain.mapInArrow(tidied(places), ROUTED_DDL), groups, compare)
    pieces = meet_documents(plain.drop("row_key"), key, found, groups, by_key, fetch, answered_only=True)
    return meet_in_buckets(pieces, groups, sort)


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """The documents with three more columns: kept_bytes (binary, what stays), n_removed and spans (array of start, end).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this document or
    another; strings are judged on the input and never cross documents, so every copy of a repeat goes.
    spans are the maximal removed ranges. Null text is empty. Ids are not looked at: null or repeated
    doc_ids and repeated rows are rows like others. No documents: no rows. Columns of ``docs`` named like
    the three new ones are replaced.
    """
    new = {"kept_bytes": T.BinaryType(), "n_removed": T.LongType(), "spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))}
    docs = docs.drop(*new)
    groups, key = groups_for(text_bytes(docs)), row_key(docs)
    marks = repeated_spans(docs, key, length, groups)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def sorted_marks(held: list[tuple]) -> tuple[np.ndarray, ...]:
        key, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        order = np.lexsort((lo, key))
        return key[order], lo[order], hi[order]

    def cut(ready: tuple[np.ndarray, ...], keys: np.ndarray, part: pa.RecordBatch, texts: list[bytes], _: Router) -> Iterator[pa.RecordBatch]:
        key, lo, hi = ready
        a, b = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
        kept, removed, spans = [], [], []
        for i, t in enumerate(texts):
            own: list[list[int]] = []
            for x, y in zip(lo[a[i] : b[i]].tolist(), hi[a[i] : b[i]].tolist(), strict=True):
                if own and x <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], y)
                else:
                    own.append([x, y])
            cuts = [0, *(v for s in own for v in s), len(t)]
            kept.append(b"".join([t[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)]))
            removed.append(len(t) - len(kept[-1]))
            spans.append([{"start": x, "end": y} for x, y in own])
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, span_type)], names=[*part.schema.names, *new])

    return meet_documents(docs, key, marks, groups, sorted_marks, cut, T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in new.items())]))
