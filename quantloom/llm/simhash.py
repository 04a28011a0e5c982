"""SimHash near-duplicate groups with pivot distance tables.

A table of Hamming distances to fixed reference fingerprints (the pivots) is computed once for every
distinct fingerprint and goes with it into its blocks. Two fingerprints at distance d differ by at most d in every coordinate, so a pair whose largest
coordinate difference exceeds the limit is discarded unseen; survivors are verified bit by bit.

Pairs meet in blocks. ``segments``: the fingerprint is cut in max_bits + 2 segments, of which a linked
pair agrees on at least two; every two segments are a block key, so no link is lost. ``shingles``: the
smallest ``n_keys`` shingle hashes are the keys, for wide limits that segments cannot serve; they find most
links, not all. A block of more than ``CHUNK`` fingerprints is compared chunk by chunk with chunk, each pair of chunks a
row of its own, and hands on only the links that join what was apart: no task gets a whole block and
no block becomes all its pairs.

``prefix`` links by the Jaccard likeness of the distinct shingles instead, without loss. Shingles have one
order (those common by counters over all texts last, then by hash); of n shingles the first n - ceil(similarity * n) + 1
are keys, so that two texts that are alike enough share one. Pairs that their sizes and the places of
their keys allow (and that did not share one of the two keys before, where they have met already) are screened by fingerprints of the distinct shingles, at a limit (``max_bits``) far
above the distance at that likeness, and survivors are verified on the shingles themselves. Blocks of
more than WINDOW + 1 texts first compare neighbours in size and in some hashed orders, then all that is
still apart. For that the rows of large blocks alone travel again, with a sketch of the shingles: a bit for each
remainder, 1 if an odd number of shingles has it. Two sketches differ in no more bits than their sets in shingles,
so a pair whose sketches differ in more than the likeness allows is none, and no row is made of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import checkpointed, chunks, free_name, keyed, mix, pack, tidied, unpack
from quantloom.llm.exchange import split_by
from quantloom.llm.graph import connected_components

N_PIVOTS = 32
CHUNK = 512
SEED = 42
#: Neighbours in size that a text of a prefix block is compared with before components are known.
WINDOW = 4
#: Further orders, by hashes, in which a text of a larger block is compared with its neighbour. Texts of one
#: group are then mostly in one component before all that is still apart is compared.
ORDERS = 8
#: Counters of shingles, by their leading bits, over all texts. Only the order of keys depends on them, no link does.
COUNTERS, COUNTER_SHIFT, SLICES = 1 << 20, np.uint64(44), 16
#: Keys of a text before one of its keys that go with it, as 31 bits each.
BEFORE = 2
#: Words of a text's sketch, and of its fold, which is compared first.
SKETCH_WORDS, FOLD_WORDS = 32, 8
#: Bits, by leading bits of keys, that tell the keys of large blocks. Keys that share a bit with one of these travel in vain.
KEY_BITS, KEY_SHIFT = 1 << 24, np.uint64(40)
#: Rows with a sketch that a task packs at once.
SKETCHED_ROWS = 1 << 16
#: Rows that are broadcast at most.
MOST_BROADCAST = 200_000


def shingle_hashes(text: bytes, n_words: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased word shingles, repeats included; fewer words: of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= n_words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n)) + np.arange(n)).tolist()
    starts = [0, *(e + 1 for e in ends[: n - n_words])]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[n_words - 1 :], strict=True)), dtype=np.uint64, count=n - n_words + 1)


def simhash(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit words; a bit is 1 if set in over half the hashes. Lane k > 0 scrambles the hashes anew."""
    out = np.zeros(lanes, np.uint64)
    for k in range(lanes if len(h) else 0):
        x, ones = (mix(h + np.uint64(k)) if k else h), np.zeros(64, np.int64)
        for i in range(0, len(x), 1 << 14):
            part = x[i : i + (1 << 14)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3, lanes: int = 1, n_keys: int = 0) -> DataFrame:
    """doc_id, row_key (hash of doc_id and text), fp (array<long> of ``lanes``), keys (array<long>, the ``n_keys`` smallest scrambled shingle hashes)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("fp", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            fps, keys = [], []
            for t in texts:
                h = shingle_hashes(t, shingle_words)
                fps.append(simhash(h, lanes).view(np.int64))
                keys.append(np.unique(mix(h))[:n_keys].view(np.int64) if n_keys else [])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(fps, schema.field(2).type), pa.array(keys, schema.field(3).type)], schema=schema)

    return keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(tidied(run), "doc_id long, row_key long, fp array<bigint>, keys array<bigint>")


def pivots(lanes: int) -> np.ndarray:
    return mix(np.arange(1, N_PIVOTS * lanes + 1, dtype=np.uint64)).reshape(N_PIVOTS, lanes)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint (rows) to every pivot (columns)."""
    return np.bitwise_count(fps[:, None, :] ^ refs[None, :, :]).sum(axis=2, dtype=np.int16)


def linked_pairs(ids: np.ndarray, fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links between two index sets (or within one) that join what no other one has joined yet.

    Only fingerprints that are still apart are compared, so a dense block costs little more than its size.
    """
    found: list[tuple[int, int]] = []
    label = np.arange(len(ids))
    within = left is right
    for n, i in enumerate(left):
        others = right[n + 1 :] if within else right
        others = others[label[others] != label[i]]
        if len(others):
            others = others[(np.abs(table[others] - table[i]) <= max_bits).all(axis=1)]
        if len(others):
            others = others[np.bitwise_count(fps[others] ^ fps[i]).sum(axis=1) <= max_bits]
        while len(others):
            found.append((int(ids[i]), int(ids[others[0]])))
            label[label == label[others[0]]] = label[i]
            others = others[label[others] != label[i]]
    return found


def with_tables(nodes: DataFrame, lanes: int) -> DataFrame:
    """``nodes`` (with fp) and their pivot distances (table array<smallint>)."""
    refs = pivots(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(pc.list_flatten(batch.column("fp"))).view(np.uint64).reshape(batch.num_rows, lanes)
            table = distance_table(fps, refs)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * N_PIVOTS, pa.int32()), pa.array(table.ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, "table"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(tidied(run), f"{ddl}, table array<smallint>")


def links(nodes: DataFrame, max_bits: int, lanes: int, blocking: str, keys_of: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect the nodes (id long, fp array<long>, table array<smallint>, one row per id) within ``max_bits``; ``keys_of`` (id, keys array<long>, rows of one id add up) serves blocking ``shingles``."""
    if blocking == "segments":
        n_seg = max_bits + 2
        cuts = [round(64 * lanes * k / n_seg) for k in range(n_seg + 1)]
        bits = F.concat(*[F.lpad(F.conv(F.hex(F.col("fp")[k]), 16, 2), 64, "0") for k in range(lanes)])
        seg = [F.substring(F.col("bits"), cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in range(n_seg)]
        keys = F.array(*[F.xxhash64(F.lit(n), seg[i], seg[j]) for n, (i, j) in enumerate(combinations(range(n_seg), 2))])
        with_keys = nodes.withColumn("bits", bits).select("id", "fp", "table", F.explode(keys).alias("key"))
    else:
        with_keys = nodes.select("id", "fp", "table").join(keys_of.select("id", F.explode("keys").alias("key")).distinct(), "id")
    counts = with_keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = with_keys.join(counts, "key").withColumn("n_chunks", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("n_chunks")).cast("int"))
    packed = members.groupBy("key", "n_chunks", "chunk").agg(F.collect_list(F.struct("id", "fp", "table")).alias("m"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("other")
    whole = packed.where("n_chunks = 1").select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.col("chunk"), "m")
    parts = packed.where("n_chunks > 1").select("key", "chunk", "m", other).select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "m")
    met = parts.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("chunk", "m")).alias("sides"))
    rows = whole.select("lo", "hi", F.array(F.struct("chunk", "m")).alias("sides")).unionAll(met.select("lo", "hi", "sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for lo, hi, sides in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "sides")), strict=True):
                if lo < hi and len(sides) < 2:
                    continue
                m = [(x["id"], x["fp"], s["chunk"], x["table"]) for s in sides for x in s["m"]]
                ids = np.array([x[0] for x in m], dtype=np.int64)
                fps = np.array([x[1] for x in m], dtype=np.int64).view(np.uint64).reshape(len(m), lanes)
                side = np.array([x[2] for x in m])
                left = np.flatnonzero(side == lo) if lo < hi else np.arange(len(m))
                right = np.flatnonzero(side == hi) if lo < hi else left
                for x, y in linked_pairs(ids, fps, np.array([x[3] for x in m], dtype=np.int16), left, right, max_bits):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(tidied(run), "a long, b long")


def shingle_set(text: bytes, n_words: int) -> np.ndarray:
    """The distinct shingles, as sorted scrambled hashes."""
    return np.unique(mix(shingle_hashes(text, n_words)))


def sketch(own: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the distinct shingles, 1 if an odd number of them has it."""
    bits = 64 * SKETCH_WORDS
    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray) -> np.ndarray:
    """The sketches (rows) that fewer remainders give."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, FOLD_WORDS), axis=1)


def sliced(whole: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([pack(x) for x in np.split(whole, SLICES)], pa.binary())], names=["slice", "blob"])


def gathered(parts: DataFrame, join: np.ufunc, dtype: type, size: int) -> np.ndarray:
    """One array of the tasks' own ones (slice, blob), joined slice by slice."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                own = unpack(blob)[0].astype(dtype)
                sums[k] = join(sums[k], own) if k in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(x) for x in sums.values()], pa.binary())], names=["slice", "blob"])

    out = np.zeros((SLICES, size // SLICES), dtype)
    for r in parts.repartition("slice").mapInArrow(tidied(add), "slice int, blob binary").collect():
        out[r["slice"]] = unpack(r["blob"])[0]
    return out.ravel()


def shingle_counts(docs: DataFrame, n_words: int) -> np.ndarray:
    """How many of all texts have a shingle whose leading bits are the index; a text counts once for each of its distinct shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for _, texts in chunks(batches):
            for t in texts:
                np.add.at(total, shingle_set(t, n_words) >> COUNTER_SHIFT, np.uint32(1))
        if total.any():
            yield sliced(total)

    return gathered(docs.select("text").mapInArrow(tidied(count), "slice int, blob binary"), np.add, np.int64, COUNTERS)


def key_bits(keys: DataFrame) -> np.ndarray:
    """Bytes with the bits of ``keys`` (a long)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(KEY_BITS, bool)
        for batch in batches:
            bits[np.asarray(batch.column("a")).view(np.uint64) >> KEY_SHIFT] = True
        if bits.any():
            yield sliced(np.packbits(bits, bitorder="little"))

    return gathered(keys.select("a").mapInArrow(tidied(mark), "slice int, blob binary"), np.bitwise_or, np.uint8, KEY_BITS // 8)


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> KEY_SHIFT).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def hot_counts(counts: np.ndarray) -> np.ndarray:
    """The counts that stand out, which put a shingle behind all others; else 0."""
    return np.where(counts >= 20 + 4 * counts.mean(), counts, 0)


def prefix(own: np.ndarray, hot: np.ndarray, similarity: float) -> np.ndarray:
    """The keys of a sorted shingle set, in the order of all sets: by ``hot_counts``, then by hash."""
    n = len(own)
    if not n:
        return own
    own = own[np.argsort(hot[own >> COUNTER_SHIFT], kind="stable")]
    return own[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def shingled(docs: DataFrame, n_words: int, lanes: int, similarity: float) -> DataFrame:
    """doc_id, row_key, id (hash of the distinct shingles), n (their number), fp (their fingerprint), sketch, keys (their prefix)."""
    hot = hot_counts(shingle_counts(docs, n_words))
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("fp", pa.list_(pa.int64())), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            sets = [shingle_set(t, n_words) for t in texts]
            ids = np.array([xxhash.xxh64_intdigest(u.tobytes(), SEED) for u in sets], dtype=np.uint64).view(np.int64)
            fps = [simhash(u, lanes).view(np.int64) for u in sets]
            keys = [prefix(u, hot, similarity).view(np.int64) for u in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(ids), pa.array([len(u) for u in sets], pa.int64()), pa.array(fps, schema.field(4).type), pa.array([sketch(u).tobytes() for u in sets], pa.binary()), pa.array(keys, schema.field(6).type)], schema=schema)

    return keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(tidied(run), "doc_id long, row_key long, id long, n long, fp array<bigint>, sketch binary, keys array<bigint>")


def _meet(key: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, before: np.ndarray, similarity: float, apart: bool, sketches: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Candidates among rows that share a key: neighbours in size or, ``apart``, all of large blocks that have other components and like ``sketches``; and the keys of large blocks."""
    order = np.lexsort((ids, n, key))
    key, ids, n, at, comp, before = key[order], ids[order], n[order], at[order], comp[order], before[order]
    if sketches is not None:
        sketches = sketches[order]
        folds = folded(sketches)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        # no more shingles than those from the first shared key on can be shared
        ok = (np.minimum(n[i] - at[i], n[j] - at[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6) & (comp[i] != comp[j])
        if (i := i[ok]).size:
            j = j[ok]
            # texts that share a key before this one meet there
            new = ~((before[i][:, :, None] == before[j][:, None, :]) & (before[i] != 0)[:, :, None]).any(axis=(1, 2))
            i, j = i[new], j[new]
            for s in (folds, sketches) if sketches is not None else ():
                # the sets of a pair that is alike differ in no more shingles
                near = np.bitwise_count(s[i] ^ s[j]).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-6
                i, j = i[near], j[near]
            a.append(np.minimum(ids[i], ids[j]))
            b.append(np.maximum(ids[i], ids[j]))

    if apart:
        for s, m in zip(starts[sizes > WINDOW + 1].tolist(), sizes[sizes > WINDOW + 1].tolist(), strict=True):
            for i in range(s, s + m - 1 if (comp[s : s + m] != comp[s]).any() else s):
                stop = s + int(np.searchsorted(n[s : s + m], n[i] / similarity + 1e-6, side="right"))
                keep(np.full(max(stop - i - 1, 0), i), np.arange(i + 1, stop))
    else:
        left = (np.repeat(starts + sizes, sizes) - np.arange(len(key))) - 1  # rows after each in its block
        for d in range(1, WINDOW + 1):
            i = np.flatnonzero(left >= d)
            keep(i, i + d)
        rows = np.flatnonzero(np.repeat(sizes > WINDOW + 1, sizes))
        for k in range(ORDERS if len(rows) else 0):
            mixed = rows[np.lexsort((mix(ids[rows].view(np.uint64) + np.uint64(k + 1)), key[rows]))]
            together = np.flatnonzero(key[mixed[1:]] == key[mixed[:-1]])
            i, j = mixed[together], mixed[together + 1]
            keep(np.minimum(i, j), np.maximum(i, j))
    return a, b, key[starts[sizes > WINDOW + 1]]


def candidates(nodes: DataFrame, similarity: float, buckets: int, large: np.ndarray | None = None) -> DataFrame:
    """(a, b), a < b: pairs of nodes (id, n, keys, comp) that may be alike, and a row of a = b for each key of a large block.

    With ``large`` (bits of the keys of large blocks) those of large blocks that are still apart, by their ``sketch``.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            sizes = np.asarray(pc.list_value_length(keys)).astype(np.int64)
            flat = np.asarray(pc.list_flatten(keys)).view(np.uint64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids, n, comp = (np.asarray(batch.column(c)) for c in ("id", "n", "comp"))
            # 0 stands for none; a component that is the text itself takes no room
            low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
            before = [np.where(at >= k, np.roll(low, k), 0).astype(np.uint32) for k in range(1, BEFORE + 1)]
            go = [np.arange(len(flat))]
            if large is not None:
                own = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
                wanted = np.flatnonzero(has_bit(large, flat))
                go = np.split(wanted, range(SKETCHED_ROWS, len(wanted), SKETCHED_ROWS))
            for g in go:
                more = () if large is None else (own[row[g]],)
                cuts = list(split_by((flat[g] % np.uint64(buckets)).astype(np.int32), flat[g], ids[row[g]], n[row[g]].astype(np.int32), at[g].astype(np.int32), (comp ^ ids)[row[g]], *(x[g] for x in before), *more))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in cuts], pa.int32()), pa.array([pack(*cut) for _, cut in cuts], pa.binary())], names=["bucket", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                key, ids, n, at, comp, *more = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                apart = large is not None
                a, b, many = _meet(key, ids, n, at, comp ^ ids, np.stack(more[:BEFORE], axis=1), similarity, apart, more[BEFORE] if apart else None)
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
                if not apart:
                    pairs = np.concatenate([pairs, np.stack([many, many], axis=1).view(np.int64)])
                for i in range(0, len(pairs), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000, c]) for c in (0, 1)], names=["a", "b"])

        for batch in batches:
            for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k != bucket:
                    yield from flush()
                    bucket = k
                held.append(unpack(blob))
        yield from flush()

    rows = nodes.select("id", "n", "comp", "keys", *(["sketch"] if large is not None else [])).mapInArrow(tidied(route), "bucket int, blob binary")
    return checkpointed(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(meet), "a long, b long").distinct())


def alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n_words: int, lanes: int, max_bits: int, similarity: float) -> DataFrame:
    """The pairs whose fingerprints are within ``max_bits`` and whose distinct shingles have a Jaccard likeness of ``similarity`` or more."""
    fps = nodes.select("id", "fp", "table")
    both = pairs.where("a <> b").join(fps.select(F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("table").alias("ta")), "a").join(fps.select(F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("table").alias("tb")), "b")
    if max_bits < 64 * lanes:
        apart = F.exists(F.zip_with("ta", "tb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), lambda x: x > max_bits)
        both = both.where(~apart)
    distance = sum((F.bit_count(F.col("fa")[k].bitwiseXOR(F.col("fb")[k])) for k in range(lanes)), F.lit(0))
    near = checkpointed(both.where(distance <= max_bits).select("a", "b"))
    wanted = near.select(F.col("a").alias("id")).distinct().union(near.select(F.col("b").alias("id")).distinct()).distinct()
    reps = checkpointed(nodes.join(wanted, "id").select(F.col("rep").alias("row_key"), "id"))
    texts = keyed(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))).join(F.broadcast(reps) if reps.count() <= MOST_BROADCAST else reps, "row_key").select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts_ in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingle_set(t, n_words).tobytes() for t in texts_], pa.binary())], names=["id", "own"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                shared = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(shared >= similarity * (len(u) + len(v) - shared) - 1e-9)
            out = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])

    own = texts.mapInArrow(tidied(sets), "id long, own binary").groupBy("id").agg(F.min("own").alias("own"))
    met = near.join(own.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    return checkpointed(met.select("a", "b", "x", "y").mapInArrow(tidied(verify), "a long, b long"))


def alike_documents(docs: DataFrame, shingle_words: int, lanes: int, max_bits: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of documents (doc_id, row_key, fp, id), nodes (id, first_doc) and components of nodes, by likeness of the distinct shingles."""
    fps = checkpointed(shingled(docs, shingle_words, lanes, similarity))
    nodes = checkpointed(with_tables(fps.groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.min("row_key").alias("rep"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys")), lanes))
    n_keys = nodes.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(12, n_keys >> 18)
    how = (shingle_words, lanes, max_bits, similarity)
    pairs = candidates(nodes.withColumn("comp", F.col("id")), similarity, buckets)
    found = alike(docs, nodes, pairs, *how)
    comps = connected_components(found)
    large = key_bits(pairs.where("a = b"))
    if large.any():
        named = nodes.join(comps, nodes.id == comps.node, "left").withColumn("comp", F.coalesce("component", "id"))
        comps = connected_components(found.unionAll(alike(docs, nodes, candidates(named, similarity, buckets, large), *how)))
    return fps, nodes, comps


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, lanes: int = 1, blocking: str = "segments", n_keys: int = 0, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, row_key, fp, component (a fingerprint's hash), component_id (smallest doc_id reachable over links, itself included).

    Documents with equal fingerprints are one node of the graph, so copies cost a single row. Texts that
    are null or without words have fingerprint zero and link like any other (with blocking ``shingles``
    they have no keys and link only with each other). Null doc_ids are kept as rows and never named as a
    component unless the whole component has none (then null). Repeated rows and repeated ids keep their
    rows. No documents: no rows. Extra columns are ignored.

    With blocking ``prefix`` a node is a set of distinct shingles, and a link a Jaccard likeness of
    ``similarity`` or more; fp is the fingerprint of the distinct shingles.
    """
    if blocking == "prefix":
        return _named(*alike_documents(docs, shingle_words, lanes, max_bits, similarity))
    fps = checkpointed(fingerprints(docs, shingle_words, lanes, n_keys if blocking == "shingles" else 0).withColumn("id", F.xxhash64("fp") if lanes > 1 else F.col("fp")[0]))
    nodes = fps.groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.min("fp").alias("fp"))
    nodes = checkpointed(with_tables(nodes, lanes))
    return _named(fps, nodes, connected_components(links(nodes, max_bits, lanes, blocking, fps)))


def _named(fps: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    named = nodes.join(comps, nodes.id == comps.node, "left").select("id", F.coalesce("component", "id").alias("component"), "first_doc")
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_fp = named.join(smallest, "component").select("id", "component", "component_id")
    return fps.join(by_fp, "id").select("doc_id", "row_key", "fp", "component", "component_id")


def keep_one(docs: DataFrame, **how: object) -> DataFrame:
    """``docs`` without all but one row of every group of near duplicates: that of the smallest doc_id (null: largest), then of the least row_key.

    Rows that repeat in doc_id and text are one document and stay once. Columns are those of ``docs``.
    """
    rows = near_duplicates(docs, **how).groupBy("component", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "copies")).alias("w")
    winners = checkpointed(rows.groupBy("component").agg(first).select(F.col("w.doc_id").alias("__win_id"), F.col("w.row_key").alias("__win_key"), "w.copies"))
    name = free_name(docs)
    keys = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    own = lambda w: (keys[name] == w["__win_key"]) & keys["doc_id"].cast("long").eqNullSafe(w["__win_id"])
    once, repeated = winners.where("copies = 1"), winners.where("copies > 1")
    kept = keys.join(once, own(once), "left_semi")
    if not repeated.isEmpty():
        kept = kept.unionByName(keys.join(repeated, own(repeated), "left_semi").dropDuplicates(["doc_id", name]))
    return kept.select(*docs.columns)
