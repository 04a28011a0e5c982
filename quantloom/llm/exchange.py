"""Packed exchanges between documents and buckets.

Occurrence records (names, hashes, positions) travel as arrays packed per bucket instead of a row each.
A bucket sees at most one record of a name from each chunk of documents, however often the name occurs:
what a chunk knows by itself is answered in the chunk. Answers are addressed to ``group``, which follows
from a document's row_key, and meet its documents there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import CHUNK_BYTES, chunks, free_name, mix, pack, tidied, unpack

#: kind 0: records for the bucket; kind 1: answers for ``grp`` that only pass through.
ROUTED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("grp", pa.int32()), ("blob", pa.binary())])
ROUTED_DDL = "bucket int, kind int, grp int, blob binary"
#: Bytes of records, or of documents, that a task holds before it cuts them up by bucket or group. Blobs then
#: shrink with the number of groups only as far as this over that number, whatever the size of a chunk.
HOLD_BYTES = 12 << 20
ANSWERS = pa.schema([("grp", pa.int32()), ("blob", pa.binary())])
ANSWERS_DDL = "grp int, blob binary"


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def grouped(docs: DataFrame, groups: int, key: Column) -> DataFrame:
    """(grp, kind 1, blob): the documents of each group as compressed Arrow tables, with their key last."""
    docs = docs.withColumn(free_name(docs), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        held: list[pa.RecordBatch] = []
        weight = 0

        def cut() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            grp = group_of(np.asarray(part.column(part.num_columns - 1)), groups)
            order = np.argsort(grp, kind="stable")
            part, grp = part.take(pa.array(order)), grp[order]
            starts = np.flatnonzero(group_starts(grp))
            blobs = []
            for a, b in zip(starts, [*starts[1:], len(grp)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=how) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in part.columns], schema=part.schema))
                blobs.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(grp[starts], pa.int32()), pa.array(np.ones(len(starts)), pa.int32()), pa.array(blobs, pa.binary())], names=["grp", "kind", "blob"])

        for part, texts in chunks(batches):
            held.append(part)
            weight += sum(map(len, texts))
            if weight >= HOLD_BYTES:
                yield cut()
                weight = 0
        if held:
            yield cut()

    return docs.mapInArrow(tidied(run), "grp int, kind int, blob binary")


def same_order(blob: str) -> tuple[Column, ...]:
    """Sort keys that put packed rows in one order whenever a task runs again.

    Rows of a shuffle arrive in any order, and what a chunk answers by itself depends on what is in it. A
    task that is run anew after a loss must not split the answers otherwise than the one before.
    """
    return F.xxhash64(blob), F.octet_length(blob)


def split_by(which: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The arrays cut by the value of ``which``, in stable order."""
    if not len(which):
        return
    order = np.argsort(which, kind="stable")
    w = which[order]
    cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(w)], strict=True):
        yield int(w[a]), tuple(x[order[a:b]] for x in arrays)


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each element is the first with its keys, of arrays sorted by them."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return new


class Held:
    """Arrays on their way to numbered places, held until ``HOLD_BYTES`` are there and then packed place by place."""

    def __init__(self) -> None:
        self.waiting: dict[object, list[tuple[np.ndarray, ...]]] = {}
        self.weight = 0

    def add(self, kind: object, place: np.ndarray, arrays: tuple[np.ndarray, ...]) -> None:
        if len(place):
            self.waiting.setdefault((kind, len(arrays)), []).append((place, *arrays))
            self.weight += sum(a.nbytes if a.dtype != object else sum(map(len, a)) for a in arrays)

    def flush(self, last: bool) -> Iterator[tuple[object, int, bytes]]:
        if last or self.weight >= HOLD_BYTES:
            for (kind, _), parts in self.waiting.items():
                place, *arrays = (np.concatenate(x) for x in zip(*parts, strict=True))
                for p, cut in split_by(place, *arrays):
                    yield kind, p, pack(*cut)
            self.waiting.clear()
            self.weight = 0


class Router:
    """Gathers routed rows of a task. Each kind of record, or of answer, has its own number of arrays."""

    def __init__(self, buckets: int, groups: int):
        self.buckets, self.groups = buckets, groups
        self.held = Held()
        self.rows: list[tuple[int, int, int, bytes]] = []

    def records(self, name: np.ndarray, *arrays: np.ndarray, kind: int = 0) -> None:
        """Records for the bucket of ``name``, which is not sent by itself. In the order given, so that like neighbours compress."""
        self.held.add(kind, (name % np.uint64(self.buckets)).astype(np.int32), arrays)

    def answers(self, key: np.ndarray, *arrays: np.ndarray) -> None:
        self.held.add(1, group_of(key, self.groups), (key, *arrays))

    def batch(self, last: bool = False) -> pa.RecordBatch:
        self.rows += [(p % self.buckets, kind, p if kind == 1 else 0, blob) for kind, p, blob in self.held.flush(last)]
        cols = list(zip(*self.rows, strict=True)) or [[], [], [], []]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ROUTED, strict=True)], schema=ROUTED)


Solve = Callable[..., tuple[np.ndarray, ...] | None]


def meet_in_buckets(routed: DataFrame, groups: int, solve: Solve, others: dict[int, Solve] | None = None) -> DataFrame:
    """Brings the records of each bucket together. ``solve`` gets the arrays, joined over chunks, and returns (key, ...) of its answers; ``others`` do so for records of other kinds."""
    how = {0: solve, **(others or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict[int, list[tuple]] = {}
        out = Held()
        at = None

        def work() -> None:
            for kind in sorted(here):
                found = how[kind](*(np.concatenate(x) for x in zip(*here[kind], strict=True)))
                if found is not None:
                    out.add(0, group_of(found[0], groups), found)
            here.clear()

        def answers(last: bool) -> Iterator[pa.RecordBatch]:
            rows = [(g, blob) for _, g, blob in out.flush(last)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ANSWERS, strict=True)], schema=ANSWERS)

        for batch in batches:
            passed = batch.filter(pc.equal(batch.column("kind"), 1))
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([passed.column("grp"), passed.column("blob")], schema=ANSWERS)
            rest = batch.filter(pc.not_equal(batch.column("kind"), 1))
            for b, kind, blob in zip(*(rest.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True):
                if b != at:
                    work()
                    yield from answers(False)
                    at = b
                here.setdefault(kind, []).append(unpack(blob))
        work()
        yield from answers(True)

    return routed.repartition("bucket").sortWithinPartitions("bucket", *same_order("blob")).mapInArrow(tidied(run), ANSWERS_DDL)


def meet_documents(docs: DataFrame, key: Column, answers: DataFrame, groups: int, prepare: Callable[[list[tuple]], object], work: Callable[..., Iterable[pa.RecordBatch]], ddl: str = ROUTED_DDL, answered_only: bool = False) -> DataFrame:
    """Brings answers and documents of each group together.

    ``prepare`` gets all answers of a group, once; ``work(prepared, keys, documents, texts, router)`` is then
    called for one chunk of its documents after another. What it gives to the router follows its own batches.
    """
    replies = answers.select("grp", F.lit(0).alias("kind"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting: list[pa.RecordBatch] = []
        out = Router(groups, groups)
        at, size, ready = None, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, ready
            if waiting:
                if ready is None:
                    ready = (prepare(held),)
                for part, texts in chunks(pa.Table.from_batches(waiting).combine_chunks().to_batches()):
                    own = part.num_columns - 1
                    yield from work(ready[0], np.asarray(part.column(own)).view(np.uint64), part.select(list(range(own))), texts, out)
            waiting.clear()
            size = 0
            if out.held.weight:
                yield out.batch()

        for batch in batches:
            for grp, kind, blob in zip(*(batch.column(c) for c in ("grp", "kind", "blob")), strict=True):
                grp, kind = grp.as_py(), kind.as_py()
                if grp != at:
                    yield from flush()
                    held, at, ready = [], grp, None
                if kind == 0:
                    held.append(unpack(blob.as_buffer()))
                    continue
                if answered_only and not held:
                    continue
                with pa.ipc.open_stream(blob.as_buffer()) as table:
                    waiting += list(table)
                size += waiting[-1].nbytes
                if size > CHUNK_BYTES:
                    yield from flush()
        yield from flush()
        if out.held.weight:
            yield out.batch(last=True)

    return grouped(docs, groups, key).unionByName(replies).repartition("grp").sortWithinPartitions("grp", "kind", *same_order("blob")).mapInArrow(tidied(run), ddl)
