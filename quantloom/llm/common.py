"""Helpers shared by the text operators.

Words are runs of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text; ``bytes.split()`` and
``bytes.lower()`` do exactly that and fold only A-Z.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.checkpoints import checkpoint_dir, checkpointed, discard  # noqa: F401

#: Bytes of text worked on at once by a Python task; bounds its memory, not the data.
CHUNK_BYTES = 4 << 20
#: Bytes of text whose intermediate records meet in one bucket or group of documents.
BUCKET_BYTES = 48 << 20

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_LIBC = ctypes.CDLL(None)

WORD_CHARS = r"[^\x20\x09-\x0D]+"


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def groups_for(n_bytes: int) -> int:
    """Buckets of ``BUCKET_BYTES`` at most; small inputs get up to 100 smaller ones, for parallelism."""
    return max(1, -(-n_bytes // BUCKET_BYTES), min(100, n_bytes >> 20))


def ids_are_keys(docs: DataFrame) -> bool:
    """Whether doc_id is unique and never null."""
    repeated = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    return repeated.isEmpty()


def row_key(docs: DataFrame, unique: bool | None = None) -> Column:
    """What tells the rows of ``docs`` apart, as a long: doc_id if it is unique and never null, else a 64-bit hash of doc_id and text."""
    unique = ids_are_keys(docs) if unique is None else unique
    return F.col("doc_id").cast("long") if unique else F.xxhash64(F.col("doc_id").cast("long"), "text")


def free_name(docs: DataFrame, name: str = "__row_key") -> str:
    """``name``, with more underscores if ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Adds ``row_key``: by itself a hash of doc_id and text, so that repeated ids with other texts stay apart."""
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text") if key is None else key)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidied(run: Run) -> Run:
    """``run`` (from batches to batches), with its memory given back at the end of each task."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def byte_column(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text, with the texts (null: empty)."""
    for batch in batches:
        col = batch.column(text)
        sizes = np.array([n or 0 for n in pc.binary_length(col.cast(pa.binary())).to_pylist()], dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [t or b"" for t in byte_column(part.column(text))]
            start = stop


def pack(*arrays: object) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def record_batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in ((f.name, columns[f.name]) for f in schema)], schema=schema)


class WordHashes(dict):
    """XXH64 of words, remembered; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
