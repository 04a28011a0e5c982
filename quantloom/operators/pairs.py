"""Sums over pairs of samples, from packed rows of features.

A feature's values over all samples are one vector. Each task adds up matrix products of blocks of such
vectors and hands on one row per pair of samples, so that no row per feature and pair is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features whose vectors are multiplied at once.
BLOCK = 2048
#: Tasks that add up pairs at most; each gives a row per pair.
TASKS = 64


def vectors(df: DataFrame, key: str | list[str], sample: str, value: str) -> tuple[list, DataFrame]:
    """Sample names in order, and a row per feature: ``keys``..., v array<double> over the samples, null where there is no value."""
    keys = [key] if isinstance(key, str) else key
    x = df.where(F.col(value).isNotNull()).groupBy(*keys, sample).agg(F.avg(value).alias("__x"))
    names = sorted(r[0] for r in x.select(sample).distinct().collect())
    packed = x.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(sample, "__x"))).alias("__m"))
    return names, packed.select(*keys, F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.try_element_at(F.col("__m"), n)).alias("v"))


def pair_sums(packed: DataFrame, size: int) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) over features that samples i and j, i <= j, both have; from rows with v array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, size, size))
        for batch in batches:
            flat = batch.column("v").flatten()
            for a in range(0, batch.num_rows, BLOCK):
                part = flat.slice(a * size, min(BLOCK, batch.num_rows - a) * size)
                x = np.asarray(part.fill_null(0.0)).reshape(-1, size)
                has = np.asarray(part.is_valid()).reshape(-1, size).astype(float)
                total += np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
        i, j = np.nonzero(np.triu(total[0] > 0))
        n, s, q, xy = total
        columns = (i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], xy[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.float64()) for k, c in enumerate(columns)], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = packed.select("v").coalesce(TASKS).mapInArrow(run, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
