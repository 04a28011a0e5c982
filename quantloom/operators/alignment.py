"""Hierarchical alignment of samples, and of the ions of a protein, on log2 intensities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom import schema as S
from quantloom.operators.quantify import Columns


def pair_statistics(df: DataFrame, feature: str | list[str], sample: str, value: str) -> DataFrame:
    """(a, b, n, median_a, median_b, var_a, var_b, min and max of both) of every two samples over the features that both have."""
    f = [feature] if isinstance(feature, str) else feature
    x = df.where(F.col(value).isNotNull())
    a, b = x.select(*f, F.col(sample).alias("a"), F.col(value).alias("xa")), x.select(*f, F.col(sample).alias("b"), F.col(value).alias("xb"))
    per = [g(f"x{s}").alias(f"{n}_{s}") for s in "ab" for n, g in (("median", F.median), ("var", F.var_pop), ("min", F.min), ("max", F.max))]
    return a.join(b, f).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *per)


def distance(stats: DataFrame, metric: S.Distance = S.Distance.MEDIAN, min_overlap: int = 10) -> DataFrame:
    """(a, b, d); null where fewer than ``min_overlap`` features are shared."""
    if metric is S.Distance.MEDIAN:
        d = F.abs(F.col("median_a") - F.col("median_b"))
    elif metric is S.Distance.VARIANCE:
        d = F.abs(F.col("var_a") - F.col("var_b"))
    else:
        shared = F.greatest(F.least("max_a", "max_b") - F.greatest("min_a", "min_b"), F.lit(0.0))
        whole = F.greatest("max_a", "max_b") - F.least("min_a", "min_b")
        d = F.when(whole > 0, 1 - F.try_divide(shared, whole)).otherwise(0.0)
    return stats.select("a", "b", F.when(F.col("n") >= min_overlap, d).alias("d"))


def leaf_order(d: np.ndarray) -> list[int]:
    """Leaves of an average-linkage tree, left to right; the nearest two join first, of several the first."""
    n = len(d)
    finite = d[np.isfinite(d)]
    d = np.where(np.isfinite(d), d, 10 * (finite.max() if len(finite) and finite.max() > 0 else 1.0)).astype(float)
    np.fill_diagonal(d, np.inf)
    members = {i: [i] for i in range(n)}
    while len(members) > 1:
        ids = sorted(members)
        sub = d[np.ix_(ids, ids)]
        i, j = divmod(int(sub.argmin()), len(ids))
        i, j = ids[min(i, j)], ids[max(i, j)]
        wi, wj = len(members[i]), len(members[j])
        for k in ids:
            if k not in (i, j):
                d[i, k] = d[k, i] = (wi * d[i, k] + wj * d[j, k]) / (wi + wj)
        members[i] += members.pop(j)
    return next(iter(members.values())) if members else []


def shifts(diff: np.ndarray, n: np.ndarray, d: np.ndarray, quadratic: bool, min_overlap: int) -> np.ndarray:
    """What to add to each sample. diff[i, j]: median of i minus median of j over the shared features.

    Linear: along the leaf order each sample is brought to the one before. Quadratic: least squares over all
    pairs, weighted by the root of the overlap, the first leaf fixed.
    """
    size = len(diff)
    out = np.zeros(size)
    off = ~np.eye(size, dtype=bool)
    if size < 2 or not (np.isfinite(d) & off).any():
        return out
    order = leaf_order(d) if size > 2 else [0, 1]
    if quadratic and size > 2:
        i, j = np.where(np.triu(off & (n >= min_overlap)))
        if len(i):
            w = np.sqrt(n[i, j])
            a = np.zeros((len(i), size))
            a[np.arange(len(i)), j], a[np.arange(len(i)), i] = w, -w
            free = [k for k in range(size) if k != order[0]]
            out[free] = np.linalg.lstsq(a[:, free], w * diff[i, j], rcond=None)[0]
            return out
    for p, c in zip(order, order[1:], strict=False):
        out[c] = out[p] + (diff[p, c] if n[p, c] >= min_overlap else 0.0)
    return out


def sample_shifts(df: DataFrame, feature: str | list[str], sample: str, value: str, metric: S.Distance = S.Distance.MEDIAN, num_samples_quadratic: int = 50, min_overlap: int = 10) -> DataFrame:
    """(sample, shift). Spark reduces each pair of samples to a row; the solver works on a matrix of samples on the driver."""
    names = sorted(r[0] for r in df.select(sample).distinct().collect())
    if not names:
        raise ValueError("no samples")
    stats = pair_statistics(df, feature, sample, value)
    rows = stats.join(distance(stats, metric, min_overlap), ["a", "b"]).select("a", "b", "n", "median_a", "median_b", "d").collect() if len(names) > 1 else []
    at, k = {s: i for i, s in enumerate(names)}, len(names)
    diff, n, d = np.zeros((k, k)), np.zeros((k, k)), np.full((k, k), np.inf)
    for r in rows:
        i, j = at[r["a"]], at[r["b"]]
        diff[i, j], diff[j, i] = r["median_a"] - r["median_b"], r["median_b"] - r["median_a"]
        n[i, j] = n[j, i] = r["n"]
        d[i, j] = d[j, i] = np.inf if r["d"] is None else r["d"]
    found = shifts(diff, n, d, k <= num_samples_quadratic, min_overlap)
    return df.sparkSession.createDataFrame([(s, float(v)) for s, v in zip(names, found, strict=True)], f"`{sample}` {df.schema[sample].dataType.simpleString()}, shift double")


def align_samples(df: DataFrame, feature: str | list[str], sample: str, value: str, selected: DataFrame | None = None, **how: object) -> DataFrame:
    """Values (log2) with their sample's shift added; the shifts come from ``selected`` proteins only, if given."""
    base = df.join(selected, selected.columns, "left_semi") if selected is not None else df
    if base.isEmpty():
        raise ValueError("no rows to fit on")
    found = F.broadcast(sample_shifts(base, feature, sample, value, **how))
    return df.join(found, sample).withColumn(value, F.col(value) + F.col("shift")).select(*df.columns)


def _matrix_shifts(m: np.ndarray, quadratic_up_to: int, min_overlap: int) -> np.ndarray:
    """Shifts of the rows of a matrix with gaps."""
    k = len(m)
    diff, n, d = np.zeros((k, k)), np.zeros((k, k)), np.full((k, k), np.inf)
    for i in range(k):
        for j in range(i + 1, k):
            both = np.isfinite(m[i]) & np.isfinite(m[j])
            n[i, j] = n[j, i] = both.sum()
            if both.sum() >= min_overlap:
                diff[i, j] = np.median(m[i][both]) - np.median(m[j][both])
                diff[j, i] = -diff[i, j]
                d[i, j] = d[j, i] = abs(diff[i, j])
    return shifts(diff, n, d, k <= quadratic_up_to, min_overlap)


def align_ions(df: DataFrame, protein: str, ion: str, sample: str, value: str, num_samples_quadratic: int = 10, min_overlap: int = 3) -> DataFrame:
    """Values (log2) with every ion of a protein shifted onto the others; a protein with one ion stays. One protein is one group."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=ion, columns=sample, values=value, aggfunc="mean")
        if len(m) > 1:
            move = pd.Series(_matrix_shifts(m.to_numpy(), num_samples_quadratic, min_overlap), index=m.index)
            pdf = pdf.assign(**{value: pdf[value] + pdf[ion].map(move)})
        return pdf

    cols = df.select(protein, ion, sample, value)
    return cols.groupBy(protein).applyInPandas(solve, cols.schema)


def aligned_ions(df: DataFrame, c: Columns = Columns(), normalize: bool = True) -> DataFrame:
    """(protein, peptide, sample, x, lx): summed intensities, and their log2 after sample and ion alignment."""
    rows = df.where(F.col(c.intensity) > 0).groupBy(c.protein, c.peptide, c.sample).agg(F.sum(c.intensity).alias("x")).withColumn("lx", F.log2("x"))
    if normalize:
        rows = align_samples(rows, [c.protein, c.peptide], c.sample, "lx")
    linear = rows.select(c.protein, c.peptide, c.sample, F.pow(F.lit(2.0), "lx").alias("x"))
    return align_ions(rows, c.protein, c.peptide, c.sample, "lx").join(linear, [c.protein, c.peptide, c.sample])


def quantify_directlfq(df: DataFrame, min_nonan: int = 1, c: Columns = Columns(), normalize: bool = True) -> DataFrame:
    """Direct quantification after sample and ion alignment: medians of aligned ions, scaled to the protein's total.

    Follows the published description; another implementation's numbers differ in detail.
    """
    ions = aligned_ions(df, c, normalize)
    med = ions.groupBy(c.protein, c.sample).agg(F.median("lx").alias("a"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    total = med.groupBy(c.protein).agg(F.sum("s").alias("t"))
    lin = med.where(F.col("n") >= min_nonan).withColumn("lin", F.pow(F.lit(2.0), "a"))
    whole = lin.groupBy(c.protein).agg(F.sum("lin").alias("w"))
    return lin.join(whole, c.protein).join(total, c.protein).select(c.protein, c.sample, (F.col("lin") * F.col("t") / F.col("w")).alias("DirectLFQIntensity"))
