"""Protein quantities from peptide intensities: sums, medians, top N, MaxLFQ."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom import schema as S
from quantloom.functions.expressions import ratio


@dataclass(frozen=True)
class Columns:
    protein: str = S.PROTEIN
    peptide: str = S.PEPTIDE
    intensity: str = S.NORM
    sample: str = S.SAMPLE
    run: str | None = None

    @property
    def unit(self) -> list[str]:
        return [self.sample, *([self.run] if self.run else [])]

    @property
    def keys(self) -> list[str]:
        return [self.protein, *self.unit]


SUMMARIES: dict[S.Summarization, Callable[[str], Column]] = {S.Summarization.MEDIAN: F.median, S.Summarization.MEAN: F.avg, S.Summarization.SUM: F.sum, S.Summarization.MAX: F.max}


def summarize(df: DataFrame, method: S.Summarization, c: Columns = Columns(), name: str | None = None) -> DataFrame:
    return df.groupBy(*c.keys).agg(SUMMARIES[method](c.intensity).alias(name or f"{method.value.capitalize()}Intensity"))


def quantify_sum(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    return summarize(df, S.Summarization.SUM, c, "SumIntensity")


def quantify_median(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    return summarize(df, S.Summarization.MEDIAN, c, "MedianIntensity")


def quantify_topn(df: DataFrame, n: int = 3, c: Columns = Columns()) -> DataFrame:
    """The mean of the ``n`` largest rows; of fewer, of those there are. The limit per group is applied before the shuffle, too."""
    w = Window.partitionBy(*c.keys).orderBy(F.col(c.intensity).desc_nulls_last())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).groupBy(*c.keys).agg(F.avg(c.intensity).alias(f"Top{n}Intensity"))


def quantify_maxlfq(df: DataFrame, min_peptides: int = 2, c: Columns = Columns()) -> DataFrame:
    """Trace-aligned quantities, as one relational plan.

    Of proteins with ``min_peptides`` distinct peptides, each peptide's log2 trace is shifted by the median
    difference from the reference trace (the peptide with most values, of several the first by name), and
    each sample gets the median over its shifted peptides, scaled so that the protein keeps its total. Other
    proteins get the median of their rows. A table with one sample gets medians of peptides.
    """
    name = "MaxLFQIntensity"
    rows = df.where((F.col(c.intensity) > 0) & F.col(c.protein).isNotNull() & F.col(c.peptide).isNotNull())
    cells = rows.groupBy(c.protein, c.peptide, *c.unit).agg(F.sum(c.intensity).alias("x")).withColumn("lx", F.log2("x"))
    by_protein = Window.partitionBy(c.protein)
    # distinct peptides: the highest dense rank
    ranked = cells.withColumn("pr", F.dense_rank().over(by_protein.orderBy(c.peptide))).withColumn("n_pep", F.max("pr").over(by_protein)).withColumn("n_vals", F.count(F.lit(1)).over(Window.partitionBy(c.protein, c.peptide)))
    enough = ranked.where(F.col("n_pep") >= min_peptides)
    marked = enough.withColumn("is_ref", F.col(c.peptide) == F.first(c.peptide).over(by_protein.orderBy(F.desc("n_vals"), c.peptide)))
    ref = F.max(F.when(F.col("is_ref"), F.col("lx"))).over(Window.partitionBy(*c.keys))
    shifted = marked.withColumn("ref", ref).withColumn("shift", F.median(F.col("ref") - F.col("lx")).over(Window.partitionBy(c.protein, c.peptide)))
    aligned = shifted.groupBy(*c.keys).agg(F.median(F.col("lx") + F.coalesce("shift", F.lit(0.0))).alias("a"), F.sum("x").alias("total"))
    scaled = aligned.withColumn("lin", F.pow(F.lit(2.0), "a"))
    solved = scaled.select(*c.keys, (F.col("lin") * ratio(F.sum("total").over(by_protein), F.sum("lin").over(by_protein))).alias(name))
    few = ranked.where(F.col("n_pep") < min_peptides).select(c.protein).distinct()
    medians = rows.join(few, c.protein, "left_semi").groupBy(*c.keys).agg(F.median(c.intensity).alias(name))
    units = rows.select(*c.unit).distinct().limit(2).count()
    if units == 1:
        solved = enough.groupBy(*c.keys).agg(F.median("x").alias(name))
    return solved.unionByName(medians).where(F.col(name) > 0)


def get_method(name: str, **how: object) -> Callable[[DataFrame], DataFrame]:
    """A quantification by name: topN, maxlfq, directlfq, sum (all, allpeptides), median."""
    low = name.lower()
    if m := re.fullmatch(r"top(\d+)", low):
        return lambda df: quantify_topn(df, int(m[1]), how.get("columns", Columns()))
    if low == "topn":
        return lambda df: quantify_topn(df, how.get("n", 3), how.get("columns", Columns()))
    if low == "maxlfq":
        return lambda df: quantify_maxlfq(df, how.get("min_peptides", 2), how.get("columns", Columns()))
    if low == "directlfq":
        from quantloom.operators.alignment import quantify_directlfq

        return lambda df: quantify_directlfq(df, how.get("min_nonan", 1), how.get("columns", Columns()))
    if low in ("all", "sum", "allpeptides"):
        return lambda df: quantify_sum(df, how.get("columns", Columns()))
    if low == "median":
        return lambda df: quantify_median(df, how.get("columns", Columns()))
    raise ValueError(f"unknown method {name!r}; known: {', '.join(list_methods())}")


def list_methods() -> dict[str, str]:
    return {"top3": "mean of the three largest peptides", "topN": "mean of the N largest peptides", "maxlfq": "trace-aligned quantities", "directlfq": "ion alignment", "sum": "sum of all peptides", "median": "median of all peptides"}


def share_of_sample(df: DataFrame, column: str) -> DataFrame:
    """Adds <column>Norm: the share of the sample's total."""
    return df.withColumn(f"{column}Norm", ratio(F.col(column), F.sum(column).over(Window.partitionBy(S.SAMPLE))))


def cv_metric(df: DataFrame, column: str) -> DataFrame:
    """Mean over proteins, of those in all samples, of deviation over mean."""
    n = F.broadcast(df.agg(F.countDistinct(S.SAMPLE).alias("__all")))
    per = df.groupBy(S.PROTEIN).agg(F.countDistinct(S.SAMPLE).alias("n"), ratio(F.stddev_samp(column), F.avg(column)).alias("cv"))
    return per.join(n).where(F.col("n") == F.col("__all")).agg(F.avg("cv").alias("mean_cv"), F.count("cv").alias("n_proteins"))


def _ranges(df: DataFrame, values: list[str], parts: int) -> list[Column]:
    """The range of each value's column among ``parts`` cuts: even between cuts, odd for all that equal a cut; null: the last, odd."""
    found = df.agg(*[F.percentile_approx(v, [k / parts for k in range(1, parts)], 10_000).alias(v) for v in values]).first()
    out = []
    for v in values:
        cuts = sorted({float(c) for c in found[v] or []})
        known = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
        value = F.col(v)
        below = 2 * F.size(F.filter(known, lambda c: c < value))  # noqa: B023
        out.append(F.when(value.isNull(), 2 * len(cuts) + 1).otherwise(below + F.array_contains(known, value).cast("int")))
    return out


def compare_methods(a: DataFrame, b: DataFrame, a_column: str, b_column: str, parts: int = 64) -> DataFrame:
    """Pearson's and Spearman's correlation and mean distance of two quantities on log2(x + 1).

    Equal values share the mean of their ranks, nulls come last. Ranks are taken within ranges of values, and a row
    for each pair of ranges holds what places them among all: no task orders a whole column, and nothing is joined on
    sums of doubles, which come out anew in their last digits whenever they are computed again.
    """
    both = a.select(S.PROTEIN, S.SAMPLE, F.log2(F.col(a_column) + 1).alias("x")).join(b.select(S.PROTEIN, S.SAMPLE, F.log2(F.col(b_column) + 1).alias("y")), [S.PROTEIN, S.SAMPLE])
    rows = both.withColumns(dict(zip(("px", "py"), _ranges(both, ["x", "y"], parts), strict=True)))
    for v, p in (("x", "px"), ("y", "py")):
        # a range of equal values needs no order and may be large
        apart = F.when(F.col(p) % 2 == 1, F.pmod(F.xxhash64(S.PROTEIN, S.SAMPLE), F.lit(parts))).otherwise(0)
        own = Window.partitionBy(p, apart)
        rank = F.rank().over(own.orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(p, apart, v)) - 1) / 2
        rows = rows.withColumn(f"r{v}", F.when(F.col(p) % 2 == 1, 0.0).otherwise(rank))
    full = F.col("x").isNotNull() & F.col("y").isNotNull()
    moments = [f(F.when(full, F.col(v)) if u == "m" else F.col(f"r{v}")).alias(f"{u}{k}{v}") for u in "mr" for v in "xy" for k, f in (("a", F.avg), ("v", F.var_pop))]
    cells = rows.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(full, 1)).alias("nf"), F.sum(F.abs(F.col("x") - F.col("y"))).alias("d"), F.covar_pop("x", "y").alias("mc"), F.covar_pop("rx", "ry").alias("rc"), *moments)
    # a row per pair of ranges: a short table
    for v in "xy":
        before = Window.orderBy(f"p{v}").rangeBetween(Window.unboundedPreceding, -1)
        middle = F.when(F.col(f"p{v}") % 2 == 1, (F.sum("n").over(Window.partitionBy(f"p{v}")) + 1) / 2).otherwise(F.col(f"ra{v}"))
        cells = cells.withColumn(f"ra{v}", F.coalesce(F.sum("n").over(before), F.lit(0)) + middle)
    weight = {"m": F.col("nf"), "r": F.col("n")}
    for u, v in (("m", "x"), ("m", "y"), ("r", "x"), ("r", "y")):
        every = Window.partitionBy()
        cells = cells.withColumn(f"{u}d{v}", F.col(f"{u}a{v}") - ratio(F.sum(weight[u] * F.col(f"{u}a{v}")).over(every), F.sum(weight[u]).over(every)))

    def r(u: str) -> Column:
        cov, sx, sy = (F.sum(weight[u] * (F.col(c) + F.col(f"{u}d{i}") * F.col(f"{u}d{j}"))) for c, i, j in ((f"{u}c", "x", "y"), (f"{u}vx", "x", "x"), (f"{u}vy", "y", "y")))
        return ratio(cov, F.sqrt(sx) * F.sqrt(sy))

    return cells.agg(r("m").alias("pearson"), r("r").alias("spearman"), ratio(F.sum("d"), F.sum("nf")).alias("mean_abs_diff"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
