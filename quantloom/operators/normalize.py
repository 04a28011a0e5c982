"""Normalization across runs, samples and plexes. Factors are small tables joined to the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom import schema as S
from quantloom.functions.expressions import ratio

RunStat = Callable[[Column], Column]
RUN_STATS: dict[S.RunNormalization, RunStat] = {
    S.RunNormalization.MEAN: F.avg,
    S.RunNormalization.MEDIAN: F.median,
    S.RunNormalization.MAX: F.max,
    S.RunNormalization.GLOBAL: F.sum,
    S.RunNormalization.MAX_MIN: lambda x: F.max(x) - F.min(x),
    # the mean of both quartiles, as documented, not their distance
    S.RunNormalization.IQR: lambda x: (F.percentile(x, 0.75) + F.percentile(x, 0.25)) / 2,
}


def register_run_stat(method: S.RunNormalization, stat: RunStat) -> None:
    """Replaces the aggregate that a method takes of a run's intensities."""
    RUN_STATS[method] = stat


def run_factors(df: DataFrame, method: S.RunNormalization, column: str = S.NORM) -> DataFrame:
    """(sample, technical replicate, factor): the run's statistic over the mean of its sample's runs; 1 if the sample has one run."""
    stats = df.groupBy(S.SAMPLE, S.TECHREP).agg(RUN_STATS[method](F.col(column)).alias("stat"))
    w = Window.partitionBy(S.SAMPLE)
    return stats.select(S.SAMPLE, S.TECHREP, F.when(F.count(F.lit(1)).over(w) > 1, ratio(F.col("stat"), F.avg("stat").over(w))).otherwise(1.0).alias("factor"))


def normalize_runs(df: DataFrame, method: S.RunNormalization, column: str = S.NORM) -> DataFrame:
    if method is S.RunNormalization.NONE:
        return df
    return df.join(run_factors(df, method, column), [S.SAMPLE, S.TECHREP]).withColumn(column, ratio(F.col(column), F.col("factor"))).drop("factor")


def median_map(df: DataFrame, column: str = S.INTENSITY, approximate: int | None = None) -> DataFrame:
    """(sample, factor): the sample's median over the median of all sample medians. ``approximate``: accuracy of a median that combines before the shuffle."""
    med = F.percentile_approx(column, 0.5, approximate) if approximate else F.median(column)
    medians = df.groupBy(S.SAMPLE).agg(med.alias("m"))
    center = F.broadcast(medians.agg(F.median("m").alias("c")))
    return medians.join(center).select(S.SAMPLE, ratio(F.col("m"), F.col("c")).alias("factor"))


def condition_median_map(df: DataFrame, column: str = S.INTENSITY) -> DataFrame:
    """(condition, sample, factor): the sample's median over the mean of the medians of its condition."""
    medians = df.groupBy(S.CONDITION, S.SAMPLE).agg(F.median(column).alias("m"))
    return medians.select(S.CONDITION, S.SAMPLE, ratio(F.col("m"), F.avg("m").over(Window.partitionBy(S.CONDITION))).alias("factor"))


def normalize_samples(df: DataFrame, method: S.SampleNormalization, factors: DataFrame | None = None, column: str = S.NORM) -> DataFrame:
    """Intensities over their sample's factor; the factors are of ``df`` itself if none are given."""
    if method in (S.SampleNormalization.NONE, S.SampleNormalization.HIERARCHICAL):
        return df
    keys = [S.SAMPLE] if method is S.SampleNormalization.GLOBAL_MEDIAN else [S.CONDITION, S.SAMPLE]
    if factors is None:
        factors = median_map(df, column) if len(keys) == 1 else condition_median_map(df, column)
    return df.join(factors, keys, "left").withColumn(column, ratio(F.col(column), F.coalesce("factor", F.lit(1.0)))).drop("factor")


def irs_factors(df: DataFrame, reference_channel: object, stat: str = "median", scope: str = "global", column: str = S.INTENSITY, mixture: str = "mixture") -> DataFrame:
    """(technical replicate, scale) of an internal reference: centre of the reference channel over its value in the run.

    scope: ``global`` one centre, ``by_mixture`` one per mixture, ``two_stage`` to the mixture's centre and from there to the centre of mixtures.
    """
    f = {"median": F.median, "mean": F.avg}[stat]
    if mixture not in df.columns:
        df = df.withColumn(mixture, F.lit("1"))
    runs = df.where(F.col(S.CHANNEL) == F.lit(reference_channel)).groupBy(mixture, S.TECHREP).agg(f(column).alias("v"))
    if scope == "global":
        center = F.broadcast(runs.agg(f("v").alias("c")))
        return runs.join(center).select(S.TECHREP, ratio(F.col("c"), F.col("v")).alias("scale"))
    per_mixture = runs.groupBy(mixture).agg(f("v").alias("c"))
    if scope == "by_mixture":
        return runs.join(per_mixture, mixture).select(S.TECHREP, ratio(F.col("c"), F.col("v")).alias("scale"))
    if scope == "two_stage":
        center = F.broadcast(per_mixture.agg(f("c").alias("g")))
        return runs.join(per_mixture, mixture).join(center).select(S.TECHREP, (ratio(F.col("c"), F.col("v")) * ratio(F.col("g"), F.col("c"))).alias("scale"))
    raise ValueError(f"scope {scope!r}: global, by_mixture or two_stage")


def apply_irs(df: DataFrame, scales: DataFrame, column: str = S.NORM) -> DataFrame:
    return df.join(scales, S.TECHREP, "left").withColumn(column, F.col(column) * F.coalesce("scale", F.lit(1.0))).drop("scale")


def reference_label(sdrf: DataFrame, pattern: str) -> str | None:
    """The most frequent label (of several, the first by name) of samples whose name matches the pattern, whatever the case."""
    found = sdrf.where(F.col("`source name`").rlike(f"(?i){pattern}")).groupBy(F.col("`comment[label]`").alias("label")).count().orderBy(F.desc("count"), "label").first()
    return found["label"] if found else None


def highest_peptidoform(df: DataFrame, column: str = S.NORM, run_level: bool = False) -> DataFrame:
    """Of rows of one peptidoform, charge, sample, condition and replicate the one with most intensity (then by protein, replicate, fraction)."""
    keys = [S.PEPTIDOFORM, S.CHARGE, S.SAMPLE, S.CONDITION, S.BIOREP, *([S.TECHREP] if run_level else [])]
    order = [F.col(column).desc_nulls_last(), *(F.col(c) for c in (S.PROTEIN, S.TECHREP, S.FRACTION) if c in df.columns)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merge_fractions(df: DataFrame, column: str = S.NORM) -> DataFrame:
    """The most intense fraction of each peptidoform."""
    keys = [S.PROTEIN, S.PEPTIDOFORM, S.PEPTIDE, S.CHARGE, S.CONDITION, S.BIOREP, S.TECHREP, S.SAMPLE]
    return df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.max(column).alias(column))


def sum_peptidoforms(df: DataFrame, column: str = S.NORM, run_level: bool = False) -> DataFrame:
    """Peptide intensities: the sum over peptidoforms and charges."""
    keys = [S.PROTEIN, S.PEPTIDE, S.SAMPLE, S.BIOREP, S.CONDITION, *([c for c in (S.RUN, S.TECHREP) if c in df.columns] if run_level else [])]
    return df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.sum(column).alias(column))


def quantile_normalize(df: DataFrame, column: str, key: str = S.PROTEIN) -> DataFrame:
    """Every sample's value of a rank replaced by the mean over samples at that rank; ties get the mean of their ranks' values."""
    x = df.where(F.col(column).isNotNull())
    ranked = x.withColumn("__r", F.row_number().over(Window.partitionBy(S.SAMPLE).orderBy(column, key)))
    at = ranked.groupBy("__r").agg(F.avg(column).alias("__v"))
    tied = ranked.join(at, "__r").withColumn(column, F.avg("__v").over(Window.partitionBy(S.SAMPLE, column)))
    return tied.select(*df.columns)


def median_center(df: DataFrame, column: str, by: str = S.SAMPLE) -> DataFrame:
    """Values less the median of their sample (or, by the protein column, of their row)."""
    m = df.groupBy(by).agg(F.median(column).alias("__m"))
    return df.join(m, by).withColumn(column, F.col(column) - F.col("__m")).select(*df.columns)


def total_intensity(df: DataFrame, column: str, target: float = 1e9) -> DataFrame:
    """Values scaled to one total per sample."""
    s = df.groupBy(S.SAMPLE).agg(F.sum(column).alias("__s"))
    return df.join(s, S.SAMPLE).withColumn(column, ratio(F.col(column) * F.lit(target), F.col("__s"))).select(*df.columns)
