"""Reshaping between long and wide tables, and summaries per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom import schema as S


def pivot_wider(df: DataFrame, row: str, column: str, value: str, fill: float | bool = False, columns: list | None = None) -> DataFrame:
    """A row per ``row``, a column per value of ``column`` (``columns``: those known beforehand, which saves a pass)."""
    missing = [c for c in (row, column, value) if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    if not df.groupBy(row, column).count().where("count > 1").isEmpty():
        raise ValueError(f"several values for one pair of {row} and {column}")
    wide = df.groupBy(row).pivot(column, columns).agg(F.first(value))
    return wide if fill is False or fill is None else wide.fillna(0 if fill is True else fill)


def pivot_longer(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A row per pair; missing values stay, as null."""
    return df.unpivot([row], [c for c in df.columns if c != row], column, value)


def describe_metrics(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each protein measure, per sample."""
    aggs = []
    for c in (S.IBAQ, S.IBAQ_NORM, S.IBAQ_LOG, S.IBAQ_PPB, S.TPA, S.COPIES):
        if c in df.columns:
            q = lambda p, c=c: F.percentile(c, p)
            aggs += [f(c).alias(f"{c}_{n}") for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
            aggs += [q(p).alias(f"{c}_{n}") for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    return df.groupBy(S.SAMPLE).agg(*aggs)


def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """What a box plot shows: extremes and quartiles."""
    return df.groupBy(group).agg(F.min(value).alias("least"), *[F.percentile(value, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], F.max(value).alias("most"))


def histogram(df: DataFrame, group: str, value: str, bins: int = 50) -> DataFrame:
    """What a distribution plot shows: counts of log2 values in bins of equal width over all groups."""
    x = df.where(F.col(value) > 0).select(group, F.log2(value).alias("x"))
    bounds = F.broadcast(x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1))).otherwise(0).cast("int")
    return x.join(bounds).groupBy(group, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("lo") + at * width).alias("from_log2"))
