"""Batches: detection, covariates, empirical-Bayes correction, metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom import schema as S
from quantloom.functions.expressions import batch_prefix, ratio
from quantloom.operators.impute import complete


#: Rows that are broadcast at most.
MOST_BROADCAST = 200_000


class TooFewSamplesInBatch(ValueError):
    pass


def coded(df: DataFrame, value: Column, name: str = "batch") -> DataFrame:
    """Adds codes from 0 of the distinct values, in order of value. The values are a sample table's: few."""
    v = df.withColumn("__v", value)
    codes = v.select("__v").distinct().select("__v", (F.dense_rank().over(Window.orderBy("__v")) - 1).alias(name))
    return v.join(codes, v["__v"].eqNullSafe(codes["__v"])).drop("__v")


def detect_batches(samples: DataFrame, method: S.BatchSource, run: str | None = None, column: str | None = None) -> DataFrame:
    """Adds ``batch`` to a sample table: by name prefix, run, fraction, replicate or a given column. Without run information, by prefix."""
    prefix = batch_prefix(F.col(S.SAMPLE))
    if method is S.BatchSource.EXPLICIT_COLUMN:
        if not column or column not in samples.columns:
            raise ValueError("an explicit batch column is needed")
        return coded(samples, F.col(column))
    if method is S.BatchSource.RUN_NAME:
        if not run:
            raise ValueError("batches by run need the run's column")
        return coded(samples, F.coalesce(F.col(run), F.col(S.SAMPLE)))
    for m, c in ((S.BatchSource.FRACTION, S.FRACTION), (S.BatchSource.TECHREPLICATE, S.TECHREP)):
        if method is m and c in samples.columns:
            return coded(samples, F.coalesce(F.col(c).cast("string"), F.lit("1")))
    return coded(samples, prefix)


def covariates(samples: DataFrame, sdrf: DataFrame, columns: list[str]) -> DataFrame | None:
    """Codes of the named metadata columns per sample; columns with one value are left out, and without any there is none.

    A sample takes the row of its name, or else the first (by source name) whose name contains it or is
    contained in it, or else 'unknown'. A column is found by its name, or by a part of it.
    """
    found = {}
    for want in columns:
        hit = [c for c in sdrf.columns if c == want.lower()] or [c for c in sdrf.columns if want.lower() in c]
        if hit:
            found[want] = hit[0]
    if not found:
        return None
    meta = sdrf.select(F.col("`source name`").alias("__s"), *[F.col(f"`{c}`").alias(n) for n, c in found.items()])
    fields = F.struct(*[F.col(n) for n in found])
    exact = meta.groupBy("__s").agg(F.min(fields).alias("__exact"))
    # only samples without a row of their own name are compared with all names; both tables have a row per sample
    rest = samples.select(S.SAMPLE).distinct().join(exact, F.col(S.SAMPLE) == F.col("__s"), "left_anti")
    names = meta.distinct()
    names = F.broadcast(names) if names.count() <= MOST_BROADCAST else names
    loose = rest.join(names, F.col(S.SAMPLE).contains(F.col("__s")) | F.col("__s").contains(F.col(S.SAMPLE))).groupBy(S.SAMPLE).agg(F.min_by(fields, "__s").alias("__loose"))
    out = samples.join(exact, F.col(S.SAMPLE) == F.col("__s"), "left").drop("__s").join(loose, S.SAMPLE, "left")
    value = F.coalesce("__exact", "__loose")
    out = out.select(*samples.columns, *[F.coalesce(value[n], F.lit("unknown")).alias(n) for n in found])
    kinds = out.agg(*[F.countDistinct(n).alias(n) for n in found]).first()
    keep = [n for n in found if kinds[n] > 1]
    if not keep:
        return None
    for n in keep:
        out = coded(out.withColumnRenamed(n, f"__{n}"), F.col(f"__{n}"), n).drop(f"__{n}")
    return out.select(*samples.columns, *keep)


def _design(rows: list, covs: list[str]) -> tuple[np.ndarray, list]:
    batches = sorted({r["batch"] for r in rows})
    cols = [[float(r["batch"] == b) for r in rows] for b in batches]
    for c in covs:
        cols += [[float(r[c] == v) for r in rows] for v in sorted({r[c] for r in rows})[1:]]
    return np.array(cols).T, batches


def _empirical(stats: DataFrame, key: str, mean_only: bool, most: int = 1_000_000) -> DataFrame:
    """(batch, key, g_star, d_star): means of all other proteins' estimates in the batch, weighted by how likely they make the protein's values.

    The estimates of all proteins, two numbers each, are given to every task; more than ``most`` are refused.
    """
    rows = stats.select("batch", key, "g", "d").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"empirical priors take {most} estimates at most")
    batch_of, names = np.array(rows.column("batch").to_pylist(), dtype=object), np.array(rows.column(key).to_pylist(), dtype=object)
    g_all, d_all = rows.column("g").to_numpy(), rows.column("d").to_numpy()

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for b, name, n, s1, s2, g, d in zip(f["batch"], f[key], f["n"], f["s1"], f["s2"], f["g"], f["d"], strict=True):
                own = np.flatnonzero((batch_of == b) & (names != name))
                gs, ds = g_all[own], np.ones(len(own)) if mean_only else d_all[own]
                log = -n / 2 * np.log(2 * np.pi * ds) - (s2 - 2 * gs * s1 + n * gs * gs) / (2 * ds)
                w = np.exp(log - log.max()) if len(log) else log
                total = w.sum()
                out.append((b, name, float((w * gs).sum() / total) if total > 0 else g, 1.0 if mean_only else float((w * ds).sum() / total) if total > 0 else d))
            yield pd.DataFrame(out, columns=["batch", key, "g_star", "d_star"])

    kinds = {x.name: x.dataType.simpleString() for x in stats.schema}
    return stats.select("batch", key, "n", "s1", "s2", "g", "d").mapInPandas(solve, f"batch {kinds['batch']}, {key} {kinds[key]}, g_star double, d_star double")


def combat(df: DataFrame, samples: DataFrame, value: str, covs: list[str] = (), mean_only: bool = False, ref_batch: object = None, par_prior: bool = True, key: str = S.PROTEIN, iterations: int = 80) -> DataFrame:
    """``df`` with ``value`` corrected for the samples' ``batch`` (Johnson, Li and Rabinovic 2007), with parametric priors or, ``par_prior=False``, the empirical ones.

    Proteins need a value in every sample; others, and proteins that do not vary within batches, stay as
    they are. The design matrix has a row per sample and is inverted on the driver; all sums over proteins
    are joins and aggregates. The fixed point of each batch and protein needs three sums only, so its
    iteration is a fold over a sequence, without UDFs.
    """
    rows = samples.select(S.SAMPLE, "batch", *covs).distinct().collect()
    sizes = {b: sum(r["batch"] == b for r in rows) for b in {r["batch"] for r in rows}}
    if min(sizes.values()) < 2 and not mean_only:
        raise TooFewSamplesInBatch(f"batches of one sample: {sorted(b for b, n in sizes.items() if n < 2)}")
    x, batches = _design(rows, list(covs))
    solve = np.linalg.pinv(x.T @ x) @ x.T
    spark, n = df.sparkSession, len(rows)
    per_sample = spark.createDataFrame([(r[S.SAMPLE], r["batch"], solve[:, i].tolist(), x[i].tolist()) for i, r in enumerate(rows)], f"{S.SAMPLE} string, batch {samples.schema['batch'].dataType.simpleString()}, __m array<double>, __x array<double>")
    full = df.where(F.col(value).isNotNull()).select(key, S.SAMPLE, F.col(value).alias("x")).join(F.broadcast(per_sample), S.SAMPLE)
    k = x.shape[1]
    beta = full.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.array(*[F.sum(F.col("x") * F.col("__m")[j]) for j in range(k)]).alias("beta")).where(F.col("__n") == n).drop("__n")
    fit = lambda lo: F.aggregate(F.sequence(F.lit(lo), F.lit(k - 1)), F.lit(0.0), lambda s, j: s + F.col("__x")[j] * F.col("beta")[j]) if lo < k else F.lit(0.0)
    nb = len(batches)
    if ref_batch is None:
        grand = sum((F.lit(sizes[b] / n) * F.col("beta")[i] for i, b in enumerate(batches)), F.lit(0.0))
        in_var, n_var = F.lit(True), n
    else:
        grand, in_var, n_var = F.col("beta")[batches.index(ref_batch)], F.col("batch") == F.lit(ref_batch), sizes[ref_batch]
    with_beta = full.join(beta, key).withColumn("resid", F.col("x") - fit(0)).withColumn("center", grand + fit(nb))
    pooled = with_beta.groupBy(key).agg(F.sqrt(F.sum(F.when(in_var, F.col("resid") * F.col("resid"))) / n_var).alias("sd")).where("sd > 0")
    z = with_beta.join(pooled, key).withColumn("z", (F.col("x") - F.col("center")) / F.col("sd"))
    stats = z.groupBy("batch", key).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("z").alias("g"), F.coalesce(F.var_samp("z"), F.lit(1.0)).alias("d"), F.sum("z").alias("s1"), F.sum(F.col("z") * F.col("z")).alias("s2"))
    prior = F.broadcast(stats.groupBy("batch").agg(F.avg("g").alias("g_bar"), F.var_samp("g").alias("t2"), F.avg("d").alias("d_bar"), F.var_samp("d").alias("d_var")))
    with_prior = stats.join(prior, "batch")
    post = lambda d: ratio(F.col("t2") * F.col("n") * F.col("g") + d * F.col("g_bar"), F.col("t2") * F.col("n") + d)
    if not par_prior:
        star = _empirical(stats, key, mean_only)
    elif mean_only:
        star = with_prior.select("batch", key, post(F.lit(1.0)).alias("g_star"), F.lit(1.0).alias("d_star"))
    else:
        a = ratio(2 * F.col("d_var") + F.col("d_bar") * F.col("d_bar"), F.col("d_var"))
        b = ratio(F.col("d_bar") * F.col("d_var") + F.pow("d_bar", F.lit(3.0)), F.col("d_var"))

        def step(state: Column, _: Column) -> Column:
            g = post(state["d"])
            rest = F.col("s2") - 2 * g * F.col("s1") + F.col("n") * g * g
            return F.struct(g.alias("g"), ((0.5 * rest + F.col("b")) / (F.col("n") / 2 + F.col("a") - 1)).alias("d"))

        start = F.struct(F.col("g").cast("double").alias("g"), F.col("d").cast("double").alias("d"))
        solved = with_prior.withColumn("a", a).withColumn("b", b).withColumn("st", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step))
        star = solved.select("batch", key, F.coalesce("st.g", "g").alias("g_star"), F.coalesce("st.d", "d").alias("d_star"))
    fixed = z.join(star, ["batch", key]).withColumn("__new", (F.col("z") - F.col("g_star")) / F.sqrt("d_star") * F.col("sd") + F.col("center"))
    if ref_batch is not None:
        fixed = fixed.withColumn("__new", F.when(F.col("batch") == F.lit(ref_batch), F.col("x")).otherwise(F.col("__new")))
    return df.join(fixed.select(key, S.SAMPLE, "__new"), [key, S.SAMPLE], "left").withColumn(value, F.coalesce("__new", value)).select(*df.columns)


def sample_metadata(sdrf: DataFrame) -> DataFrame:
    """sample_id, batch, tissue, tissue_part. Of two organism-part columns the one with more values is the part."""
    parts = [c for c in sdrf.columns if "organism part" in c and "characteristics" in c]
    if not 1 <= len(parts) <= 2:
        raise ValueError(f"{len(parts)} organism part columns; one or two are needed")
    if len(parts) == 2:
        n = sdrf.agg(*[F.countDistinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(parts)]).first()
        parts = parts if n[0] <= n[1] else parts[::-1]
    tissue, part = F.col(f"`{parts[0]}`"), F.col(f"`{parts[-1]}`")
    name = F.col("`source name`")
    return sdrf.select(name.alias("sample_id"), batch_prefix(name).alias("batch"), tissue.alias("tissue"), part.alias("tissue_part")).distinct()


def combine(frames: list[DataFrame], metadata: DataFrame, suffix: str = "HUMAN") -> DataFrame:
    """Protein tables one after another, proteins of one organism only, with metadata and batch codes of the samples."""
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    kept = df.where(F.col(S.PROTEIN).endswith(suffix)).join(metadata.withColumnRenamed("sample_id", S.SAMPLE), S.SAMPLE, "left")
    return coded(kept, batch_prefix(F.col(S.SAMPLE)), "batch_code")


def valid_sample_ids(samples: DataFrame) -> bool:
    return samples.where(~F.col(S.SAMPLE).rlike(S.SAMPLE_ID)).isEmpty()


def correct_batches(ibaq: DataFrame, value: str = S.IBAQ, output: str = "IbaqBec") -> DataFrame:
    """A protein table with a corrected measure beside it: batches by name prefix, missing values as 0."""
    if not valid_sample_ids(ibaq.select(S.SAMPLE).distinct()):
        raise ValueError("sample ids must be letters and digits, in parts joined by dashes")
    samples = detect_batches(ibaq.select(S.SAMPLE).distinct(), S.BatchSource.SAMPLE_PREFIX)
    dense = complete(ibaq.select(S.PROTEIN, S.SAMPLE, F.col(value).cast("double").alias(output)), output).fillna(0.0, [output])
    return ibaq.join(combat(dense, samples, output), [S.PROTEIN, S.SAMPLE], "left")
