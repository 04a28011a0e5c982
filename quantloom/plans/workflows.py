"""Whole workflows: features to peptides, features to proteins, peptides to proteins. Each is one lazy plan over all samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom import schema as S
from quantloom.functions import predicates as P
from quantloom.functions.expressions import log2
from quantloom.operators import alignment, batch, ibaq, normalize, quantify
from quantloom.operators.filters import pipeline_of
from quantloom.sources import readers, sinks


@dataclass
class Config:
    min_aa: int = 7
    min_unique: int = 2
    remove_contaminants: bool = True
    run_normalization: S.RunNormalization = S.RunNormalization.MEDIAN
    sample_normalization: S.SampleNormalization = S.SampleNormalization.GLOBAL_MEDIAN
    skip_normalization: bool = False
    run_level: bool = False
    remove_low_frequency: bool = False
    low_frequency_share: float = 0.2
    log2: bool = False
    quantification: str = "maxlfq"
    topn: int = 3
    ion_alignment: bool = False
    batch_method: S.BatchSource | None = None
    irs_channel: object = None
    irs_stat: str = "median"
    irs_scope: str = "global"
    filters: dict = field(default_factory=dict)
    #: Proteins (a column of ids) that hierarchical alignment is fitted on; all if not given.
    normalization_proteins: DataFrame | None = None
    min_nonan: int = 1
    #: Paths for the normalized peptides and, of direct quantification, ions.
    export_peptides: str | None = None
    export_ions: str | None = None


def peptide_columns(features: DataFrame, label: S.LabelClass = S.LabelClass.LFQ, plex: str | None = None) -> DataFrame:
    """A long feature view under the peptide table's names: accessions joined by ';', isobaric channels as numbers, no channel for label-free data."""
    df = features.where("unique = 1") if "unique" in features.columns else features
    df = df.withColumn("pg_accessions", F.array_join("pg_accessions", ";"))
    df = df.select([F.col(c).alias(S.RAW_TO_INTERNAL.get(c, c)) for c in df.columns])
    if label is S.LabelClass.LFQ:
        return df.drop(S.CHANNEL)
    pairs = [F.lit(x) for kv in S.channels(plex).items() for x in kv]
    return df.withColumn(S.CHANNEL, F.create_map(*pairs)[F.col(S.CHANNEL)])


def clean(df: DataFrame, c: Config) -> DataFrame:
    """Peptidoform rows that are fit for normalization, in NormIntensity."""
    irs = normalize.irs_factors(P.tech_replicates(df), c.irs_channel, c.irs_stat, c.irs_scope) if c.irs_channel is not None else None
    out = P.initial_filter(df, c.min_aa, c.run_level)
    out = P.min_unique_peptides(out, c.min_unique)
    if c.remove_contaminants:
        out = out.where(P.not_contaminant(F.col(S.PROTEIN)))
    out = out.withColumnRenamed(S.INTENSITY, S.NORM)
    if c.filters:
        out = pipeline_of(c.filters).apply(out)[0]
    if not c.skip_normalization:
        out = normalize.normalize_runs(out, c.run_normalization)
    return normalize.apply_irs(out, irs) if irs is not None else out


def features_to_peptides(features: DataFrame, c: Config = Config(), label: S.LabelClass = S.LabelClass.LFQ, plex: str | None = None) -> DataFrame:
    """The peptide flow: clean, best peptidoform, fractions, sample normalization, rare peptides, sum."""
    raw = peptide_columns(features, label, plex)
    df = normalize.highest_peptidoform(clean(raw, c), run_level=c.run_level)
    if not c.run_level:
        df = normalize.merge_fractions(df)
    if not c.skip_normalization:
        factors = None
        if c.sample_normalization is S.SampleNormalization.GLOBAL_MEDIAN:
            factors = normalize.median_map(raw)
        elif c.sample_normalization is S.SampleNormalization.CONDITION_MEDIAN:
            factors = normalize.condition_median_map(raw)
        df = normalize.normalize_samples(df, c.sample_normalization, factors)
    if c.remove_low_frequency:
        rare = P.low_frequency_pairs(df, c.low_frequency_share)
        df = df.join(rare, [S.PROTEIN, S.PEPTIDE], "left_anti")
    out = normalize.sum_peptidoforms(df, run_level=c.run_level)
    if c.sample_normalization is S.SampleNormalization.HIERARCHICAL and not c.skip_normalization:
        out = alignment.align_samples(out.withColumn("__l", log2(F.col(S.NORM))), [S.PROTEIN, S.PEPTIDE], S.SAMPLE, "__l").withColumn(S.NORM, F.pow(F.lit(2.0), "__l")).drop("__l")
    return out.withColumn(S.NORM, log2(F.col(S.NORM))) if c.log2 else out


def features_to_proteins(features: DataFrame, c: Config = Config(), fasta: DataFrame | None = None, label: S.LabelClass = S.LabelClass.LFQ, plex: str | None = None) -> DataFrame:
    """The protein flow: peptides are summed before samples are normalized; then quantification and, if asked, batch correction."""
    raw = peptide_columns(features, label, plex)
    if c.quantification == "directlfq":
        kept = P.min_unique_peptides(raw.where(F.length(S.PEPTIDE) >= c.min_aa), c.min_unique, per_sample=False)
        named = kept.withColumnRenamed(S.INTENSITY, S.NORM)
        if c.export_ions:
            sinks.write_table(alignment.aligned_ions(named), c.export_ions)
        return quantify.get_method("directlfq", min_nonan=c.min_nonan)(named)
    peptides = normalize.sum_peptidoforms(normalize.highest_peptidoform(clean(raw, c)))
    if not c.skip_normalization:
        if c.sample_normalization is S.SampleNormalization.HIERARCHICAL:
            logs = peptides.withColumn("__l", log2(F.col(S.NORM)))
            only = c.normalization_proteins
            only = None if only is None else only.select(F.trim(F.col(only.columns[0])).alias(S.PROTEIN)).distinct()
            peptides = alignment.align_samples(logs, [S.PROTEIN, S.PEPTIDE], S.SAMPLE, "__l", only).withColumn(S.NORM, F.pow(F.lit(2.0), "__l")).drop("__l")
        else:
            peptides = normalize.normalize_samples(peptides, c.sample_normalization)
    if c.ion_alignment:
        ions = peptides.groupBy(S.PROTEIN, S.PEPTIDE, S.SAMPLE).agg(F.sum(S.NORM).alias(S.NORM)).withColumn(S.NORM, log2(F.col(S.NORM)))
        peptides = alignment.align_ions(ions, S.PROTEIN, S.PEPTIDE, S.SAMPLE, S.NORM).withColumn(S.NORM, F.pow(F.lit(2.0), S.NORM))
    if c.export_peptides:
        sinks.write_table(peptides, c.export_peptides)
    if c.quantification == "ibaq":
        if fasta is None:
            raise ValueError("ibaq needs a FASTA table")
        out, value = ibaq.pipeline_ibaq(peptides, ibaq.theoretical(fasta, max_aa=50, min_aa=c.min_aa, distinct=False, strip=True)), S.IBAQ
    else:
        out = quantify.get_method(c.quantification, n=c.topn)(peptides)
        value = out.columns[-1]
    if c.batch_method is None:
        return out
    samples = batch.detect_batches(out.select(S.SAMPLE).distinct(), c.batch_method)
    sizes = [r["count"] for r in samples.groupBy("batch").count().collect()]
    if len(sizes) < 2 or min(sizes) < 2:
        return out
    return batch.combat(out, samples, value)


def combine_folder(spark: SparkSession, folder: str, organism: str = "HUMAN") -> DataFrame:
    """The protein tables of a folder's datasets one after another, with the metadata and batch codes of their samples."""
    files = readers.dataset_files(spark, folder)
    about = [batch.sample_metadata(readers.load_sdrf(spark, f)) for f in files["sdrf"]]
    metadata = about[0]
    for m in about[1:]:
        metadata = metadata.unionByName(m)
    tables = [spark.read.parquet(f) if f.endswith(".parquet") else spark.read.csv(f, header=True, inferSchema=True) for f in files["ibaq"]]
    return batch.combine(tables, metadata.distinct(), organism)


def peptides_to_proteins(peptides: DataFrame, fasta: DataFrame, enzyme: str = "trypsin", min_aa: int = 7, max_aa: int = 30, organism: str = "HUMAN", ploidy: int = 2, cpc: float = 200.0, tpa: bool = True, ruler: bool = True, norm: bool = True, histone: Column | None = None) -> DataFrame:
    """The iBAQ flow over a peptide table. ``histone``: which proteins are histones, if not by the organism's lists."""
    if ruler and not tpa:
        raise ValueError("the ruler needs molecular weights: turn tpa on")
    theory = ibaq.theoretical(fasta, enzyme, min_aa, max_aa)
    groups = ibaq.group_theory(peptides, theory)
    out = ibaq.ibaq(peptides.where(F.col(S.NORM) > 0), groups)
    if norm:
        out = ibaq.normalized(out)
    if tpa:
        out = ibaq.total_protein_approach(out)
    return ibaq.proteomic_ruler(out, organism, ploidy, cpc, histone) if ruler else out
