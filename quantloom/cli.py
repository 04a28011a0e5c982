"""Command line: features2peptides, features2proteins, peptides2protein, correct-batches, tsne-visualization."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom import schema as S
from quantloom.operators import batch, filters, normalize, outliers, quantify
from quantloom.plans import workflows as W
from quantloom.sources import readers, sinks


def _features(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, S.LabelClass, str | None]:
    long = readers.features_long(spark.read.parquet(a.parquet))
    if a.sdrf:
        long = readers.with_sdrf(long, readers.load_sdrf(spark, a.sdrf))
    # labels are a plex's channels: 18 at most
    labels = [r[0] for r in long.select("channel").distinct().limit(64).collect() if r[0]]
    return long, *(S.classify_labels(labels) if labels else (S.LabelClass.LFQ, None))


def _config(a: argparse.Namespace) -> W.Config:
    c = W.Config(min_aa=a.min_aa, min_unique=a.min_unique, run_normalization=S.RunNormalization.from_str(a.run_normalization), sample_normalization=S.SampleNormalization.from_str(a.sample_normalization))
    for k in ("skip_normalization", "log2", "irs_channel", "irs_stat", "irs_scope", "quantification", "topn", "min_nonan", "export_peptides", "export_ions"):
        if getattr(a, k, None) is not None:
            setattr(c, k, getattr(a, k))
    c.ion_alignment = getattr(a, "ion_alignment", None) == "hierarchical"
    c.remove_contaminants = getattr(a, "remove_decoy_contaminants", True)
    c.remove_low_frequency = getattr(a, "remove_low_frequency_peptides", False)
    c.run_level = getattr(a, "aggregation_level", "sample") == "run"
    over = {"intensity__min_intensity": getattr(a, "filter_min_intensity", None), "intensity__cv_threshold": getattr(a, "filter_cv_threshold", None), "peptide__allowed_charge_states": getattr(a, "filter_charge_states", None), "peptide__max_missed_cleavages": getattr(a, "filter_max_missed_cleavages", None), "protein__min_unique_peptides": getattr(a, "filter_min_unique_peptides", None), "run_qc__min_identified_features": getattr(a, "filter_min_features", None), "run_qc__max_missing_rate": getattr(a, "filter_max_missing_rate", None), "peptide__exclude_modifications": getattr(a, "filter_exclude_modifications", None)}
    config = filters.load_config(a.filter_config) if getattr(a, "filter_config", None) else {}
    c.filters = filters.with_overrides(config, **over) if config or any(v is not None for v in over.values()) else {}
    return c


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quantloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def features(name: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        s.add_argument("-p", "--parquet", required=True)
        s.add_argument("-s", "--sdrf")
        s.add_argument("-o", "--output", required=True)
        s.add_argument("--min_aa", "--min-aa", type=int, default=7)
        s.add_argument("--min_unique", "--min-unique", type=int, default=2)
        s.add_argument("--run-normalization", default="median")
        s.add_argument("--sample-normalization", default="globalMedian")
        s.add_argument("--remove_ids")
        s.add_argument("--filter-config")
        return s

    s = features("features2peptides")
    for flag in ("--remove_decoy_contaminants", "--remove_low_frequency_peptides", "--skip_normalization", "--log2"):
        s.add_argument(flag, action="store_true")
    s.add_argument("--save_parquet", action="store_true", help="also write the result as Parquet, beside the output")
    s.add_argument("--irs_channel", type=int)
    s.add_argument("--irs_autodetect_regex", default="pool|powder|ref|reference")
    s.add_argument("--irs_stat", choices=["median", "mean"], default="median")
    s.add_argument("--irs_scope", choices=["global", "by_mixture", "two_stage"], default="global")
    s.add_argument("--aggregation_level", choices=["sample", "run"], default="sample")
    s.add_argument("--generate-filter-config")
    for flag, kind in (("--filter-min-intensity", float), ("--filter-cv-threshold", float), ("--filter-max-missed-cleavages", int), ("--filter-min-unique-peptides", int), ("--filter-min-features", int), ("--filter-max-missing-rate", float)):
        s.add_argument(flag, type=kind)
    s.add_argument("--filter-exclude-modifications", type=lambda x: [v.strip() for v in x.split(",")])
    s.add_argument("--filter-charge-states", type=lambda x: [int(v) for v in x.split(",")])

    s = features("features2proteins")
    s.add_argument("--quant-method", dest="quantification", default="maxlfq", choices=["directlfq", "ibaq", "maxlfq", "topn", "sum", "median"])
    s.add_argument("--topn", type=int, default=3)
    s.add_argument("--fasta")
    s.add_argument("--ion-alignment", choices=["none", "hierarchical"])
    s.add_argument("--remove-contaminants", dest="remove_decoy_contaminants", action="store_true", default=True)
    s.add_argument("--keep-contaminants", dest="remove_decoy_contaminants", action="store_false")
    s.add_argument("--normalization-proteins")
    s.add_argument("--directlfq-cores", type=int, help="taken for compatibility; Spark's own settings decide")
    s.add_argument("--directlfq-min-nonan", dest="min_nonan", type=int, default=1)
    s.add_argument("--export-peptides")
    s.add_argument("--export-ions")

    s = sub.add_parser("peptides2protein")
    s.add_argument("-p", "--peptides", required=True)
    s.add_argument("-f", "--fasta")
    s.add_argument("-o", "--output")
    s.add_argument("--method", default="ibaq", choices=["ibaq", "top3", "topn", "maxlfq", "sum", "directlfq"])
    s.add_argument("-e", "--enzyme", default="Trypsin")
    for flag in ("-n", "-t", "-r"):
        s.add_argument(flag, {"-n": "--normalize", "-t": "--tpa", "-r": "--ruler"}[flag], action="store_true")
    s.add_argument("--min_aa", type=int, default=7)
    s.add_argument("--max_aa", type=int, default=30)
    s.add_argument("-i", "--ploidy", type=int, default=2)
    s.add_argument("-m", "--organism", default="human")
    s.add_argument("-c", "--cpc", type=float, default=200)
    s.add_argument("--topn_n", type=int, default=3)
    s.add_argument("--min_nonan", type=int, default=1)

    s = sub.add_parser("correct-batches")
    s.add_argument("-f", "--folder", required=True)
    s.add_argument("-p", "--pattern", default="*ibaq.tsv")
    s.add_argument("--comment", default="#")
    s.add_argument("--sep", default="\t")
    s.add_argument("-o", "--output", required=True)

    s = sub.add_parser("tsne-visualization")
    s.add_argument("-f", "--folder", required=True)
    s.add_argument("-o", "--pattern", default="proteins.tsv")
    s.add_argument("--output")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if getattr(a, "generate_filter_config", None):
        filters.save_config(filters.example_config(), a.generate_filter_config)
        return
    spark = spark or SparkSession.builder.appName("quantloom").getOrCreate()
    if a.command in ("features2peptides", "features2proteins"):
        long, label, plex = _features(spark, a)
        if a.remove_ids:
            long = long.withColumn("__names", F.array_join("pg_accessions", ";"))
            from quantloom.functions.predicates import without_ids

            long = without_ids(long, readers.load_ids(spark, a.remove_ids), "__names").drop("__names")
        c = _config(a)
        if getattr(a, "normalization_proteins", None):
            c.normalization_proteins = readers.load_ids(spark, a.normalization_proteins)
        if c.irs_channel is None and label is not S.LabelClass.LFQ and a.sdrf and getattr(a, "irs_autodetect_regex", None):
            found = normalize.reference_label(readers.load_sdrf(spark, a.sdrf), a.irs_autodetect_regex)
            c.irs_channel = S.channels(plex).get(found) if found else None
        if a.command == "features2peptides":
            out = W.features_to_peptides(long, c, label, plex)
        else:
            out = W.features_to_proteins(long, c, readers.load_fasta(spark, a.fasta) if a.fasta else None, label, plex)
        sinks.write_table(out, a.output)
        if getattr(a, "save_parquet", False) and not a.output.endswith(".parquet"):
            sinks.write_table(out, f"{a.output.rsplit('.', 1)[0]}.parquet")
    elif a.command == "peptides2protein":
        peptides = readers.load_peptides(spark, a.peptides)
        if a.method == "ibaq":
            out = W.peptides_to_proteins(peptides, readers.load_fasta(spark, a.fasta), a.enzyme, a.min_aa, a.max_aa, a.organism, a.ploidy, a.cpc, a.tpa, a.ruler, a.normalize)
        else:
            out = quantify.get_method(a.method, n=a.topn_n, min_nonan=a.min_nonan)(peptides)
            out = quantify.share_of_sample(out, out.columns[-1]) if a.normalize else out
        sinks.write_table(out, a.output)
    elif a.command == "correct-batches":
        sinks.write_table(batch.correct_batches(readers.combine_tsv(spark, a.folder, a.pattern, a.comment, a.sep)), a.output)
    else:
        df = readers.combine_tsv(spark, a.folder, f"*{a.pattern}")
        found, _ = outliers.pca(df.withColumn(S.IBAQ_LOG, F.col(S.IBAQ_LOG).cast("double")), S.IBAQ_LOG, 30)
        # a row per sample
        rows = found.toPandas().set_index(S.SAMPLE)
        xy = outliers.tsne(rows.to_numpy())
        sinks.write_table(spark.createDataFrame([(s, float(x), float(y)) for s, (x, y) in zip(rows.index, xy, strict=True)], f"{S.SAMPLE} string, tsne1 double, tsne2 double"), a.output)


if __name__ == "__main__":
    main()
