"""Row predicates over feature and peptide tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom import schema as S
from quantloom.functions.expressions import trailing_number, uniprot_accession

CONTAMINANTS = ("CONTAMINANT", "ENTRAP", "DECOY")


def _any_contains(names: Column, part: str) -> Column:
    return F.exists(names, lambda x: x.contains(part))


@dataclass
class FeaturePredicate:
    """What features must meet before factors are computed from them; ``column()`` is one expression, which the scan takes as far as it can."""

    remove_contaminants: bool = True
    contaminants: tuple[str, ...] = CONTAMINANTS
    min_intensity: float = 0.0
    min_length: int = 7
    unique_only: bool = True
    names: dict[str, str] = field(default_factory=lambda: {"intensity": "intensity", "sequence": "sequence", "unique": "unique", "accessions": "pg_accessions"})

    def column(self) -> Column:
        n = {k: F.col(v) for k, v in self.names.items()}
        tests = [n["intensity"] > 0]
        if self.min_intensity > 0:
            tests.append(n["intensity"] >= self.min_intensity)
        if self.min_length > 0:
            tests.append(F.length(n["sequence"]) >= self.min_length)
        if self.unique_only:
            tests.append(n["unique"] == 1)
        if self.remove_contaminants:
            tests += [~_any_contains(n["accessions"], p) for p in self.contaminants]
        return reduce(lambda a, b: a & b, tests)


def not_contaminant(name: Column) -> Column:
    return ~name.rlike("|".join(CONTAMINANTS))


def without_ids(df: DataFrame, ids: DataFrame, column: str = S.PROTEIN, most_inline: int = 2000) -> DataFrame:
    """Rows whose name contains none of the ids (one string column). Few ids become one pattern; of more, the parts of every distinct name that are as long as an id meet the ids in a join on equality."""
    ids = ids.select(F.trim(F.col(ids.columns[0])).alias("__id")).where("__id <> ''").distinct()
    few = [r[0] for r in ids.limit(most_inline + 1).collect()]
    if len(few) > most_inline:
        lengths = F.array(*[F.lit(r[0]) for r in ids.select(F.length("__id")).distinct().collect()])
        names = df.select(F.col(column).alias("__name")).where("__name is not null").distinct()
        fitting = F.filter(lengths, lambda n: n <= F.length("__name"))
        parts = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length("__name") - n + 1), lambda i: F.substring(F.col("__name"), i, n))))
        named = names.select("__name", F.explode(parts).alias("__id")).join(ids, "__id", "left_semi").select("__name").distinct()
        return df.join(named, F.col(column) == F.col("__name"), "left_anti")
    return df.where(~F.col(column).rlike("|".join(map(re.escape, few)))) if few else df


def tech_replicates(df: DataFrame) -> DataFrame:
    """Adds TechReplicate: the number after the last '_' of every run, or, unless all runs have one, the rank of the run's name."""
    runs = df.select(S.RUN).distinct().withColumn("__n", trailing_number(F.col(S.RUN)))
    # runs are files: a short list, ranked in one window
    ranked = runs.withColumn("__all", F.min(F.col("__n").isNotNull()).over(Window.partitionBy())).withColumn("__rank", F.dense_rank().over(Window.orderBy(S.RUN)))
    named = ranked.select(S.RUN, F.when(F.col("__all"), F.col("__n")).otherwise(F.col("__rank")).alias(S.TECHREP))
    return df.drop(S.TECHREP).join(named, S.RUN)


def initial_filter(df: DataFrame, min_aa: int = 7, run_level: bool = False) -> DataFrame:
    """Rows that enter normalization, with parsed accessions, TechReplicate and the peptide table's columns."""
    kept = df.where((F.col(S.INTENSITY) > 0) & (F.col(S.CONDITION).isNull() | (F.col(S.CONDITION) != "Empty")) & F.col(S.RUN).isNotNull() & (F.length(S.PEPTIDE) >= min_aa))
    if S.FRACTION not in kept.columns:
        kept = kept.withColumn(S.FRACTION, F.lit(1))
    kept = tech_replicates(kept.withColumn(S.PROTEIN, uniprot_accession(F.col(S.PROTEIN))))
    names = [S.PROTEIN, S.PEPTIDOFORM, S.PEPTIDE, S.CHARGE, S.INTENSITY, S.CONDITION, S.TECHREP, S.BIOREP, S.FRACTION, S.SAMPLE]
    return kept.select(*names, *([S.RUN] if run_level else []))


def min_unique_peptides(df: DataFrame, n: int, per_sample: bool = True, peptide: str = S.PEPTIDE) -> DataFrame:
    """Rows of proteins with ``n`` distinct peptides, in their sample or anywhere."""
    keys = [S.SAMPLE, S.PROTEIN] if per_sample else [S.PROTEIN]
    enough = df.groupBy(*keys).agg(F.countDistinct(peptide).alias("__n")).where(F.col("__n") >= n).select(*keys)
    return df.join(enough, keys, "left_semi")


def low_frequency_pairs(features: DataFrame, share: float = 0.2, sample: str = S.SAMPLE, peptide: str = S.PEPTIDE, protein: str = S.PROTEIN) -> DataFrame:
    """(protein, peptide) pairs seen in fewer than ``share`` of all samples."""
    n = features.agg(F.countDistinct(sample).alias("__all"))
    counts = features.groupBy(protein, peptide).agg(F.countDistinct(sample).alias("__n"))
    return counts.crossJoin(F.broadcast(n)).where(F.col("__n") < F.lit(share) * F.col("__all")).select(protein, peptide)
