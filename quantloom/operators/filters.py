"""Quality filters over long peptide tables, and pipelines of them.

A filter is a rule from DataFrame to DataFrame: a row predicate, or an aggregate by key and a semi join on
it. ``scope='dataset'`` judges keys over all samples; ``scope='sample'`` adds the sample to every key.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom import schema as S
from quantloom.functions import expressions as X
from quantloom.operators.pairs import pair_sums, vectors


@dataclass
class FilterResult:
    """What a filter did; the counts are jobs, run when asked for."""

    name: str
    before: DataFrame
    after: DataFrame
    skipped: str | None = None

    @property
    def input_count(self) -> int:
        return self.before.count()

    @property
    def passed_count(self) -> int:
        return self.after.count()

    @property
    def removed_count(self) -> int:
        return self.input_count - self.passed_count


@dataclass
class Filter:
    """``needs``: columns without which the filter does nothing. Subclass or give a rule."""

    name: str
    rule: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> tuple[DataFrame, FilterResult]:
        missing = [c for c in self.needs if c not in df.columns]
        out = df if missing else self.rule(df)
        return out, FilterResult(self.name, df, out, f"no column {', '.join(missing)}" if missing else None)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)[0]


def _rows(name: str, keep: Column, *needs: str) -> Filter:
    return Filter(name, lambda df: df.where(keep), needs)


def _groups(name: str, keys: list[str], keep: Column, needs: tuple[str, ...], scope: str = "dataset", optional: tuple[str, ...] = (), **aggs: Column) -> Filter:
    def rule(df: DataFrame) -> DataFrame:
        by = [*(c for c in optional if c in df.columns), *([S.SAMPLE] if scope == "sample" and S.SAMPLE not in keys else []), *keys]
        good = df.groupBy(*by).agg(*[a.alias(k) for k, a in aggs.items()]).where(keep).select(*by)
        on = [df[c].eqNullSafe(good[c]) for c in by]
        cond = on[0]
        for o in on[1:]:
            cond &= o
        return df.join(good, cond, "left_semi")

    return Filter(name, rule, needs)


def min_intensity(least: float, column: str = S.NORM) -> Filter:
    return _rows("MinIntensity", F.col(column) >= least, column)


def cv_threshold(most: float, groupby: tuple[str, ...] = (S.PROTEIN, S.PEPTIDE), column: str = S.NORM, scope: str = "dataset") -> Filter:
    """Groups whose standard deviation over mean is at most ``most``, or has no value (one row, or a mean of zero or less)."""
    x = F.col(column)
    return _groups("CVThreshold", list(groupby), F.col("cv").isNull() | (F.col("cv") <= most), (*groupby, column), scope, cv=F.when((F.count(F.lit(1)) > 1) & (F.avg(x) > 0), X.ratio(F.stddev_samp(x), F.avg(x))))


def replicate_agreement(least: int, scope: str = "dataset") -> Filter:
    return _groups("ReplicateAgreement", [S.PROTEIN, S.PEPTIDE], F.col("n") >= least, (S.PROTEIN, S.PEPTIDE, S.SAMPLE), scope, (S.CONDITION,), n=F.countDistinct(S.SAMPLE))


def quantile_range(lower: float = 0.0, upper: float = 1.0, column: str = S.NORM, exact: bool = True, accuracy: int = 100_000) -> Filter:
    """Rows between two quantiles of the whole column; ``exact=False`` takes approximate ones, which combine before the shuffle."""

    def rule(df: DataFrame) -> DataFrame:
        q = F.percentile(column, [lower, upper]) if exact else F.percentile_approx(column, [lower, upper], accuracy)
        # one row
        bounds = F.broadcast(df.agg(q.alias("__q")).select(F.get("__q", F.lit(0)).alias("__lo"), F.get("__q", F.lit(1)).alias("__hi")))
        return df.join(bounds, F.col(column).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")

    return Filter("Quantile", rule, (column,))


def peptide_length(least: int = 7, most: int = 50, column: str = S.PEPTIDE) -> Filter:
    return _rows("PeptideLength", X.unmodified_length(F.col(column)).between(least, most), column)


def charge_state(allowed: list[int], column: str = S.CHARGE) -> Filter:
    return _rows("ChargeState", F.col(column).isin(list(allowed)), column)


def modification(exclude: list[str], column: str = S.PEPTIDOFORM) -> Filter:
    pattern = "(?i)" + "|".join(map(re.escape, exclude))
    return _rows("Modification", ~F.coalesce(F.col(column).rlike(pattern), F.lit(False)), column)


def missed_cleavage(most: int, enzyme: str = "trypsin", column: str = S.PEPTIDE) -> Filter:
    """Only trypsin's missed cleavages are counted; for other enzymes all rows pass if ``most`` is 0 or more."""
    n = X.missed_cleavages(F.col(column)) if enzyme.lower() == "trypsin" else F.lit(0)
    return _rows("MissedCleavage", n <= most, column)


def search_score(least: float, column: str = "searchScore") -> Filter:
    return _rows("SearchScore", F.col(column) >= least, column)


def sequence_pattern(exclude: list[str], column: str = S.PEPTIDE) -> Filter:
    return _rows("SequencePattern", ~F.coalesce(F.col(column).rlike("|".join(f"(?:{p})" for p in exclude)), F.lit(False)), column)


def fdr(most: float = 0.01, column: str = "q_value") -> Filter:
    return _rows("FDR", F.col(column) <= most, column)


def contaminants(patterns: list[str] = ("CONTAMINANT", "ENTRAP", "DECOY"), column: str = S.PROTEIN) -> Filter:
    """Names that contain a pattern, whatever the case, go."""
    return _rows("Contaminant", ~F.coalesce(F.upper(column).rlike("|".join(re.escape(p.upper()) for p in patterns)), F.lit(False)), column)


def min_peptides(min_unique: int = 2, min_rows: int = 1, scope: str = "dataset") -> Filter:
    """Proteins with ``min_unique`` distinct peptides; without a peptide column, with ``min_rows`` rows."""

    def rule(df: DataFrame) -> DataFrame:
        if S.PEPTIDE in df.columns:
            return _groups("", [S.PROTEIN], F.col("n") >= min_unique, (), scope, n=F.countDistinct(S.PEPTIDE))(df)
        return _groups("", [S.PROTEIN], F.col("n") >= min_rows, (), scope, n=F.count(F.lit(1)))(df)

    return Filter("MinPeptide", rule, (S.PROTEIN,))


def protein_fdr(most: float = 0.01, column: str = "protein_q_value", scope: str = "dataset") -> Filter:
    return _groups("ProteinFDR", [S.PROTEIN], F.col("q") <= most, (S.PROTEIN, column), scope, q=F.min(column))


def coverage(least: float, column: str = "coverage", scope: str = "dataset") -> Filter:
    return _groups("Coverage", [S.PROTEIN], F.col("c") >= least, (S.PROTEIN, column), scope, c=F.max(column))


def razor_peptides(handling: S.RazorHandling | str) -> Filter:
    """Peptides of several proteins: kept, removed, or given to the protein with most distinct peptides (of several, the first by name)."""
    how = handling if isinstance(handling, S.RazorHandling) else S.RazorHandling.from_str(handling)

    def rule(df: DataFrame) -> DataFrame:
        if how is S.RazorHandling.KEEP:
            return df
        pairs = df.select(S.PEPTIDE, S.PROTEIN).distinct()
        if how is S.RazorHandling.REMOVE:
            shared = pairs.groupBy(S.PEPTIDE).count().where("count > 1").select(S.PEPTIDE)
            return df.join(shared, S.PEPTIDE, "left_anti")
        sizes = pairs.groupBy(S.PROTEIN).agg(F.count(F.lit(1)).alias("__n"))
        top = pairs.join(sizes, S.PROTEIN).groupBy(S.PEPTIDE).agg(F.min_by(S.PROTEIN, F.struct(-F.col("__n"), F.col(S.PROTEIN))).alias(S.PROTEIN))
        return df.join(top, [S.PEPTIDE, S.PROTEIN], "left_semi")

    return Filter("RazorPeptide", rule, (S.PEPTIDE, S.PROTEIN))


def run_intensity(least: float, run: str = S.RUN, column: str = S.NORM) -> Filter:
    return _groups("RunIntensity", [run], F.col("s") >= least, (run, column), s=F.sum(column))


def min_features(least: int, min_proteins: int = 0, run: str = S.RUN) -> Filter:
    keep = F.col("n") >= least
    return _groups("MinFeatures", [run], keep & (F.col("p") >= min_proteins) if min_proteins > 0 else keep, (run, S.PROTEIN), n=F.count(F.lit(1)), p=F.countDistinct(S.PROTEIN))


def missing_rate(most: float, run: str = S.RUN, column: str = S.NORM) -> Filter:
    missing = F.avg(F.when(F.col(column).isNull() | (F.col(column) == 0), 1.0).otherwise(0.0))
    return _groups("MissingRate", [run], F.col("m") <= most, (run, column), m=missing)


def sample_correlations(df: DataFrame, column: str = S.NORM) -> DataFrame:
    """(a, b, r): Pearson's r of every two samples, and of each with itself, over the protein means that both have.

    r is null where a side does not vary. Values are taken from their sample's mean first, which keeps the
    sums small; pairs are added up from packed proteins.
    """
    x = df.where(F.col(column).isNotNull()).groupBy(S.PROTEIN, S.SAMPLE).agg(F.avg(column).alias("x"))
    # a row per sample
    means = F.broadcast(x.groupBy(S.SAMPLE).agg(F.avg("x").alias("m")))
    names, packed = vectors(x.join(means, S.SAMPLE).withColumn("x", F.col("x") - F.col("m")), S.PROTEIN, S.SAMPLE, "x")
    p = pair_sums(packed, len(names))
    half = lambda s, q: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    # what is left of a constant side is rounding
    varies = lambda s, q: F.when(half(s, q) > 1e-12 * F.greatest(F.col(q), F.lit(1.0)), half(s, q)).otherwise(0.0)
    r = X.ratio(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(varies("sx", "sxx") * varies("sy", "syy")))
    name = lambda c: F.get(F.array(*[F.lit(n) for n in names]), F.col(c))
    both = p.withColumn("r", r).select("r", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("e"))
    return both.select("e.i", "e.j", "r").select(name("i").alias("a"), name("j").alias("b"), "r") if names else both.select(F.lit("").alias("a"), F.lit("").alias("b"), "r")


def sample_correlation(least: float, column: str = S.NORM) -> Filter:
    """Samples whose mean correlation with all samples, themselves included, is less than ``least`` go; those without any stay."""

    def rule(df: DataFrame) -> DataFrame:
        low = sample_correlations(df, column).groupBy("a").agg(F.avg("r").alias("m")).where(F.col("m") < least).select(F.col("a").alias(S.SAMPLE))
        return df.join(low, S.SAMPLE, "left_anti")

    return Filter("SampleCorrelation", rule, (S.PROTEIN, S.SAMPLE, column))


def min_proteins_per_sample(least: int) -> Filter:
    return _groups("MinProteins", [S.SAMPLE], F.col("n") >= least, (S.SAMPLE, S.PROTEIN), n=F.countDistinct(S.PROTEIN))


def missing_values(most_percent: float, column: str) -> Filter:
    """Samples that lack a value for more than ``most_percent`` of the proteins that have any; samples without values go."""

    def rule(df: DataFrame) -> DataFrame:
        has = df.where(F.col(column).isNotNull())
        total = F.broadcast(has.agg(F.countDistinct(S.PROTEIN).alias("__all")))
        good = has.groupBy(S.SAMPLE).agg(F.countDistinct(S.PROTEIN).alias("__n")).join(total).where(F.lit(100.0) * (F.col("__all") - F.col("__n")) / F.col("__all") <= most_percent).select(S.SAMPLE)
        return df.join(good, S.SAMPLE, "left_semi")

    return Filter("MissingValues", rule, (S.SAMPLE, S.PROTEIN, column))


def no_single_sample_batches(batch: str = "batch") -> Filter:
    return _groups("SingleSampleBatch", [batch], F.col("n") > 1, (batch, S.SAMPLE), n=F.countDistinct(S.SAMPLE))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark drops rows beyond rank n before the shuffle, too."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


@dataclass
class FilterPipeline:
    name: str = "filters"
    filters: list[Filter] = field(default_factory=list)

    def add(self, *filters: Filter) -> FilterPipeline:
        self.filters += filters
        return self

    def __len__(self) -> int:
        return len(self.filters)

    def apply(self, df: DataFrame, stop_on_empty: bool = False) -> tuple[DataFrame, list[FilterResult]]:
        """All filters in turn; ``stop_on_empty`` leaves out the rest once no rows are left, at the price of a job per filter."""
        results = []
        for f in self.filters:
            df, r = f.apply(df)
            results.append(r)
            if stop_on_empty and df.isEmpty():
                break
        return df, results

    @staticmethod
    def summary(results: list[FilterResult]) -> list[dict[str, object]]:
        return [{"filter": r.name, "in": r.input_count, "out": r.passed_count, "skipped": r.skipped} for r in results]


#: The settings of each section and their defaults.
DEFAULTS = {
    "intensity": {"min_intensity": 0.0, "cv_threshold": None, "min_replicate_agreement": 1, "quantile_lower": 0.0, "quantile_upper": 1.0, "remove_zero_intensity": True},
    "peptide": {"allowed_charge_states": None, "exclude_modifications": [], "max_missed_cleavages": None, "min_search_score": None, "min_peptide_length": 7, "max_peptide_length": 50, "exclude_sequence_patterns": [], "fdr_threshold": 0.01},
    "protein": {"fdr_threshold": 0.01, "min_coverage": 0.0, "min_peptides": 1, "min_unique_peptides": 2, "remove_contaminants": True, "remove_decoys": True, "contaminant_patterns": ["CONTAMINANT", "ENTRAP", "DECOY"], "razor_peptide_handling": "keep"},
    "run_qc": {"min_total_intensity": 0.0, "min_identified_features": 0, "min_identified_proteins": 0, "max_missing_rate": 1.0, "min_sample_correlation": None},
}


def pipeline_of(config: dict, scope: str = "dataset") -> FilterPipeline:
    """The filters that a configuration turns on: of runs, then of intensities, peptides and proteins."""
    c = {k: v | (config.get(k) or {}) for k, v in DEFAULTS.items()}
    out = FilterPipeline(config.get("name", "filters"))
    if not config.get("enabled", True):
        return out
    q, i, p, r = c["run_qc"], c["intensity"], c["peptide"], c["protein"]
    if q["min_total_intensity"] > 0:
        out.add(run_intensity(q["min_total_intensity"]))
    if q["min_identified_features"] > 0 or q["min_identified_proteins"] > 0:
        out.add(min_features(q["min_identified_features"], q["min_identified_proteins"]))
    if q["max_missing_rate"] < 1:
        out.add(missing_rate(q["max_missing_rate"]))
    if q["min_sample_correlation"] is not None:
        out.add(sample_correlation(q["min_sample_correlation"]))
    if i["min_intensity"] > 0 or i["remove_zero_intensity"]:
        out.add(min_intensity(max(i["min_intensity"], 1e-10) if i["remove_zero_intensity"] else i["min_intensity"]))
    if i["cv_threshold"] is not None:
        out.add(cv_threshold(i["cv_threshold"], scope=scope))
    if i["min_replicate_agreement"] > 1:
        out.add(replicate_agreement(i["min_replicate_agreement"], scope))
    if i["quantile_lower"] > 0 or i["quantile_upper"] < 1:
        out.add(quantile_range(i["quantile_lower"], i["quantile_upper"]))
    out.add(peptide_length(p["min_peptide_length"], p["max_peptide_length"]))
    if p["allowed_charge_states"]:
        out.add(charge_state(p["allowed_charge_states"]))
    if p["exclude_modifications"]:
        out.add(modification(p["exclude_modifications"]))
    if p["max_missed_cleavages"] is not None:
        out.add(missed_cleavage(p["max_missed_cleavages"]))
    if p["min_search_score"] is not None:
        out.add(search_score(p["min_search_score"]))
    if p["exclude_sequence_patterns"]:
        out.add(sequence_pattern(p["exclude_sequence_patterns"]))
    if p["fdr_threshold"] < 1:
        out.add(fdr(p["fdr_threshold"]))
    if r["remove_contaminants"] or r["remove_decoys"]:
        out.add(contaminants(r["contaminant_patterns"]))
    if r["min_peptides"] > 0 or r["min_unique_peptides"] > 0:
        out.add(min_peptides(r["min_unique_peptides"], r["min_peptides"], scope))
    if r["fdr_threshold"] < 1:
        out.add(protein_fdr(r["fdr_threshold"], scope=scope))
    if r["min_coverage"] > 0:
        out.add(coverage(r["min_coverage"], scope=scope))
    if r["razor_peptide_handling"] != "keep":
        out.add(razor_peptides(r["razor_peptide_handling"]))
    return out


def load_config(path: str) -> dict:
    """A YAML or JSON file of filter settings."""
    import json

    with open(path) as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f) or {}


def save_config(config: dict, path: str) -> None:
    import json

    with open(path, "w") as f:
        if path.endswith(".json"):
            json.dump(config, f, indent=2)
        else:
            import yaml

            yaml.safe_dump(config, f, sort_keys=False)


def example_config() -> dict:
    return {"name": "example", "enabled": True, **{k: dict(v) for k, v in DEFAULTS.items()}}


def with_overrides(config: dict, **overrides: object) -> dict:
    """Settings named ``section__setting`` replaced where the value is not None."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in config.items()}
    for k, v in overrides.items():
        if v is not None:
            section, _, name = k.partition("__")
            out.setdefault(section, {})[name] = v
    return out
