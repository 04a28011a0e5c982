import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import schema as S
from quantloom.operators import alignment, batch, filters, ibaq, impute, normalize, outliers, quantify, reshape

COLS = f"{S.PROTEIN} string, {S.PEPTIDE} string, {S.SAMPLE} string, {S.NORM} double"


def frame(spark, rows, cols=COLS):
    return spark.createDataFrame(rows, cols)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_topn_takes_fewer_and_ignores_ties(spark):
    df = frame(spark, [("A", "p", "s", 4.0), ("A", "q", "s", 4.0), ("A", "r", "s", 1.0), ("A", "t", "s", None), ("B", "p", "s", 7.0)])
    assert rows(quantify.quantify_topn(df, 2), S.PROTEIN, "Top2Intensity") == [("A", 4.0), ("B", 7.0)]


def test_maxlfq_shifts_keep_the_total(spark):
    df = frame(spark, [("A", "p", "s1", 2.0), ("A", "p", "s2", 4.0), ("A", "q", "s1", 20.0), ("A", "q", "s2", 40.0), ("B", "p", "s1", 3.0), ("B", "p", "s2", 5.0)])
    got = {(r[0], r[1]): r[2] for r in quantify.quantify_maxlfq(df).collect()}
    assert got["A", "s2"] / got["A", "s1"] == pytest.approx(2.0)
    assert got["A", "s1"] + got["A", "s2"] == pytest.approx(66.0)
    assert got["B", "s1"] == 3.0  # one peptide only: the median of its rows


def test_maxlfq_with_one_sample_is_a_median(spark):
    df = frame(spark, [("A", p, "s", x) for p, x in (("p", 1.0), ("q", 2.0), ("r", 9.0))])
    assert rows(quantify.quantify_maxlfq(df), "MaxLFQIntensity") == [(2.0,)]


def test_run_normalization_is_not_a_no_op(spark):
    df = frame(spark, [("A", "p", "s", 1, 10.0), ("A", "p", "s", 2, 30.0), ("A", "p", "t", 1, 5.0)], f"{S.PROTEIN} string, {S.PEPTIDE} string, {S.SAMPLE} string, {S.TECHREP} int, {S.NORM} double")
    out = normalize.normalize_runs(df, S.RunNormalization.MEDIAN)
    assert rows(out, S.SAMPLE, S.NORM) == [("s", 20.0), ("s", 20.0), ("t", 5.0)]


def test_quantile_normalize_gives_values_not_ranks(spark):
    df = frame(spark, [("A", "", "s", 1.0), ("B", "", "s", 3.0), ("A", "", "t", 5.0), ("B", "", "t", 9.0)])
    assert rows(normalize.quantile_normalize(df, S.NORM), S.SAMPLE, S.NORM) == [("s", 3.0), ("s", 6.0), ("t", 3.0), ("t", 6.0)]


def test_filters_skip_missing_columns_and_keep_nulls(spark):
    df = frame(spark, [("A", "p", "s", 1.0), ("A", "p", "t", 1.5), (None, "q", "s", 5.0)])
    out, result = filters.fdr().apply(df)
    assert out.count() == 3 and result.skipped
    assert filters.cv_threshold(0.1)(df).count() == 1  # the single row has no deviation and stays
    assert filters.contaminants(["a"])(df).count() == 1
    assert filters.replicate_agreement(2)(df).count() == 2


def test_constant_samples_have_no_correlation_and_stay(spark):
    df = frame(spark, [(p, "x", s, 1.0) for p in "ABC" for s in "st"])
    assert filters.sample_correlation(0.9)(df).count() == 6


def test_razor(spark):
    df = frame(spark, [("A", "p", "s", 1.0), ("B", "p", "s", 1.0), ("B", "q", "s", 1.0), ("C", "r", "s", 1.0), ("D", "r", "s", 1.0)])
    assert rows(filters.razor_peptides("remove")(df), S.PROTEIN) == [("B",)]
    assert rows(filters.razor_peptides("assign_to_top")(df), S.PROTEIN, S.PEPTIDE) == [("B", "p"), ("B", "q"), ("C", "r")]


def test_config_pipeline(spark):
    config = filters.with_overrides(filters.example_config(), run_qc__min_identified_features=3, intensity__cv_threshold=0.3)
    names = [f.name for f in filters.pipeline_of(config).filters]
    assert names[:3] == ["MinFeatures", "MinIntensity", "CVThreshold"] and "Contaminant" in names
    assert len(filters.pipeline_of({"enabled": False})) == 0


def test_pivot(spark):
    df = frame(spark, [("A", "", "s", 1.0), ("B", "", "t", 2.0)])
    assert rows(reshape.pivot_wider(df, S.PROTEIN, S.SAMPLE, S.NORM, True), S.PROTEIN, "s", "t") == [("A", 1.0, 0.0), ("B", 0.0, 2.0)]
    with pytest.raises(ValueError):
        reshape.pivot_wider(df.unionAll(df), S.PROTEIN, S.SAMPLE, S.NORM)
    with pytest.raises(ValueError):
        reshape.pivot_wider(df, "no", S.SAMPLE, S.NORM)
    assert reshape.pivot_longer(reshape.pivot_wider(df, S.PROTEIN, S.SAMPLE, S.NORM), S.PROTEIN, "k", "v").count() == 4


def test_linear_and_quadratic_shifts_agree():
    base, off = np.linspace(15, 25, 100), np.array([0, 0.5, -0.3, 1.0])
    m = base[None, :] + off[:, None]
    for quadratic in (0, 50):
        s = alignment._matrix_shifts(m, quadratic, 10)
        assert np.ptp(s + off) < 1e-9


def test_two_samples_align(spark):
    df = frame(spark, [(f"P{i}", "", s, 10 + i / 4 + d) for i in range(20) for s, d in (("a", 0.0), ("b", 0.5))])
    out = alignment.align_samples(df, S.PROTEIN, S.SAMPLE, S.NORM)
    m = dict(out.groupBy(S.SAMPLE).agg(F.median(S.NORM)).collect())
    assert abs(m["a"] - m["b"]) < 0.01


def test_combat_brings_batches_together(spark):
    r = np.random.default_rng(1)
    data = [(f"P{i}", "", f"b{j % 2}-S{j}", float(10 + i % 7 + (2.0 if j % 2 else 0.0) + r.normal(0, 0.3))) for i in range(60) for j in range(12)]
    df = frame(spark, data)
    samples = batch.detect_batches(df.select(S.SAMPLE).distinct(), S.BatchSource.SAMPLE_PREFIX)
    for how in ({}, {"mean_only": True}, {"ref_batch": 0}):
        out = batch.combat(df, samples, S.NORM, **how)
        m = dict(out.groupBy(F.substring(S.SAMPLE, 1, 2)).agg(F.avg(S.NORM)).collect())
        assert abs(m["b0"] - m["b1"]) < 0.2 and out.count() == len(data)
    with pytest.raises(batch.TooFewSamplesInBatch):
        batch.combat(df.where(F.col(S.SAMPLE).startswith("b0") | (F.col(S.SAMPLE) == "b1-S1")), samples.where(F.col(S.SAMPLE).startswith("b0") | (F.col(S.SAMPLE) == "b1-S1")), S.NORM)


def test_covariates(spark):
    sdrf = spark.createDataFrame([("Sample1", "male", "x"), ("Sample2", "female", "x")], ["source name", "characteristics[sex]", "characteristics[tissue]"])
    samples = spark.createDataFrame([("Sample1",), ("pre-Sample2",), ("other",)], f"{S.SAMPLE} string")
    out = batch.covariates(samples, sdrf, ["sex"])
    assert {r[0]: r["sex"] for r in out.collect()} == {"Sample1": 1, "pre-Sample2": 0, "other": 2}
    assert batch.covariates(samples.limit(0), sdrf, ["nothing"]) is None


def test_impute_knn_and_constant(spark):
    df = frame(spark, [("A", "", "s", 1.0), ("A", "", "t", 2.0), ("B", "", "s", 1.1), ("C", "", "s", 9.0), ("C", "", "t", 8.0)])
    assert dict(((r[0], r[1]), r[2]) for r in impute.impute(df, S.NORM, "knn", 1).collect())["B", "t"] == 2.0
    assert dict(((r[0], r[1]), r[2]) for r in impute.impute(df, S.NORM, "constant", fill_value=-1.0).collect())["B", "t"] == -1.0
    with pytest.raises(ValueError):
        impute.impute(df, S.NORM, "guess")


def test_ibaq_groups(spark):
    fasta = spark.createDataFrame([("A", "AAAAAAAKCCCCCCCK"), ("B", "DDDDDDDK")], "accession string, sequence string")
    theory = ibaq.theoretical(fasta)
    df = spark.createDataFrame([("A", "s", "c", 8.0), ("A;B", "s", "c", 3.0), ("A;Z", "s", "c", 3.0)], f"{S.PROTEIN} string, {S.SAMPLE} string, {S.CONDITION} string, {S.NORM} double")
    got = {r[S.PROTEIN]: r[S.IBAQ] for r in ibaq.ibaq(df, ibaq.group_theory(df, theory)).collect()}
    assert got == {"A": 4.0, "A;B": 2.0}
    assert ibaq.group_theory(df, theory, strict_groups=True).count() == 1


def test_outliers(spark):
    r = np.random.default_rng(0)
    data = [(f"P{i}", "", f"s{j:02d}", float(i % 5 + r.normal(0, 0.05) + (50.0 * r.random() if j == 11 else 0.0))) for i in range(30) for j in range(12)]
    out = outliers.remove_outliers(frame(spark, data), S.NORM, 3, min_cluster_size=4, min_samples=3)
    left = {x[0] for x in out.select(S.SAMPLE).distinct().collect()}
    assert "s11" not in left and len(left) >= 8
    scores, share = outliers.pca(frame(spark, data), S.NORM, 2)
    assert scores.count() == 12 and share[0] > 0.5


def test_labels_and_enums():
    assert S.classify_labels(["label free sample"]) == (S.LabelClass.LFQ, None)
    assert S.classify_labels([f"TMT{c}" for c in ("126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131N", "131C")])[1] == "TMT11plex"
    assert S.classify_labels(["TMT126", "TMT134N"])[1] == "TMT16plex"
    assert S.classify_labels(["iTRAQ114"])[1] == "ITRAQ4plex"
    with pytest.raises(ValueError):
        S.classify_labels(["what"])
    assert S.SampleNormalization.from_str("global-median") is S.SampleNormalization.GLOBAL_MEDIAN
    assert len(S.channels("TMT16plex")) == 16
    with pytest.raises(ValueError):
        S.organism("yeti")
