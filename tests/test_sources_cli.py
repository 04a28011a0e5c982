import pytest
from pyspark.sql import functions as F

from quantloom import cli
from quantloom import schema as S
from quantloom.plans import workflows
from quantloom.sources import readers, sinks


@pytest.fixture()
def feature_file(spark, tmp_path):
    spark.createDataFrame(
        [("PEPTIDEK", "PEPTIDEK", ["sp|P1|A_HUMAN"], 2, "r_1", 1, [("s1", "LFQ", 5.0), ("s2", "LFQ", 0.0)]), ("AAAAAAAK", "AAAAAAAK", ["sp|P1|A_HUMAN"], 2, "r_1", 1, [("s1", "LFQ", 7.0), ("s2", "LFQ", float("nan"))])],
        "sequence string, peptidoform string, pg_accessions array<string>, precursor_charge int, reference_file_name string, unique int, intensities array<struct<sample_accession:string,channel:string,intensity:double>>",
    ).write.parquet(str(tmp_path / "f.parquet"))
    return str(tmp_path / "f.parquet")


def test_unnest_drops_zero_nan_and_empty(spark, feature_file):
    long = readers.features_long(spark.read.parquet(feature_file))
    assert [(r.sample_accession, r.intensity, r.condition) for r in long.orderBy("intensity").collect()] == [("s1", 5.0, "s1"), ("s1", 7.0, "s1")]


def test_sdrf_header_and_join(spark, tmp_path, feature_file):
    p = tmp_path / "x.sdrf.tsv"
    p.write_text("Source Name\tcharacteristics[organism part]\tcharacteristics[organism part]\tfactor value[x]\ns1\tbrain\tcortex\tA\ns1\tbrain\tcortex\tA\n")
    sdrf = readers.load_sdrf(spark, str(p))
    assert sdrf.columns == ["source name", "characteristics[organism part]", "characteristics[organism part].1", "factor value[x]"]
    long = readers.features_long(spark.read.parquet(feature_file))
    joined = readers.with_sdrf(long, sdrf)
    assert joined.count() == 2 and joined.first()["condition"] == "A"
    assert readers.with_sdrf(long, sdrf, dedupe=False).count() == 4


def test_fasta_ids_tsv(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">sp|P1|A some text\nAAK\nccr\n>Q2\nGG\n")
    assert sorted(tuple(r) for r in readers.load_fasta(spark, str(tmp_path / "x.fasta")).collect()) == [("Q2", "Q2", "GG"), ("sp|P1|A", "P1", "AAKCCR")]
    for n, text in (("a", "#c\nx\ty\n1\t2\n"), ("b", "y\tx\n3\t4\n")):
        (tmp_path / f"{n}-ibaq.tsv").write_text(text)
    assert readers.combine_tsv(spark, str(tmp_path), "*ibaq.tsv").count() == 2
    with pytest.raises(FileNotFoundError):
        readers.combine_tsv(spark, str(tmp_path), "none*")
    (tmp_path / "c-ibaq.tsv").write_text("z\n1\n")
    with pytest.raises(ValueError):
        readers.combine_tsv(spark, str(tmp_path), "*ibaq.tsv")


def test_sniff_and_load(spark, tmp_path, feature_file):
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert readers.is_parquet(spark, feature_file + "/*.parquet") and not readers.is_parquet(spark, str(tmp_path / "a.csv")) and not readers.is_parquet(spark, "/nowhere")
    assert readers.load_table(spark, str(tmp_path / "a.csv")).count() == 1
    with pytest.raises(ValueError):
        readers.load_table(spark, "a.xyz")


def test_matrix_bundle(spark):
    df = spark.createDataFrame([("s", "p", 1.0, 2.0, "c")], "s string, p string, x double, y double, cond string")
    b = sinks.annotated_matrix(df, "s", "p", "x", ["y"], ["cond", "none"])
    assert b.x.collect()[0]["p"] == 1.0 and b.layers["y"].collect()[0]["p"] == 2.0 and b.warnings == ["no column none"]
    with pytest.raises(ValueError):
        sinks.annotated_matrix(df.limit(0), "s", "p", "x")


def test_cli_flows(spark, tmp_path, feature_file):
    out = str(tmp_path / "pep.csv")
    cli.main(["features2peptides", "-p", feature_file, "-o", out], spark)
    got = spark.read.csv(out, header=True, inferSchema=True)
    assert got.count() == 2 and got.select(F.sum("NormIntensity")).first()[0] == 12.0
    cli.main(["features2proteins", "-p", feature_file, "-o", str(tmp_path / "prot.parquet"), "--quant-method", "sum"], spark)
    assert spark.read.parquet(str(tmp_path / "prot.parquet")).first()["SumIntensity"] == 12.0
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        cli.main(["features2proteins", "-p", feature_file, "-o", str(tmp_path / "prot.parquet"), "--quant-method", "sum"], spark)
    cli.main(["features2peptides", "-p", "x", "-o", "y", "--generate-filter-config", str(tmp_path / "f.yaml")], spark)
    assert (tmp_path / "f.yaml").read_text().startswith("name: example")


def test_folder_of_datasets(spark, tmp_path):
    for k, organism in ((1, "HUMAN"), (2, "MOUSE")):
        (tmp_path / f"PXD{k}").mkdir()
        (tmp_path / f"PXD{k}" / "x.sdrf.tsv").write_text(f"source name\tcharacteristics[organism part]\nPXD{k}-S1\tbrain{k}\n")
        (tmp_path / f"PXD{k}" / "x-ibaq.csv").write_text(f"ProteinName,SampleID,Ibaq\nA_{organism},PXD{k}-S1,1.5\nB_HUMAN,PXD{k}-S1,2.5\n")
    got = workflows.combine_folder(spark, str(tmp_path))
    assert sorted((r.ProteinName, r.SampleID, r.tissue, r.batch_code) for r in got.collect()) == [("A_HUMAN", "PXD1-S1", "brain1", 0), ("B_HUMAN", "PXD1-S1", "brain1", 0), ("B_HUMAN", "PXD2-S1", "brain2", 1)]
    (tmp_path / "PXD3").mkdir()
    (tmp_path / "PXD3" / "y.sdrf.tsv").write_text("source name\tcharacteristics[organism part]\n")
    with pytest.raises(ValueError):
        readers.dataset_files(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.dataset_files(spark, str(tmp_path / "PXD3" / "none"))


def test_sdrf_channels(spark):
    sdrf = spark.createDataFrame([("s1", "TMT126"), ("s2", "TMT131"), ("s3", "other")], "`source name` string, `comment[label]` string")
    assert sorted((r[0], r.Channel if "Channel" in sdrf.columns else r[2]) for r in readers.sdrf_channels(sdrf, "TMT6plex").collect()) == [("s1", 1), ("s2", 6), ("s3", None)]


@pytest.mark.parametrize(
    ("labels", "found"),
    [
        (["label free sample"], (S.LabelClass.LFQ, None)),
        ([f"TMT{c}" for c in (126, 127, 128, 129, 130, 131)], (S.LabelClass.TMT, "TMT6plex")),
        (["TMT126", "TMT127N", "TMT131"], (S.LabelClass.TMT, "TMT10plex")),
        (["TMT126", "TMT131C"], (S.LabelClass.TMT, "TMT11plex")),
        (["TMT133N"], (S.LabelClass.TMT, "TMT16plex")),
        (["ITRAQ114", "ITRAQ117"], (S.LabelClass.ITRAQ, "ITRAQ4plex")),
        (["ITRAQ113", "ITRAQ121"], (S.LabelClass.ITRAQ, "ITRAQ8plex")),
        ([f"tmt channel {i}" for i in range(9)], (S.LabelClass.TMT, "TMT10plex")),
    ],
)
def test_plexes(labels, found):
    assert S.classify_labels(labels) == found


def test_cli_exports(spark, tmp_path, feature_file):
    out = str(tmp_path / "top.csv")
    cli.main(["features2proteins", "-p", feature_file, "-o", out, "--quant-method", "sum", "--keep-contaminants", "--export-peptides", str(tmp_path / "pep.parquet")], spark)
    assert spark.read.parquet(str(tmp_path / "pep.parquet")).count() == 2
    cli.main(["features2peptides", "-p", feature_file, "-o", str(tmp_path / "p.csv"), "--save_parquet", "--filter-max-missing-rate", "0.9"], spark)
    assert spark.read.parquet(str(tmp_path / "p.parquet")).count() == 2


def test_tables_by_suffix_and_content(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ProteinName,SampleID,NormIntensity\nP1,S1,2.5\nP1,S2,0\nP2,S1,\n")
    made = readers.csv_to_parquet(spark, str(tmp_path / "a.csv"))
    assert made == str(tmp_path / "a.parquet") and spark.read.parquet(made).count() == 3
    assert [tuple(r) for r in readers.load_peptides(spark, str(tmp_path / "a.csv")).collect()] == [("P1", "S1", 2.5)]
    assert readers.load_table(spark, made).count() == 3
    (tmp_path / "ids.txt").write_text(" P1 \n\nP9\n")
    assert [r[0] for r in readers.load_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["P1", "P9"]
    assert readers.in_samples(spark.createDataFrame([("a", 1), ("b", 2)], "sample_accession string, x int"), ["b"]).first()["x"] == 2


def test_writers_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("P1", 1.5)], "ProteinName string, x double")
    for name in ("t.parquet", "t.csv", "t.tsv"):
        path = str(tmp_path / name)
        sinks.write_table(df, path)
        assert readers.load_table(spark, path).collect()[0]["x"] == 1.5
        with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
            sinks.write_table(df, path)
        sinks.write_table(df, path, overwrite=True)
