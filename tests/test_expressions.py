import pytest
from pyspark.sql import functions as F

from quantloom.functions import expressions as X


def one(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").select(expr).collect()]


def test_accessions(spark):
    c = F.col("c")
    assert one(spark, ["sp|P1|A;tr|Q2|B;x", "a|b", None], X.uniprot_accession(c)) == ["P1;Q2;x", "a|b", None]
    assert one(spark, ["sp|P1|A", "P2", "a|b"], X.accession(c)) == ["P1", "P2", "b"]
    assert one(spark, [["sp|P1|A", "z"], [], None, ["q"]], X.first_accession(c), "array<string>") == ["P1", "", "", "q"]


def test_peptides(spark):
    c = F.col("c")
    assert one(spark, [".(Acetyl)PEP[+57]TI-DE", ""], X.canonical_peptide(c)) == ["PEPTIDE", ""]
    assert one(spark, ["AK(ox)LM[+1]", None], X.unmodified_length(c)) == [4, 0]
    assert one(spark, ["AKLKPRA", "AKL", "K", "AAK", ""], X.missed_cleavages(c)) == [1, 0, 0, 0, 0]


def test_digest(spark):
    seq = "AAAAAAAKPAAARBBBBBBBKCC"
    assert one(spark, [seq], X.digest(F.col("c"))) == [["AAAAAAAKPAAAR", "BBBBBBBK"]]
    with pytest.raises(ValueError, match="unknown enzyme"):
        X.digest(F.col("c"), "scissors")


def test_mass_and_letters(spark):
    got = one(spark, ["GG", "GXG", ""], X.monoisotopic_mass(F.col("c")))
    assert got[0] == pytest.approx(2 * 57.02146 + 18.010565) and got[1] == pytest.approx(got[0]) and got[2] is None
    assert one(spark, ["AXBZJUO"], X.standard_letters(F.col("c"))) == ["ABZ"]
    assert one(spark, ["AXBZJUO"], X.stripped_letters(F.col("c"))) == ["A"]
    assert one(spark, ["AXJ"], X.nonstandard_letters(F.col("c"))) == [["X", "J"]]


def test_numbers(spark):
    assert one(spark, [0.0, 8.0, None], X.log2(F.col("c")), "double") == [None, 3.0, None]
    assert one(spark, ["a_12", "a_b", "7"], X.trailing_number(F.col("c"))) == [12, None, 7]
    assert one(spark, [float("nan"), 1.0], X.not_nan(F.col("c")), "double") == [None, 1.0]
