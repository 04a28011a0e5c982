"""Scalar expressions over accessions, peptides and intensities. All are built-in functions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic residue masses in dalton, and of water.
RESIDUE_MASS = {
    "A": 71.03711, "R": 156.10111, "N": 114.04293, "D": 115.02694, "C": 103.00919, "E": 129.04259, "Q": 128.05858, "G": 57.02146, "H": 137.05891, "I": 113.08406,
    "L": 113.08406, "K": 128.09496, "M": 131.04049, "F": 147.06841, "P": 97.05276, "S": 87.03203, "T": 101.04768, "W": 186.07931, "Y": 163.06333, "V": 99.06841, "U": 150.95364, "O": 237.14773,
}
WATER = 18.010565
#: Letters that a mass is defined for, by the iBAQ path; letters that the FASTA path strips.
STANDARD = "ARNDBCEQZGHILKMFPSTWYV"
STRIPPED = "XBZJUO"
#: Cleavage rules, as the zero-width place of a cut.
ENZYMES = {
    "trypsin": r"(?<=[KR])(?!P)", "trypsin/p": r"(?<=[KR])", "lys-c": r"(?<=K)(?!P)", "lys-c/p": r"(?<=K)", "arg-c": r"(?<=R)(?!P)", "glu-c": r"(?<=[DE])(?!P)",
    "asp-n": r"(?=D)", "chymotrypsin": r"(?<=[FYWL])(?!P)", "chymotrypsin/p": r"(?<=[FYWL])", "pepsin": r"(?<=[FL])", "cnbr": r"(?<=M)",
}


def not_nan(c: Column) -> Column:
    """NaN as null, in double."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def uniprot_accession(c: Column) -> Column:
    """Of each ';'-joined part with exactly two pipes the middle; other parts stay."""
    parts = F.transform(F.split(c, ";"), lambda x: F.when(F.size(F.split(x, r"\|")) == 3, F.get(F.split(x, r"\|"), 1)).otherwise(x))
    return F.array_join(parts, ";")


def accession(c: Column) -> Column:
    """The part after the first pipe and before the next; without a pipe the whole."""
    return F.coalesce(F.get(F.split(c, r"\|"), 1), c)


def first_accession(accessions: Column) -> Column:
    """Accession of the first element; of a null or empty array the empty string."""
    return F.coalesce(accession(F.get(accessions, 0)), F.lit(""))


def canonical_peptide(c: Column) -> Column:
    """A peptidoform without bracketed modifications, dots and dashes."""
    return F.regexp_replace(F.regexp_replace(c, r"[\(\[].*?[\)\]]", ""), r"[.\-]", "")


def unmodified_length(c: Column) -> Column:
    """Length without [..] and (..); null: 0."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", ""), r"\(.*?\)", "")), F.lit(0))


def missed_cleavages(c: Column) -> Column:
    """K or R before another letter than P, the last letter of the sequence left out; of one letter nothing is left out."""
    s = F.upper(c)
    inner = F.when(F.length(s) > 1, s.substr(F.lit(1), F.length(s) - 1)).otherwise(s)
    return F.size(F.regexp_extract_all(inner, F.lit("[KR](?=[^P])"), F.lit(0)))


def digest(c: Column, enzyme: str = "trypsin", min_aa: int = 7, max_aa: int = 30) -> Column:
    """Peptides of a full digestion within the length window, repeats included."""
    try:
        rule = ENZYMES[enzyme.lower()]
    except KeyError:
        raise ValueError(f"unknown enzyme {enzyme!r}; known: {', '.join(ENZYMES)}") from None
    return F.filter(F.split(c, rule), lambda x: F.length(x).between(min_aa, max_aa))


def standard_letters(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{STANDARD}]", "")


def nonstandard_letters(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, f"[{STANDARD}]", ""), ""), lambda x: x != "")


def stripped_letters(c: Column) -> Column:
    return F.translate(c, STRIPPED, "")


def monoisotopic_mass(c: Column) -> Column:
    """Sum of residue masses and one water, counted letter by letter kind; letters without a mass weigh nothing; empty: null."""
    total = F.lit(WATER)
    for aa, mass in RESIDUE_MASS.items():
        total = total + (F.length(c) - F.length(F.replace(c, F.lit(aa), F.lit("")))) * F.lit(mass)
    return F.when(F.length(c) > 0, total)


def log2(c: Column) -> Column:
    """Null for zero and below."""
    return F.when(c > 0, F.log2(c))


def batch_prefix(sample: Column) -> Column:
    return F.get(F.split(sample, "-"), 0)


def trailing_number(run: Column) -> Column:
    """The integer after the last '_' (or the whole, if there is none); null if it is none."""
    return F.try_element_at(F.split(run, "_"), F.lit(-1)).try_cast("int")
