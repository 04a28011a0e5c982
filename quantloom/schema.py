"""Column names, enumerations, channel plexes and organisms."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

PROTEIN, PEPTIDE, PEPTIDOFORM, CHARGE = "ProteinName", "PeptideCanonical", "PeptideSequence", "PrecursorCharge"
CHANNEL, CONDITION, BIOREP, TECHREP, RUN, FRACTION = "Channel", "Condition", "BioReplicate", "TechReplicate", "Run", "Fraction"
INTENSITY, NORM, REFERENCE, SAMPLE = "Intensity", "NormIntensity", "Reference", "SampleID"
IBAQ, IBAQ_NORM, IBAQ_LOG, IBAQ_PPB, TPA, MASS, COPIES = "Ibaq", "IbaqNorm", "IbaqLog", "IbaqPpb", "TPA", "MolecularWeight", "CopyNumber"
CONCENTRATION, WEIGHT, MOLES = "Concentration[nM]", "Weight[ng]", "Moles[nmol]"

#: Raw feature columns and their names in the peptide table.
RAW_TO_INTERNAL = {
    "pg_accessions": PROTEIN, "peptidoform": PEPTIDOFORM, "sequence": PEPTIDE, "precursor_charge": CHARGE, "channel": CHANNEL, "condition": CONDITION,
    "biological_replicate": BIOREP, "run": RUN, "fraction": FRACTION, "intensity": INTENSITY, "reference_file_name": REFERENCE, "sample_accession": SAMPLE,
}
ALIASES = {"protein_accessions": "pg_accessions", "charge": "precursor_charge"}
SAMPLE_ID = r"^[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*$"


class Named(Enum):
    """An enumeration that reads its members from text, whatever the case and whether '-', '_' or ' ' divides words."""

    @classmethod
    def from_str(cls, name: str):
        want = re.sub(r"[-_ ]", "", name).lower()
        for m in cls:
            if want in (re.sub(r"[-_ ]", "", m.name).lower(), re.sub(r"[-_ ]", "", str(m.value)).lower()):
                return m
        raise ValueError(f"{cls.__name__} has no {name!r}; it has {', '.join(m.name.lower() for m in cls)}")


class RunNormalization(Named):
    NONE, MEAN, MEDIAN, MAX, GLOBAL, MAX_MIN, IQR = "none", "mean", "median", "max", "global", "max_min", "iqr"


class SampleNormalization(Named):
    NONE, GLOBAL_MEDIAN, CONDITION_MEDIAN, HIERARCHICAL = "none", "globalMedian", "conditionMedian", "hierarchical"


class Summarization(Named):
    MEDIAN, MEAN, SUM, MAX = "median", "mean", "sum", "max"


class Quantification(Named):
    IBAQ, TOPN, TOP3, MAXLFQ, DIRECTLFQ, SUM, MEDIAN = "ibaq", "topn", "top3", "maxlfq", "directlfq", "sum", "median"


class Distance(Named):
    MEDIAN, VARIANCE, OVERLAP = "median", "variance", "overlap"


class BatchSource(Named):
    SAMPLE_PREFIX, RUN_NAME, FRACTION, TECHREPLICATE, EXPLICIT_COLUMN = "sample_prefix", "run", "fraction", "techreplicate", "column"


class RazorHandling(Named):
    KEEP, REMOVE, ASSIGN_TO_TOP = "keep", "remove", "assign_to_top"


class LabelClass(Named):
    LFQ, TMT, ITRAQ = "lfq", "tmt", "itraq"


#: Channels of the isobaric plexes, in order.
_TMT = ["126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131N", "131C", "132N", "132C", "133N", "133C", "134N"]
PLEXES = {
    "TMT6plex": ["TMT126", "TMT127", "TMT128", "TMT129", "TMT130", "TMT131"],
    "TMT10plex": [*(f"TMT{c}" for c in _TMT[:9]), "TMT131"],
    "TMT11plex": [f"TMT{c}" for c in _TMT[:11]],
    "TMT16plex": [f"TMT{c}" for c in _TMT],
    "ITRAQ4plex": [f"ITRAQ{c}" for c in (114, 115, 116, 117)],
    "ITRAQ8plex": [f"ITRAQ{c}" for c in (113, 114, 115, 116, 117, 118, 119, 121)],
}


def channels(plex: str) -> dict[str, int]:
    """Channel name -> position, from 1."""
    return {c: i for i, c in enumerate(PLEXES[plex], 1)}


def classify_labels(labels: list[str]) -> tuple[LabelClass, str | None]:
    """The label class of a set of distinct labels, and the smallest plex that has all their channels (or, where a label names none, as many)."""
    if len(labels) == 1 and re.search("(?i)lfq|label free", labels[0]):
        return LabelClass.LFQ, None
    for kind in (LabelClass.TMT, LabelClass.ITRAQ):
        family = sorted((p for p in PLEXES if p.upper().startswith(kind.name)), key=lambda p: len(PLEXES[p]))
        if any(kind.value in x.lower() for x in labels):
            named = {m[0] for x in labels if (m := re.search(rf"{kind.name}\d+[NC]?", x.upper()))}
            fits = [p for p in family if named <= set(PLEXES[p]) and len(labels) <= len(PLEXES[p])]
            return kind, (fits or [p for p in family if len(labels) <= len(PLEXES[p])] or family)[-1 if len(labels) > len(PLEXES[family[-1]]) else 0]
    raise ValueError(f"no label class for {labels}")


@dataclass(frozen=True)
class Organism:
    """``suffix`` ends the entry names of its proteins; histones are told by accession or by entry name."""

    name: str
    genome_size: float
    suffix: str

    @property
    def histone_accessions(self) -> list[str]:
        return HISTONES[self.name].split()

    @property
    def histone_pattern(self) -> str:
        """Entry names of the core and linker histone families."""
        return rf"(^|\|)(H1|H2A|H2B|H3|H4|H5|MH2A|CENPA|CSE4|HTZ1|H24)[A-Z0-9]*_{self.suffix}$"


#: Accessions of histones by organism.
HISTONES = {
    "HUMAN": "P07305 Q8IZA3 Q92522 P0C5Y9 P0C5Z0 H0YFX9 Q9BTM1 A8MQC5 C9J0D1 C9J386 E5RJU1 Q71UI9 P16104 B4DJC3 D6RCF2 O75367 Q5SQT3 Q9P0M6 P0C0S5 P0C1H6 A9UJN3 P57053 Q7Z2G1 B4DEB1 P84243 B2R4P9 K7EMV3 K7ES00 K7EK07 K7EP01 Q6NXT2 Q02539 P16401 P16403 P16402 Q4VB24 P10412 A3R0T8 A1L407 P22492 Q96QV6 P04908 Q08AJ9 Q93077 P20671 P0C0S8 A3KPC7 Q96KK5 Q99878 A4FTV9 Q92646 Q96A08 P33778 P62807 P58876 B2R4S9 Q93079 P06899 O60814 Q99880 I6L9F7 Q99879 Q99877 P23527 P68431 P62805 Q99525 Q0VAS5 B2R4R0 Q6FI13 Q8IUE6 Q16777 Q16778 B4DR52 Q5QNW6 Q71DI3 Q5TEC6 Q7L7L0 Q8N257 Q16695 Q6TXQ4 Q14463 B4E0B3 B2R5B6 A2RUA4 B2R5B3 Q9HA11 A8K9J7 B2R6Y1 B4E380 A8K4Y7 Q6B823 Q6LBZ2 A3R0T7",
    "MOUSE": "Q9DAD9 B2RTM0 Q8CBB6 Q921L4 Q5M8Q2 Q810S6 B1AV31 Q497L1 A9Z055 Q8CGP9 P10922 Q8CJI4 E0CZ52 E0CYL2 Q8VIK3 Q80ZM5 Q9CQ70 Q8R1M2 Q3THW5 Q8R029 B2RVP5 P27661 Q9QZQ8 Q8CA90 Q8BP16 Q9CTR1 Q8CCK0 Q9D3V6 Q9D3U7 Q3UA95 Q3TFU6 G3UWL7 G3UX40 P0C0S6 F8WI35 E0CZ27 E0CYN1 E0CYR7 P84244 P02301 Q9QYL0 P43275 P43276 P15864 Q5SZA3 P43277 Q149Z9 P43274 Q07133 I7HFT9 Q8CGP4 P22752 B2RVF0 Q61668 Q8CGP5 A0AUV1 Q8CGP6 A3KPD0 Q8CGP7 F8WIX8 A0JNS9 P70696 Q64475 Q6ZWY9 P10853 Q64478 A0JLV3 Q8CGP1 B2RVD5 P10854 B2RTK3 Q8CGP2 P68433 P84228 A1L0U3 A1L0V4 P62806 B2RWH3 Q6GSS7 Q64522 Q64523 Q149V4 Q64525 G3X9D5 Q64524 B9EI85 Q61667 Q8BFU2 A2AB79 Q9D2U9 Q8CGP0 Q6B822 P07978 Q9D9Z7",
    "DROME": "Q6TXQ1 P02255 Q4AB54 Q4ABE3 Q4ABD8 Q4AB94 P84051 Q4AB57 P08985 P02283 P02299 E2QCP0 P84249 P84040",
    "CAEEL": "P10771 P15796 Q19743 O17536 O01833 Q9U3W3 Q18336 P09588 J7S164 J7SA65 Q27485 Q23429 Q27511 P04255 Q27894 P08898 K7ZUH9 Q10453 Q9U281 Q27490 Q27532 P62784 Q27484 Q27876 O16277 Q27489",
    "YEAST": "P53551 P04911 P04912 Q12692 P02293 P02294 P61830 P02309",
    "SCHPO": "P48003 P04909 P04910 P04913 P09988 P10651 P09322",
}


#: Genome sizes in base pairs.
ORGANISMS = {
    "HUMAN": Organism("HUMAN", 3.22e9, "HUMAN"),
    "MOUSE": Organism("MOUSE", 2.8e9, "MOUSE"),
    "DROME": Organism("DROME", 1.44e8, "DROME"),
    "CAEEL": Organism("CAEEL", 1.04e8, "CAEEL"),
    "YEAST": Organism("YEAST", 1.21e7, "YEAST"),
    "SCHPO": Organism("SCHPO", 1.41e7, "SCHPO"),
}


def organism(name: str) -> Organism:
    try:
        return ORGANISMS[name.upper()]
    except KeyError:
        raise ValueError(f"unknown organism {name!r}; known: {', '.join(ORGANISMS)}") from None
