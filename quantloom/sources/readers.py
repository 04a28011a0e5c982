"""Readers: feature tables, sample metadata, FASTA, peptide tables, id lists, folders of TSV files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom import schema as S
from quantloom.functions.expressions import accession, not_nan


def is_parquet(spark: SparkSession, path: str) -> bool:
    """Whether the file, or any file of the folder, starts with Parquet's magic bytes; False if nothing can be read."""
    try:
        rows = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4).alias("m")).limit(1).collect()
        return bool(rows) and bytes(rows[0]["m"]) == b"PAR1"
    except Exception:
        return False


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: Parquet, CSV or TSV."""
    low = path.rstrip("/").lower()
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".tsv", ".txt")):
        return spark.read.csv(path, sep="," if low.endswith(".csv") else "\t", header=True, inferSchema=True)
    raise ValueError(f"no reader for {path}: .parquet, .csv or .tsv")


def csv_to_parquet(spark: SparkSession, path: str) -> str:
    out = re.sub(r"\.csv$", "", path) + ".parquet"
    load_table(spark, path).write.parquet(out)
    return out


def aliased(df: DataFrame) -> DataFrame:
    """Older names of feature columns brought to the current ones."""
    return df.withColumnsRenamed({a: b for a, b in S.ALIASES.items() if a in df.columns and b not in df.columns})


def features_long(df: DataFrame) -> DataFrame:
    """A row per feature, sample and channel with an intensity over 0, from the nested table; with default run, condition, replicate and fraction."""
    df = aliased(df)
    nested = F.transform("intensities", lambda x: F.struct(x["sample_accession"].alias("sample_accession"), x["channel"].alias("channel"), not_nan(x["intensity"]).alias("intensity")))
    flat = df.drop("intensities").select("*") if "intensities" not in df.columns else df.select(*[c for c in df.columns if c != "intensities"], F.inline(F.filter(nested, lambda x: x["intensity"] > 0)))
    extra = {"run": F.col("reference_file_name"), "condition": F.col("sample_accession"), "biological_replicate": F.lit(1), "fraction": F.lit("1")}
    return flat.withColumns({k: v for k, v in extra.items() if k not in flat.columns})


def unique_header(names: list[str]) -> list[str]:
    """Lower-case headers; a repeated one gets .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in (x.strip().lower() for x in names):
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def load_sdrf(spark: SparkSession, path: str) -> DataFrame:
    """Sample metadata: tab-separated, all strings, headers in lower case."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = unique_header(header[0].split("\t"))
    return spark.read.csv(path, sep="\t", header=True, enforceSchema=True, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))


def condition_column(columns: list[str]) -> str:
    """The first 'factor value', or else the first organism part among the characteristics, or else the source name."""
    for test in (lambda c: "factor value" in c, lambda c: "organism part" in c and "characteristics" in c):
        for c in columns:
            if test(c):
                return c
    return "source name"


def with_sdrf(features: DataFrame, sdrf: DataFrame, dedupe: bool = True) -> DataFrame:
    """Features with condition, biological replicate and fraction from the metadata (as they were where it has none).

    ``dedupe``: one row per sample (the first by condition); without it features multiply by the metadata's rows.
    """
    pick = lambda part, default: next((F.col(f"`{c}`") for c in sdrf.columns if part in c), default)
    meta = sdrf.select(F.col("`source name`").alias("__s"), F.col(f"`{condition_column(sdrf.columns)}`").alias("__c"), pick("biological replicate", F.lit(None).cast("string")).try_cast("int").alias("__b"), pick("fraction identifier", F.lit(None).cast("string")).alias("__f"))
    if dedupe:
        meta = meta.groupBy("__s").agg(F.min(F.struct("__c", "__b", "__f")).alias("m")).select("__s", "m.*")
    joined = features.join(meta, F.col("sample_accession") == F.col("__s"), "left")
    new = {"condition": F.coalesce("__c", "condition"), "biological_replicate": F.coalesce("__b", "biological_replicate"), "fraction": F.coalesce("__f", "fraction")}
    return joined.withColumns(new).drop("__s", "__c", "__b", "__f")


def load_fasta(spark: SparkSession, path: str) -> DataFrame:
    """identifier, accession, sequence of each record."""
    raw = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s+", ""))
    return raw.select(head.alias("identifier"), accession(head).alias("accession"), body.alias("sequence"))


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def load_peptides(spark: SparkSession, path: str) -> DataFrame:
    """A peptide table, Parquet or CSV whatever its name, with null and non-positive intensities dropped."""
    df = spark.read.parquet(path) if is_parquet(spark, path) else spark.read.csv(path, header=True, inferSchema=True)
    return df.withColumn(S.NORM, not_nan(F.col(S.NORM))).dropna(subset=[S.NORM]).where(F.col(S.NORM) > 0)


def list_files(spark: SparkSession, folder: str, pattern: str, folders: bool = False) -> list[str]:
    """Files (and, if asked, folders) under the folder, down two levels, through Hadoop's file system."""
    jvm = spark._jvm
    out: list[str] = []
    for depth in ("", "*/", "*/*/"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{depth}{pattern}")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        out += [s.getPath().toString() for s in found or [] if folders or s.isFile()]
    return sorted(set(out))


def dataset_files(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The SDRF files and the protein tables (ibaq.csv, ibaq.parquet) under the folder, as many of the one as of the other."""
    found = {"sdrf": list_files(spark, folder, "*.sdrf.tsv"), "ibaq": sorted(list_files(spark, folder, "*ibaq.csv") + list_files(spark, folder, "*ibaq.parquet", folders=True))}
    for kind, files in found.items():
        if not files:
            raise FileNotFoundError(f"no {kind} files in {folder}")
    if len(found["sdrf"]) != len(found["ibaq"]):
        raise ValueError(f"{len(found['sdrf'])} SDRF files, {len(found['ibaq'])} protein tables")
    return found


def sdrf_channels(sdrf: DataFrame, plex: str, label: str = "comment[label]") -> DataFrame:
    """``sdrf`` with the channel's position in the plex as ``channel``; null for labels that are none of it."""
    pairs = [F.lit(x) for kv in S.channels(plex).items() for x in kv]
    return sdrf.withColumn(S.CHANNEL, F.create_map(*pairs)[F.col(f"`{label}`")])


def combine_tsv(spark: SparkSession, folder: str, pattern: str = "*", comment: str = "#", sep: str = "\t") -> DataFrame:
    """All files that match, which must have the same columns, one after another."""
    files = list_files(spark, folder, pattern)
    if not files:
        raise FileNotFoundError(f"no file matches {pattern} in {folder}")
    frames = [spark.read.csv(f, sep=sep, header=True, comment=comment, inferSchema=True) for f in files]
    want = set(frames[0].columns)
    for f, d in zip(files, frames, strict=True):
        if set(d.columns) != want:
            raise ValueError(f"{f} has other columns than {files[0]}")
    out = frames[0]
    for d in frames[1:]:
        out = out.unionByName(d)
    return out


def in_samples(df: DataFrame, samples: list[str], column: str = "sample_accession") -> DataFrame:
    """Rows of some samples (or conditions); the scan skips row groups without them."""
    return df.where(F.col(column).isin(list(samples)))
