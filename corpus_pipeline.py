"""The corpus pipeline: STAGES applied one after another to ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame with
the columns of documents, the last one a training schedule. A caller may write each result and read it
back, as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontam, mixing, recompression, simhash, toxicity

#: The near-duplicate stage: a Jaccard likeness of 0.8 or more of the distinct five-word shingles. At 0.8, 256-bit
#: fingerprints differ in 48 bits or fewer on average, with a deviation of 6; those within 96 are verified.
NEAR = {"shingle_words": 5, "lanes": 4, "max_bits": 96, "blocking": "prefix", "similarity": 0.8}


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more go. The model is fitted on the labels that are not held out."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates stays."""
    return simhash.keep_one(docs, **NEAR)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows of 13 that a smaller doc_id has go; documents that lose none keep their text, those that lose all go."""
    found = recompression.dedup(docs, window=13)
    cut = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.where("n_removed = 0 or n_removed < n_words").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training schedule: a row for each time that a document is taken."""
    return mixing.schedule(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Two stages hash with XXH64 and one trains a model; DuckDB has neither. Tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
