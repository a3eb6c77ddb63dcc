"""A corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir), and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard, language, mixing, sharding
from tessera.llm.textops import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the labelled rows and drops texts without a language or between two."""
    return language.keep_identified(docs, language.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.drop_near_duplicates(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or with other values."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by probabilities raked to tempered source, language and topic shares."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "lang", "text")
    return mixing.mix(mixing.with_mix_keys(row).drop("text"), tempered=True).filter("selected").select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every document, with its text, at a slot of a shard of nearly equal bytes."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The first stages are learned or sampled, which SQL cannot express; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
