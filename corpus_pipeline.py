"""A training-data pipeline: every stage takes the documents its predecessor kept and returns what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factsieve.llm import decontaminate, langid, mixing, repeats, simhash
from factsieve.llm.common import stage

#: Bytes of a passage that may not occur twice.
PASSAGE = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that start anywhere else are cut out; documents of nothing else go.

    200 bytes are some 32 words, so that a repeated passage of 51 words is caught though its words be short.
    """
    return repeats.remove_repeats(docs, PASSAGE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark passages go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left with its slot in the mixture of sources; the order of training is by ``slot, in_block``."""
    return mixing.interleave(docs.select("doc_id", "source", "lang", "n_chars"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
]

#: Learned models, suffix buckets and fingerprints are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
