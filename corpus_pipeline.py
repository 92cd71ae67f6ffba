"""From raw documents to packed training sequences, in five stages of the numbered operators.

Every stage works on all documents that its predecessor kept, written as Parquet and read again; all but the last return
the columns of ``documents``. Tables that a stage needs besides are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from payrecon.llm import decontaminate, jaccard, langid, packing, sanitise
from payrecon.llm.common import staged, tuned


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised (operator 10). Texts without a letter go, and so do texts whose best
    language is hardly above the others."""
    tuned(spark)
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more (operator 4): the one with the smallest id."""
    tuned(spark)
    return jaccard.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item (operator 1)."""
    tuned(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers and the terms that disclose them rewritten (operator 2); n_chars follows."""
    tuned(spark)
    return sanitise.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences that hold every source in its share (operator 8)."""
    tuned(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data),
    ("pack", pack),
]

#: No stage but the benchmark's could be told in SQL; each operator is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
