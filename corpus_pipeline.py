"""Training-data pipeline over ``documents`` (part of subpackage ``llm``).

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotoflow.llm import decontaminate, language_id, near_dup, packing, secret_scan
from kotoflow.llm.common import table, write_table
from kotoflow.session import ship

#: Documents whose language is less certain than this go (with those that have no letters).
MIN_LANGUAGE_SCORE = 0.2
#: Stands where a secret was.
MARK = "<SECRET>"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; no letters or no confidence: rejected."""
    ship(spark)
    return language_id.keep_known(docs, language_id.fit(docs), MIN_LANGUAGE_SCORE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard 0.8)."""
    ship(spark)
    return near_dup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced."""
    ship(spark)
    clean = secret_scan.redact(docs, F.col("source"), mark=MARK)
    n_chars = F.when(F.contains("text", F.lit(MARK)), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in 1024-token sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Classifiers, set similarity and packing have no SQL form; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
