"""Text and gold-corpus sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One record per line; blank lines stay, as empty texts."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def text_sink(df: DataFrame, column: Column, path: str) -> None:
    df.select(column.alias("value")).write.text(path)


def jsonl_sink(df: DataFrame, column: Column, path: str) -> None:
    """One JSON value per line, also for bare arrays."""
    df.select(F.to_json(column).alias("value")).write.text(path)


def jsut(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, kana, phonemes`` from a labelled YAML file, read as lines.

    Each entry starts with its name at the margin; its fields are indented.
    A file is one record: such corpora have a few thousand entries each.
    """
    raw = spark.read.text(path, wholetext=True)
    entry = F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\S[^:\n]*):[ \t]*\n((?:[ \t]+.*\n?)+)"), F.lit(0))).alias("e")
    field = lambda k: F.trim(F.regexp_extract("e", rf"(?m)^[ \t]+{k}:[ \t]*(.*)$", 1))
    out = raw.select(entry).select(F.regexp_extract("e", r"^([^:\n]*):", 1).alias("id"), field("text_level2").alias("text"), field("kana_level2").alias("kana"), F.split(field("phone_level3"), "-").alias("phonemes"))
    return out.where("text <> ''")


def rohan(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, kana`` from ``id:text,kana`` lines; ruby in parentheses is taken out of the text, an unclosed one to the end."""
    row = F.split("value", ":", 2)
    body = F.split(F.try_element_at(row, F.lit(2)), ",", 2)
    text = F.regexp_replace(F.try_element_at(body, F.lit(1)), r"\([^)]*(\)|$)", "")
    return spark.read.text(path).select(F.element_at(row, 1).alias("id"), text.alias("text"), F.try_element_at(body, F.lit(2)).alias("kana")).where("kana is not null")
