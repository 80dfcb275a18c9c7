"""Streaming text analysis: stateless, append mode, no state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kotoflow.operators.evaluation import corpus_totals


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "text")


def write_results(df: DataFrame, result: Column, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a result column as Parquet; exactly once by the checkpoint."""
    return df.withColumn("result", result).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def running_totals(scored: DataFrame, name: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Evaluation totals of a stream, in memory under ``name``; the state is one row."""
    w = corpus_totals(scored).writeStream.format("memory").queryName(name).outputMode("complete")
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
