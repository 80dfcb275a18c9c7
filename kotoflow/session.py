"""What a session needs before it runs this package's Python functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of one Arrow batch: whole texts can be long, so fewer than Spark's default.
BATCH_ROWS = 2048


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per context, so that Python
    workers import it wherever they run; Arrow batches that are at Spark's
    default size get BATCH_ROWS rows."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if not getattr(sc, "_kotoflow_shipped", False):
        here = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="kotoflow-ship-")) / "kotoflow.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts:
                    z.write(p, Path(here.name) / p.relative_to(here))
        sc.addPyFile(str(to))
        sc._kotoflow_shipped = True
    return spark


def spread(df: DataFrame, waves: int = 1) -> DataFrame:
    """``df``, dealt over all cores if it is read in fewer tasks than ``waves`` times the cores.

    A small file (or one row group, however large) is one task, which row-local work
    then waits for; tables of more partitions than cores stay where they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2, waves) * n) if df.rdd.getNumPartitions() < waves * n else df
