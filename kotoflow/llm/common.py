"""Helpers shared by the operators: cluster-shared tables and text to words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a written table go as soon as it is written; later reads need the table alone.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Byte map for contract words: A-Z become a-z, other bytes stay.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` of the session.  Where that is unset a fresh
    temporary folder is set as checkpoint folder, but only in local mode (tests,
    one machine); a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kotoflow-")
        sc.setCheckpointDir(found)
    return found


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: a lost executor costs a reread, not a recomputation.
    Returns the reread frame and its path (for :func:`drop_table`).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that :func:`write_table` made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Intermediate tables of one operator; as a context it drops all but the kept ones.

    A frame that the operator returns unevaluated still reads its last tables:
    write those with ``keep=True``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        out, path = write_table(df, name)
        if not keep:
            self.paths.append(path)
        return out

    def drop(self, since: int = 0) -> None:
        """Drop what was written after the first ``since`` tables."""
        for path in self.paths[since:]:
            drop_table(self.spark, path)
        del self.paths[since:]

    def __len__(self) -> int:
        return len(self.paths)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *exc) -> None:
        self.drop()


def fresh(*taken: DataFrame | list[str], name: str) -> str:
    """A column name that none of the frames (or lists of names) has."""
    names = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else t)}
    while name.lower() in names:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
