"""Places that the driver and all executors see."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (a local run) a temporary one that becomes it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path of any file system that Spark reads, and that file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, system = hadoop_path(spark, path)
    system.delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with all that is under it when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}-{name}"
    where, system = hadoop_path(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later stages read it, so that a lost executor costs no more than its own tasks, and all readers see the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its case."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, such as a log's or a single number's."""
    where, system = hadoop_path(spark, path)
    out = system.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
