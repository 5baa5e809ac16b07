"""Sinks: CSV, Parquet, chunked folders, metric tables, appended logs, and runs that go on where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed_number, thousands
from ..operators.relational import chunk_ids, pending
from ..storage import hadoop_path


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True, sep=sep, escape='"', quoteAll=True)


def write_chunks(df: DataFrame, path: str, key: str, chunks: int) -> None:
    """A folder for each chunk of consecutive keys, the first ones with a row more."""
    chunk_ids(df, key, chunks).write.partitionBy("chunk").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def write_pending(df: DataFrame, path: str, *keys: str, restart: bool = False) -> None:
    """Appends the rows that the table at path lacks; with restart all rows replace it."""
    spark = df.sparkSession
    where, system = hadoop_path(spark, path)
    if restart or not system.exists(where):
        df.write.mode("overwrite").parquet(path)
    else:
        pending(df, spark.read.parquet(path), *keys).write.mode("append").parquet(path)


def metric_rows(wide: DataFrame, decimals: int = 2) -> DataFrame:
    """A wide row of numbers as rows of metric, value, and the value as it is printed, with decimals and as a whole number with commas."""
    long = wide.select(*(F.col(c).cast("double").alias(c) for c in wide.columns)).unpivot([], wide.columns, "metric", "value")
    return long.withColumn("printed", fixed_number(F.col("value"), decimals)).withColumn("whole", thousands(F.round("value")))
