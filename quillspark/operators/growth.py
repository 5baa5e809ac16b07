"""Corpus growth by month, and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def funnel(rows: DataFrame, date: str, stage: str) -> DataFrame:
    """month, stage, n, and the running total of the stage. Months are few: the window runs over sums."""
    n = rows.groupBy(F.date_trunc("month", date).cast("date").alias("month"), F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("stage").orderBy("month")))


def best_steps(log: DataFrame) -> DataFrame:
    """By run and metric, the least value and the step where it came first, and the number of values. log: run, metric, step, value."""
    return log.groupBy("run", "metric").agg(F.min("value").alias("best"), F.min_by("step", F.struct("value", "step")).alias("step"), F.count(F.lit(1)).alias("n"))
