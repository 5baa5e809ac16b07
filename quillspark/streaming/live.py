"""Error rates and confusion counts of an unbounded stream of text pairs, and curves of training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import edit_distance
from ..operators import growth
from ..operators.confusion import aligned_pairs


def error_rates(pairs: DataFrame, ocr: str = "ocr", gt: str = "gt") -> DataFrame:
    """Each pair with its distance and length: a stateless map, the same on a stream as on a table."""
    return pairs.withColumn("distance", edit_distance(F.col(ocr), F.col(gt))).withColumn("gt_length", F.length(gt))


def windowed_rates(pairs: DataFrame, time: str, size: str = "10 minutes", late: str = "10 minutes", ocr: str = "ocr", gt: str = "gt") -> DataFrame:
    """Edits, characters and their ratio by event-time window; state of windows that late rows cannot reach is dropped."""
    rated = error_rates(pairs.withWatermark(time, late), ocr, gt)
    summed = rated.groupBy(F.window(time, size)).agg(F.sum("distance").alias("edits"), F.sum("gt_length").alias("chars"))
    return summed.select(F.col("window.start").alias("since"), "edits", "chars", (100.0 * F.col("edits") / F.greatest("chars", F.lit(1))).alias("cer"))


def running_confusion(pairs: DataFrame, gt: str = "gt", ocr: str = "ocr") -> DataFrame:
    """Counts of character pairs of equally long texts; for update or complete output."""
    return aligned_pairs(pairs, gt, ocr).groupBy("pdf_letters", "ocr_letters").count()


def best_steps(log: DataFrame, path: str, checkpoint: str) -> None:
    """Takes all that a stream of log lines (run, metric, step, value) has now into running best steps, and writes them to path after each batch.

    The state is a row for each run and metric; lines may come in any order, as a best value does not hang on it.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(path)

    query = growth.best_steps(log).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
