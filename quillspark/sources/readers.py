"""Readers: CSV with text columns kept as text, newest files, checkpoints, whole texts, page dictionaries, metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import hadoop_path, stored

TEXTS = T.MapType(T.StringType(), T.StructType().add("PDF", "string").add("OCR", "string"))


def csv(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """One file, several, or a glob; every column is a string, so that '42' stays a text. Quoted cells may have line ends."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=header, multiLine=True, escape='"', sep=sep)


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Paths in a folder of any file system that Spark reads, sorted."""
    path, system = hadoop_path(spark, f"{folder}/{pattern}")
    found = system.globStatus(path) or []
    return sorted(f.getPath().toString() for f in found)


def newest(spark: SparkSession, folder: str, pattern: str = "*") -> str | None:
    """The last path by name; names carry the time of writing."""
    return max(listed(spark, folder, pattern), default=None)


def latest_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """The checkpoint with the largest number, compared as a number."""
    numbered = [(int(n), p) for p in listed(spark, folder, "checkpoint*") if (n := p.rstrip("/").rpartition("-")[2]).isdigit()]
    return max(numbered, default=(0, None))[1]


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc (file name), path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """doc, line_no, line of text files; together: of all files of a folder as one text, in the order of their names. Large files are read in pieces by many tasks; a line's number is its place in its piece plus the number of lines in the
    pieces before. The lines are stored once with the pieces that this reading made, and counted there."""
    piece = (F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"))
    rows = stored(spark.read.text(path).select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("line"), *piece, F.monotonically_increasing_id().alias("__id")), "lines")
    counts = rows.groupBy("__path", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # a row for each piece, not for each line
    along = Window.orderBy("__path", "__block") if together else Window.partitionBy("__path").orderBy("__block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__path", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(starts, ["__path", "__block"]).select("doc", (F.col("__id") - F.col("__first") + F.col("__start")).cast("int").alias("line_no"), "line")


def article_pages(spark: SparkSession, path: str) -> DataFrame:
    """filename, page, gt, ocr from JSON lines with a filename and a map from page to its texts; empty pages are left out."""
    schema = T.StructType().add("filename", "string").add("pages", TEXTS)
    rows = spark.read.schema(schema).json(path).select("filename", F.explode("pages").alias("page", "p"))
    return rows.select("filename", "page", F.col("p.PDF").alias("gt"), F.col("p.OCR").alias("ocr")).filter("gt IS NOT NULL OR ocr IS NOT NULL")


def _log_lines(lines: DataFrame) -> DataFrame:
    where, parts = F.col("_metadata.file_path"), F.split("value", " ")
    names = r"([^/=]+)/metrics[/=]([^/]+)(?:/[^/]*)?$"
    rows = lines.select(F.regexp_extract(where, names, 1).alias("run"), F.regexp_extract(where, names, 2).alias("metric"), parts.alias("p"))
    return rows.filter(F.size("p") == 3).select("run", "metric", F.col("p")[0].cast("long").alias("epoch_ms"), F.col("p")[1].cast("double").alias("value"), F.col("p")[2].cast("long").alias("step"))


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """run, metric, epoch_ms, value, step from files <run>/metrics/<metric> (or run=<run>/metrics=<metric>/*) with lines 'epoch_ms value step'."""
    return _log_lines(spark.read.text(path))


def metric_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """The same of a folder into which log files keep coming, so many files at a time."""
    return _log_lines(spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(path))


def page_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc (file name), path and n_pages of PDF files."""
    counted = F.pandas_udf(lambda files: files.map(page_count), "int")
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("doc"), "path", counted("content").alias("n_pages"))


def page_count(content: bytes) -> int:
    """Pages of a PDF by its page tree; 1 where that cannot be read."""
    import re

    counts = [int(n) for n in re.findall(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b", content) for n in n if n]
    return max(counts, default=1)
