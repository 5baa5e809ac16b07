"""Confusion of aligned characters or words, its thresholds and its axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import ranked


def aligned_pairs(df: DataFrame, gt: str, ocr: str, *keep: str) -> DataFrame:
    """Each place of two equally long texts as a row: pos, pdf_letters, ocr_letters. Texts of different lengths give none."""
    zipped = F.arrays_zip(F.split(gt, "").alias("g"), F.split(ocr, "").alias("o"))
    same = df.filter((F.length(gt) == F.length(ocr)) & (F.length(gt) > 0))
    rows = same.select(*keep, F.posexplode(zipped).alias("pos", "pair"))
    return rows.select(*keep, "pos", F.col("pair").getField("g").alias("pdf_letters"), F.col("pair").getField("o").alias("ocr_letters"))


def confusion(pairs: DataFrame) -> DataFrame:
    """pdf_letters, ocr_letters, counts (per cent of all OCR tokens of that ground-truth token) and counts_unnormalized. Pairs are summed before they are dealt."""
    n = pairs.groupBy("pdf_letters", "ocr_letters").agg(F.count(F.lit(1)).alias("counts_unnormalized"))
    return n.withColumn("counts", 100.0 * F.col("counts_unnormalized") / F.sum("counts_unnormalized").over(Window.partitionBy("pdf_letters")))


def cleaned_key(word: Column) -> Column:
    """A word without punctuation and capitals."""
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))


def subset(frame: DataFrame, per_cent: float | None = 0.01, count: int | None = None, track_gaps: bool = False) -> DataFrame:
    """Rows above a threshold, with a label of the rounded per cent, and gap signs written out. Insertions of deletions are nulled unless tracked."""
    rows = frame.filter(F.col("counts_unnormalized") > count if count is not None else F.col("counts") > per_cent)
    insert, delete = (F.col("ocr_letters") == "^") & (F.col("pdf_letters") != "^"), (F.col("pdf_letters") == "@") & (F.col("ocr_letters") != "@")
    out = rows.withColumn("label", F.concat(F.format_number("counts", 2), F.lit("%"))).withColumn("ocr", F.when(insert, "INSERT").otherwise(F.col("ocr_letters"))).withColumn("pdf", F.when(delete, "DELETE").otherwise(F.col("pdf_letters")))
    if track_gaps:
        return out
    both = (F.col("ocr_letters") == "^") & (F.col("pdf_letters") == "@")
    return out.withColumn("counts", F.when(~both, F.col("counts"))).withColumn("counts_unnormalized", F.when(~both, F.col("counts_unnormalized")))


def axis(frame: DataFrame) -> DataFrame:
    """The tokens in drawing order: ground-truth tokens sorted, then those of OCR only, insertions and deletions last. No task sorts all tokens: of words there are many."""
    tokens = frame.select(F.col("pdf_letters").alias("token"), F.lit(0).alias("side")).union(frame.select("ocr_letters", F.lit(1))).groupBy("token").agg(F.min("side").alias("side"))
    gap = F.col("token").isin("^", "@").cast("int")
    return ranked(tokens, gap, "side", "token", column="place").select("token", (F.col("place") + 1).cast("int").alias("place"))


def folded(frame: DataFrame) -> DataFrame:
    """Per cents and counts as rows of column and value."""
    return frame.withColumn("counts_unnormalized", F.col("counts_unnormalized").cast("double")).unpivot(["pdf_letters", "ocr_letters"], ["counts", "counts_unnormalized"], "column", "value")


def histogram(frame: DataFrame, token: str, min_per_cent: float = 1.0) -> DataFrame:
    return frame.filter((F.col("pdf_letters") == token) & F.col("counts").between(min_per_cent, 100)).orderBy(F.desc("counts"), "ocr_letters")
