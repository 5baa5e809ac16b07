"""Sentences by stops, with abbreviations learnt from the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Abbreviations (a short word each) that are broadcast; more meet the texts in a shuffle.
BROADCAST_WORDS = 100_000
#: How likely a stop is after an abbreviation, its least score, and how often it stands before one at least.
STOP_AFTER, LEAST, TIMES = 0.99, 0.3, 5
_TOKEN = r"[\p{L}](?:[\p{L}.]*[\p{L}])?\.?(?=[\s,;:!?)\]\"']|$)"


def abbreviations(texts: DataFrame, text: str = "text", least: float = LEAST, times: int = TIMES) -> DataFrame:
    """word, stopped, plain, score: words (lower case, without their last stop) that stand before a stop far more often than words do.

    The score is the log-likelihood ratio of 'a stop nearly always follows' and 'stops follow it as they follow all words', less for longer words and
    for each time that the word stands without a stop, more for stops inside. Counts are sums over words: the texts are read once.
    """
    tokens = texts.select(F.explode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("t"))
    stop = F.col("t").endswith(".")
    words = tokens.select(F.lower(F.regexp_replace("t", r"\.$", "")).alias("word"), stop.cast("int").alias("stop"))
    counted = words.groupBy("word").agg(F.sum("stop").alias("stopped"), F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("stopped").cast("double").alias("stops"), F.sum("n").cast("double").alias("all"))
    # a row
    both = counted.filter(F.col("stopped") >= times).join(F.broadcast(total), F.lit(True))
    a, b = F.col("stopped"), F.col("n") - F.col("stopped")
    part = F.col("stops") / F.col("all")
    usual = a * F.log(part) + F.when(b > 0, b * F.log(1 - F.least(part, F.lit(1 - 1e-12)))).otherwise(0.0)
    certain = a * F.log(F.lit(STOP_AFTER)) + b * F.log(F.lit(1 - STOP_AFTER))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inside = F.length("word") - letters + 1
    score = -2 * (usual - certain) * F.exp(-letters.cast("double")) * inside * F.pow(letters.cast("double"), -F.least(b, F.lit(300)).cast("double"))
    return both.select("word", "stopped", b.alias("plain"), score.alias("score")).filter(F.col("score") >= least)


def pieces(text: Column) -> Column:
    """The lines of a text, each as its pieces up to a stop, exclamation or question mark that white space follows."""
    return F.transform(F.filter(F.split(text, r"\n+"), lambda line: F.trim(line) != ""), lambda line: F.split(line, r"(?<=[.!?])\s+"))


def sentences(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, sentence_no (from 0), sentence: pieces that end in one of the known abbreviations go on with the next one of their line, joined by a blank.

    A text's pieces are numbered and put together again by windows over the text alone. Null and empty texts have none; key tells texts apart.
    """
    lines = texts.select(key, F.posexplode(pieces(F.col(text))).alias("line_no", "parts")).select(key, "line_no", F.posexplode("parts").alias("part_no", "part")).filter("part <> ''")
    last = F.lower(F.regexp_extract("part", r"([\p{L}](?:[\p{L}.]*[\p{L}])?)\.$", 1))
    words = known.select(F.col("word").alias("__word")).distinct()
    few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    met = lines.withColumn("__last", last).join(F.broadcast(words) if few else words, F.col("__last") == F.col("__word"), "left")
    along = Window.partitionBy(key).orderBy("line_no", "part_no")
    # a piece begins a sentence unless it follows an abbreviation on its line
    goes_on = F.lag(F.col("__word").isNotNull()).over(along) & (F.lag("line_no").over(along) == F.col("line_no"))
    begins = met.withColumn("__begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    numbered = begins.withColumn("sentence_no", (F.sum("__begins").over(along) - 1).cast("int"))
    joined = numbered.groupBy(key, "sentence_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "part_no", "part"))).alias("l"))
    return joined.select(key, "sentence_no", F.array_join(F.transform("l", lambda x: x["part"]), " ").alias("sentence"))
