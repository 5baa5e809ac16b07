"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed by source; from the sources' sums come targets and repetition rates; every document is then taken floor(rate) times,
and once more with probability rate - floor(rate), by a hash of its doc_id and a seed. The only shuffle is that of the sums, of which
each task sends one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import ranked
from .common import fresh, small_enough, stored, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SALTS = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The sources with their size, target and rate. sizes has a row for each source: its name (one may be null) and its size.

    The sources, by code point with null last, weigh as the weights repeat. Together they get share of all sizes, by weight, but none more
    than most times its own size; what is cut off there goes to the others by weight, until none is above. Each such round is one sum over
    the sources, so that no task holds them all, and ranks come from range partitions. A source of size 0 has target 0 and rate 0.
    """
    at, weight, bound = fresh(sizes.columns, "at", "weight", "bound")
    weighs = F.element_at(F.array(*map(F.lit, weights)), (F.col(at) % len(weights) + 1).cast("int"))
    order = [F.col(source).isNull(), F.col(source)]
    known = stored(ranked(sizes, *order, column=at).withColumn(weight, weighs).withColumn(bound, F.lit(most) * F.col(size)), "mix-sources")
    total = float(known.agg(F.sum(size)).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        # sources that the level so far fills stop at their bound; the rest is shared anew
        full = F.col(bound) <= F.lit(level) * F.col(weight) if stopped >= 0 else F.lit(False)
        n, left, cut = known.agg(F.count(F.when(full, 1)), F.sum(F.when(~full, F.col(weight))), F.sum(F.when(full, F.col(bound)))).first()
        if n == stopped or not left:
            break
        stopped, level = n, (share * total - float(cut or 0)) / float(left)
    target = F.when(F.col(bound) <= F.lit(level) * F.col(weight), F.col(bound).cast("double")).otherwise(F.lit(level) * F.col(weight))
    target = F.col(bound).cast("double") if not left else target
    return known.withColumn("target", target).withColumn("rate", F.when(F.col(size) > 0, F.col("target") / F.col(size)).otherwise(0.0)).select(source, size, "target", "rate")


def coin(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) with 48 bits that follows from the doc_id and the seed."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def with_copies(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, dict[str, str]]:
    """The documents with size, their source's size and target, and copies, how often the mix takes each; and the names of those columns.

    Needs doc_id, source and text; null texts have size 0, null sources are a source, documents with a null doc_id share one coin, and
    repeated rows are taken alike. Other columns stay; new names avoid theirs.

    Copies are independent, so that a source's words differ from its target by a standard deviation of sqrt(sum(size^2 * f * (1 - f))), f the
    rate's fraction: n documents of like size are off by about 0.5 / sqrt(n) of the source's size at most, 7 % with 50 documents, 0.05 %
    with a million.
    """
    size, source_size, target, copies, key, rate, salt = names = fresh(docs.columns, "size", "source_size", "target", "copies", "source_key", "rate", "salt")
    sized = docs.withColumn(size, word_count(text_or_empty("text")))
    sums = sized.groupBy(F.col("source").alias(key)).agg(F.sum(size).alias(source_size))
    plan = stored(source_targets(sums, key, source_size, weights, share, most).withColumnsRenamed({"target": target, "rate": rate}), "mix-plan")
    if small_enough(plan):
        joined = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan[key]))
    else:
        # many sources: both sides are dealt by source and salt, so that a source with a third of all rows lands in many tasks
        spread = plan.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = sized.join(spread, sized["source"].eqNullSafe(spread[key]) & (sized[salt] == spread[salt])).drop(salt)
    whole = F.floor(rate)
    taken = (whole + (coin(F.col("doc_id"), seed) < F.col(rate) - whole).cast("long")).cast("long")
    return joined.withColumn(copies, taken).drop(key, rate), dict(zip(("size", "source_size", "target", "copies"), names[:4], strict=True))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents as the mix takes them, copies as rows of their own, with the columns of docs."""
    taken, names = with_copies(docs, **how)
    (one,) = fresh(taken.columns, "copy")
    rows = taken.filter(F.col(names["copies"]) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    return rows.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    taken, names = with_copies(docs)
    size = F.col(names["size"])
    return taken.select("doc_id", size.alias("size"), F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"), (size * F.col(names["copies"])).alias("taken"))


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight, 2 * source_size AS bound FROM sums),
ordered AS (SELECT *, row_number() OVER (ORDER BY bound / weight, source COLLATE "binary" NULLS LAST) AS k FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(bound) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM ordered),
fixed AS (SELECT arg_min(level, k) AS level FROM levels WHERE bound > level * weight),
plan AS (SELECT l.source, l.source_size, least(l.bound::DOUBLE, coalesce(f.level * l.weight, l.bound::DOUBLE)) AS target FROM levels l CROSS JOIN fixed f),
rated AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null') || ':0'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS coin
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (coin < rate - floor(rate))::INTEGER))::BIGINT AS taken FROM rated
"""
