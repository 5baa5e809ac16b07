"""Filters, samples, splits and set operations that give the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh, stored


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_null_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the columns."""
    return df.na.drop(subset=list(columns))


def of_types(df: DataFrame, column: str, *wanted: str) -> DataFrame:
    return df.filter(F.col(column).isin(*wanted))


def regressions(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows that did not get better although there was something to mend."""
    return df.filter((F.col(after) >= F.col(before)) & (F.col(before) > 0))


def bucket(key: Column, buckets: int, seed: int = 0) -> Column:
    """A number below buckets that spreads consecutive keys; the same in any engine with integers."""
    return F.pmod(F.pmod(key, F.lit(buckets)) * F.lit(7919) + F.lit(seed * 104_729), F.lit(buckets))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, by the hash order of their keys: a top-k, of which each task sends n rows at most."""
    return df.orderBy(bucket(F.col(key), 1_000_003, seed), key).limit(n)


def complement(df: DataFrame, part: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys part lacks."""
    return df.join(part.select(*keys).distinct(), list(keys), "left_anti")


def fraction_split(df: DataFrame, key: str, fractions: dict[str, int], seed: int = 0, column: str = "split") -> DataFrame:
    """Names each row's split, by parts per hundred: a row's split hangs on its key alone."""
    if sum(fractions.values()) != 100:
        raise ValueError("the parts do not sum to 100")
    at, out, below = bucket(F.col(key), 100, seed), F.lit(None).cast("string"), 100
    for name, part in reversed(fractions.items()):
        out = F.when(at < below, name).otherwise(out)
        below -= part
    return df.withColumn(column, out)


def disjoint_samples(pages: DataFrame, keys: tuple[str, str], sizes: dict[str, int], seed: int = 0, column: str = "sample") -> DataFrame:
    """Samples of different pages without replacement, in hash order: the first so many are the first sample, and so on. Copies of a page count once."""
    total = sum(sizes.values())
    order = [bucket(F.col(keys[0]) * 1000 + F.col(keys[1]), 1_000_003, seed), *map(F.col, keys)]
    top = pages.dropDuplicates(list(keys)).orderBy(*order).limit(total)
    rank, name, below = F.row_number().over(Window.orderBy(*order)), F.lit(None).cast("string"), total
    for sample_name, size in reversed(sizes.items()):
        name = F.when(F.col("rank") <= below, sample_name).otherwise(name)
        below -= size
    return top.withColumn("rank", rank).withColumn(column, name)


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in (0, 1) of 48 bits that follows from the keys and the seed, the same in any engine with md5."""
    text = F.concat_ws(":", *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def article_first_samples(pages: DataFrame, article: str, page: str, sizes: dict[str, int], seed: int = 0, column: str = "sample") -> DataFrame:
    """Disjoint samples of pages without replacement, drawn by an article first, each as likely as any other, and then one of its pages.

    Drawing again where a page has been seen before is drawing by weights, a page's being one over its article's number of pages. Such a draw
    is a top-k of exponential keys, -ln(u) over the weight: no draw waits for another, and each task sends as many rows as are wanted at most.
    The columns article, page, rank (from 1, in the order of drawing) and the sample's name; copies of a page count once.
    """
    total = sum(sizes.values())
    each = pages.select(article, page).distinct()
    counts = each.groupBy(article).agg(F.count(F.lit(1)).alias("__pages"))
    known = each.join(counts.withColumnRenamed(article, "__article"), F.col(article).eqNullSafe(F.col("__article"))).drop("__article")
    drawn = known.withColumn("__key", -F.log(uniform(F.col(article), F.col(page), seed=seed)) * F.col("__pages"))
    top = drawn.orderBy("__key", article, page).limit(total)
    # the window runs over the drawn rows only
    rank, name, below = F.row_number().over(Window.orderBy("__key", article, page)), F.lit(None).cast("string"), total
    for sample_name, size in reversed(sizes.items()):
        name = F.when(F.col("rank") <= below, sample_name).otherwise(name)
        below -= size
    return top.withColumn("rank", rank).withColumn(column, name).select(article, page, "rank", column)


def ranked(df: DataFrame, *order: Column | str, column: str = "rank", total: str | None = None) -> DataFrame:
    """Numbers from 0 in the order of the columns, and if asked for the number of rows.

    Rows are dealt by range and sorted, and stored once with the number of their partition and their place in it; the partitions' row counts
    come from that table. Ranges are drawn from a sample, so that a plan that dealt the rows twice would count other partitions than it
    numbers. No task sees all rows; rows with equal keys get their numbers in any order, but each number is given once.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, at, of, start, rows = fresh([*df.columns, column, *([total] if total else [])], "part", "at", "of", "start", "rows")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(part, F.spark_partition_id())
    dealt = stored(dealt.withColumn(at, F.monotonically_increasing_id() - F.shiftleft(F.col(part).cast("long"), 33)), "ranked")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(rows))
    # a row for each partition, not for each row
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(part).alias(of), F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start), F.sum(rows).over(Window.partitionBy()).alias(rows))
    out = dealt.join(F.broadcast(starts), F.col(part) == F.col(of)).withColumn(column, F.col(start) + F.col(at))
    if total:
        out = out.withColumn(total, F.col(rows))
    return out.drop(part, at, of, start, rows)


def chunk_ids(df: DataFrame, key: str, chunks: int, column: str = "chunk") -> DataFrame:
    """Chunks of consecutive keys; the first n % chunks have one row more."""
    at, n = fresh([*df.columns, column], "rank", "rows")
    rows = ranked(df, key, column=at, total=n)
    rank, small, large = F.col(at), F.floor(F.col(n) / chunks), F.col(n) % chunks
    chunk = F.when(rank < large * (small + 1), F.floor(rank / (small + 1))).otherwise(large + F.floor((rank - large * (small + 1)) / F.greatest(small, F.lit(1))))
    return rows.withColumn(column, chunk.cast("int")).drop(at, n)


def shuffled(df: DataFrame, key: str, seed: int = 0, column: str = "place") -> DataFrame:
    """Rows with their places in a random order that hangs on the keys and the seed alone."""
    return ranked(df, bucket(F.col(key), 1_000_003, seed), key, column=column)


def first_hits(df: DataFrame, condition: Column, n: int, *order: str) -> DataFrame:
    return df.filter(condition).orderBy(*order).limit(n)


def pending(df: DataFrame, written: DataFrame, *keys: str) -> DataFrame:
    """Rows that an earlier run has not written yet."""
    return complement(df, written, *keys)
