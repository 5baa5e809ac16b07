"""What the operators of this package share: column names that clash with nothing, and tables that survive lost executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, fresh, scratch_path, stored

__all__ = ["BROADCAST_ROWS", "Scratch", "fold_ascii", "fresh", "join_hot", "small_enough", "stored", "text_or_empty"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 100_000


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


class Scratch:
    """Stored tables of one operator that go once their readers are done. Only what close() is told to keep stays until the driver ends, for the result reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables; nothing that is still to run may read them."""
        for t in tables:
            path, _ = self.paths.pop(id(t))
            delete(self.spark, path)

    def close(self, *keep: DataFrame) -> None:
        self.drop(*(t for k, (_, t) in list(self.paths.items()) if k not in {id(t) for t in keep}))


#: A key with a HOT_PART of all rows or more is hot, so that there are HOT_PART hot keys at most; its rows are dealt by SALTS salts as well.
HOT_PART, SALTS = 1000, 32


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, spread: Column, how: str = "inner") -> DataFrame:
    """left joined with right by a key that is unique in right, where a few keys may hold most of left's rows.

    rows is the column of right that says how many rows of left have the key (an upper bound will do). Left rows of hot keys are dealt by
    key and a hash of spread, and right's rows of hot keys are repeated for each salt. The broadcast list of hot keys is bounded: the
    number of left's rows is at least the sum of those counts over HOT_PART parts.
    """
    salt, flag, other = fresh([*left.columns, *right.columns], "salt", "hot", "hot_key")
    least = right.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) >= F.lit(max(2, -(-least // HOT_PART)))
    hot = right.filter(is_hot).select(F.col(key).alias(other), F.lit(True).alias(flag))
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col(other), "left").drop(other)
    dealt = dealt.withColumn(salt, F.when(F.col(flag), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop(flag)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn(salt, F.explode(every)), [key, salt], how).drop(salt)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of narrow rows may be broadcast; looks at no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows
