"""A table in which a key, or a row's number, leads to one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import chunk_ids
from ..storage import fresh


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


class KeyStore:
    """Rows in buckets by a hash of their key (as text), a folder and a sorted file each. A look-up lists nothing and opens the files of its keys' buckets only; in these, row
    groups whose range misses the keys are skipped."""

    COLUMN = "key_bucket"

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def write(self, df: DataFrame) -> KeyStore:
        """Rows with equal keys all stay; a null key is a key."""
        (bucket,) = fresh(df.columns, self.COLUMN)
        if bucket != self.COLUMN:
            raise ValueError(f"a column has the name {self.COLUMN}")
        dealt = df.withColumn(bucket, _bucket(F.coalesce(F.col(self.key).cast("string"), F.lit("")), self.buckets)).repartition(self.buckets, bucket).sortWithinPartitions(bucket, self.key)
        dealt.write.partitionBy(bucket).parquet(self.path)
        return self

    def get(self, keys: list) -> DataFrame:
        """The rows of these keys, few enough to be named one by one."""
        buckets = self.spark.createDataFrame([(None if k is None else str(k),) for k in keys], "k string").select(_bucket(F.coalesce("k", F.lit("")), self.buckets).alias("b")).distinct()
        whole = self.spark.read.parquet(self.path)
        wanted = F.col(self.key).isin([k for k in keys if k is not None])
        if None in keys:
            wanted = wanted | F.col(self.key).isNull()
        return whole.filter(F.col(self.COLUMN).isin([r["b"] for r in buckets.collect()])).filter(wanted).drop(self.COLUMN)

    def join(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """Rows of any number with those of the same key: a join on bucket and key, in which buckets without a key are not read."""
        return rows.withColumn(self.COLUMN, _bucket(F.coalesce(F.col(self.key).cast("string"), F.lit("")), self.buckets)).join(self.spark.read.parquet(self.path), [self.COLUMN, self.key], how).drop(self.COLUMN)


class RowStore:
    """Rows in chunks of consecutive keys, so that a row's number (from 0, in the keys' order) leads to one chunk's folder and a place in it, as in a table of tensors in shards."""

    def __init__(self, spark: SparkSession, path: str, key: str, chunks: int):
        self.spark, self.path, self.key, self.chunks = spark, path.rstrip("/"), key, chunks

    def write(self, df: DataFrame) -> RowStore:
        chunk_ids(df, self.key, self.chunks, "chunk").repartition("chunk").sortWithinPartitions("chunk", self.key).write.partitionBy("chunk").parquet(self.path)
        self.rows = df.count()
        return self

    def chunk_of(self, number: int) -> tuple[int, int]:
        """The chunk and the place in it: the first rows % chunks of them have a row more."""
        small, large = divmod(self.rows, self.chunks)
        if number < large * (small + 1):
            return divmod(number, small + 1)
        chunk, place = divmod(number - large * (small + 1), small)
        return chunk + large, place

    def get(self, number: int) -> DataFrame:
        """The row of a number; no row beyond the last one. Rows of equal keys have their numbers in any order."""
        whole = self.spark.read.parquet(self.path)
        if not 0 <= number < self.rows:
            return whole.drop("chunk").limit(0)
        chunk, place = self.chunk_of(number)
        return whole.filter(F.col("chunk") == chunk).drop("chunk").orderBy(self.key).offset(place).limit(1)
