"""A table that grows by batches, each written once whatever is repeated or breaks off."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..storage import delete, hadoop_path


class Ledger:
    """Batches by number under a folder. A batch is written aside and then renamed to its number, in one step that fails where the number is
    taken: what breaks off before leaves no batch, and what is repeated after changes none. For foreachBatch of a stream, or for runs that
    number their steps."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def _place(self, batch: int) -> str:
        return f"{self.path}/batches/batch-{batch}"

    def has(self, batch: int) -> bool:
        where, system = hadoop_path(self.spark, self._place(batch))
        return system.exists(where)

    def write_aside(self, df: DataFrame) -> str:
        path = f"{self.path}/aside/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def rename(self, aside: str, batch: int) -> bool:
        """Whether the batch is this one; where its number is taken, what was written aside goes."""
        jvm = self.spark._jvm
        place, system = hadoop_path(self.spark, self._place(batch))
        system.mkdirs(place.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(jvm.org.apache.hadoop.fs.Path(aside), place, none)
        except Exception:
            if not self.has(batch):
                raise
            delete(self.spark, aside)
            return False
        return True

    def commit(self, df: DataFrame, batch: int) -> bool:
        """Whether the batch was new."""
        return not self.has(batch) and self.rename(self.write_aside(df), batch)

    def clean(self) -> None:
        """Deletes what broken runs have left aside; no run may be writing."""
        delete(self.spark, f"{self.path}/aside")

    def read(self) -> DataFrame:
        """All committed batches."""
        where, system = hadoop_path(self.spark, f"{self.path}/batches")
        if not system.exists(where):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batches/*")


def append_stream(stream: DataFrame, ledger: Ledger, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Takes all that a stream has now into the ledger, and returns when it is there. Started again, even with a lost checkpoint over the same input, it adds nothing twice."""
    query = stream.writeStream.foreachBatch(lambda rows, batch: ledger.commit(prepare(rows), batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
