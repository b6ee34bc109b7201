"""Tables that a stream writes batch by batch, each batch once.

A batch goes to a folder of its own in every table, and is committed by one mark when all of them are written. A batch that
is run again, because it failed half way or because its end was not noted, finds its mark or writes its folders anew.
Readers see committed batches alone. Batches come in order of their numbers, so the highest mark says which those are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.sources.files import delete, listed, mark


class BatchTables:
    """Tables in ``folder``, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @property
    def marks(self) -> str:
        return f"{self.folder}/_committed"

    def committed(self) -> int:
        """The last batch that all tables have; -1 if there is none."""
        return max((int(n) for n in listed(self.spark, self.marks) if n.isdigit()), default=-1)

    def write(self, batch_id: int, **tables: DataFrame) -> None:
        """A batch's rows to every table, without committing them."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")

    def commit(self, batch_id: int) -> None:
        before = self.committed()
        mark(self.spark, f"{self.marks}/{batch_id}")
        if 0 <= before < batch_id:
            delete(self.spark, f"{self.marks}/{before}")

    def batch(self, name: str, batch_id: int) -> DataFrame:
        """A batch's rows, committed or not."""
        return self.spark.read.parquet(f"{self.folder}/{name}/batch={batch_id}")

    def read(self, name: str) -> DataFrame:
        """All committed rows of a table; the folders of other batches are not opened."""
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}").where(F.col("batch") <= self.committed()).drop("batch")


def to_tables(stream: DataFrame, tables: BatchTables, make, checkpoint: str):
    """Write what ``make`` makes of each micro-batch, a table each by name, exactly once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id > tables.committed():
            tables.write(batch_id, **make(batch))
            tables.commit(batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
