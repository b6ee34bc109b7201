"""The store of live keys between batches: buckets by key, sorted, so a batch meets it without moving it.

A version is a table of its own, written next to the one before and named by the batch that made it; a version that is not
finished is written anew. Batches are joined to it on its buckets: only the batch is shuffled, whatever the store's size.
Expired keys go when the next version is made.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.sources.files import delete, listed


class KeyStore:
    """Versions of ``key`` and ``exp`` in ``folder``, which all executors share. ``buckets`` stays the same for its life."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 200):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def name(self, version: int) -> str:
        return f"store_{hashlib.md5(self.folder.encode()).hexdigest()}_{version}"

    def versions(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in listed(self.spark, self.folder) if n.startswith("version="))

    def write(self, keys: DataFrame, version: int) -> DataFrame:
        """A new version; what a broken attempt left of it goes first."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(version)}")
        delete(self.spark, self.path(version))
        d = keys.select("key", F.col("exp").cast("bigint").alias("exp"))
        d = d.repartition(self.buckets, "key")  # no further shuffle where a version before was merged
        d.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", self.path(version)).saveAsTable(self.name(version))
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        """A version, also one that another session wrote."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(version)} (key STRING, exp BIGINT) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path(version)}'"
        )
        return self.spark.table(self.name(version))

    def forget(self, before: int) -> None:
        """Versions older than ``before`` go."""
        for v in self.versions():
            if v < before:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.name(v)}")
                delete(self.spark, self.path(v))


def merged(seen: DataFrame, new: DataFrame, as_of: int) -> DataFrame:
    """The store with ``new`` keys, without expired ones. Joined, as a union would move the store."""
    n = new.select(F.col("key").alias("_key"), F.col("exp").alias("_exp"))
    both = seen.join(n, F.col("key") == F.col("_key"), "full")
    d = both.select(F.coalesce("key", "_key").alias("key"), F.greatest("exp", "_exp").alias("exp"))
    return d.where(F.col("exp") > as_of)
