"""Hits of a key in a minute, in order; refused hits count too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(df: DataFrame, key: str, limit: int, seconds: int = 60, before: DataFrame | None = None) -> DataFrame:
    """Adds ``allowed``. No limit (0 or less) and empty keys allow all. Needs ``t`` and ``seq``. ``before``: the ``hits``
    of earlier batches."""
    if limit <= 0:
        return df.withColumn("allowed", F.lit(True))
    minute = F.floor(F.col("t") / seconds)
    free = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    apart = F.when(free, F.col("seq"))  # rows without a key are not ranked together
    nth, start = F.row_number().over(Window.partitionBy(key, minute, apart).orderBy("t", "seq")), F.lit(0)
    if before is not None:
        held = before.select(F.col("key").alias("_held"), F.col("minute").alias("_minute"), F.col("n").alias("_before"))
        df = df.join(held, (F.col(key).cast("string") == F.col("_held")) & (minute == F.col("_minute")), "left")
        start = F.coalesce("_before", F.lit(0))
    return df.withColumn("allowed", free | (nth + start <= limit)).drop("_held", "_minute", "_before")


def hits(df: DataFrame, key: str, before: DataFrame | None = None, seconds: int = 60) -> DataFrame:
    """``key``, ``minute`` and ``n``: the hits so far."""
    d = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").where("t is not null")
    n = d.groupBy(F.col(key).cast("string").alias("key"), F.floor(F.col("t") / seconds).alias("minute")).agg(F.count("*").alias("n"))
    return n if before is None else n.unionByName(before).groupBy("key", "minute").agg(F.sum("n").alias("n"))
