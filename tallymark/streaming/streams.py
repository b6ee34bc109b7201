"""Streaming twins: deduplication, salt rotation, call claims and rate limits by state, hourly rollups, and candidates of
calls by interval join (``matching`` has the matched calls, ``ingest`` the whole way of a beacon).

Event time and watermarks are additions: the batch operators take arrival order as the only order. Rows later
than the watermark are dropped; the folds take the others as they arrive, in order of time within a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallymark.operators import dedup
from tallymark.operators.reports import events


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def folded(stream: DataFrame, key: str, name: str, start: tuple, fold: Callable, columns: dict[str, str], delay: str, keep: int) -> DataFrame:
    """``key``, ``t``, ``seq`` and the Boolean ``name`` of each row, by one of the folds of the batch operators.

    A key's state is the fold's: its expiries. It goes when the watermark (``delay`` behind the latest ``t``) has passed
    its last row by ``keep`` seconds, so a pause of the stream ends no window, however long it lasts.
    """

    def step(key_values: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["t", "seq"])
        lists, flags = {c: rows[c].tolist() for c in ("t", *columns)}, [False] * len(rows)
        state.update(fold(tuple(state.get) if state.exists else start, lists, flags, 0, len(rows)))
        state.setTimeoutTimestamp(max((lists["t"][-1] + keep) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: key_values[0], "t": rows["t"], "seq": rows["seq"], name: flags})

    rows = stream.select(key, "t", "seq", *columns, F.timestamp_seconds("t").alias("_at")).withWatermark("_at", delay)
    kept = ", ".join(f"s{i} long" for i in range(len(start)))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, t long, seq long, {name} boolean", kept, "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(stream: DataFrame, key: str, ttl: int, delay: str = "1 hour") -> DataFrame:
    """``is_first`` by fixed windows. A stretch of arrivals that are all repeats does not move the expiry."""
    return folded(stream, key, "is_first", (dedup.BEFORE,), dedup.fixed_fold(ttl), {}, delay, ttl)


def rotating(stream: DataFrame, device: str, ttl: int, delay: str = "1 hour") -> DataFrame:
    """``is_first`` under a change of salts; ``after`` says whether an event bears the new salt."""
    return folded(stream, device, "is_first", (dedup.BEFORE,) * 2, dedup.rotation_fold(ttl), {"after": "boolean"}, delay, ttl)


def claims(stream: DataFrame, key: str, ttl: int, delay: str = "1 hour") -> DataFrame:
    """``is_claimed`` of each attempt; ``sent`` says if its send succeeded."""
    return folded(stream, key, "is_claimed", (dedup.BEFORE,), dedup.claim_fold(ttl), {"sent": "boolean"}, delay, ttl)


def rate_limited(stream: DataFrame, key: str, limit: int, delay: str = "1 hour", seconds: int = 60) -> DataFrame:
    """``t``, ``seq`` and ``allowed`` of each row. A key's count of a minute is its state, and goes ``seconds`` after its
    last hit; refused hits count."""
    free = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    if limit <= 0:
        return stream.select("t", "seq", F.lit(True).alias("allowed"))

    def fold(state: tuple, rows: dict, flags: list, a: int, b: int) -> tuple:
        for i in range(a, b):
            flags[i] = state[0] + i - a < limit
        return (state[0] + b - a,)

    slots = stream.where(~free).withColumn("_slot", F.concat_ws("\0", F.floor(F.col("t") / seconds).cast("string"), F.col(key).cast("string")))
    out = folded(slots, "_slot", "allowed", (0,), fold, {}, delay, seconds).drop("_slot")
    return out.union(stream.where(free).select("t", "seq", F.lit(True).alias("allowed")))


def hourly(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Counts by hour and ``keys``, each emitted when the watermark has passed its hour. ``ts`` is a timestamp."""
    d = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), *keys).agg(events())
    return d.select(F.col("w.start").alias("hour"), *keys, "impressions")


def candidates(calls: DataFrame, recent: DataFrame, window_minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Each call with each impression of its store in the closed window before it; calls without any come with
    nulls when the watermark has passed. Both have ``store_key`` and a timestamp (``call_at``, ``imp_at``)."""
    c, r = calls.withWatermark("call_at", delay), recent.withWatermark("imp_at", delay).withColumnRenamed("store_key", "imp_store")
    near = (F.col("store_key") == F.col("imp_store")) & (F.col("imp_at") <= F.col("call_at")) & (F.col("imp_at") >= F.col("call_at") - F.expr(f"interval {window_minutes} minutes"))
    return c.join(r, near, "leftOuter")
