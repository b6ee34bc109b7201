"""Readers with fixed schemas, and writers that append or replace whole partitions."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.config import checked_date, export_date
from tallymark.operators.erase import RAW_OPTIONS
from tallymark.operators.reports import daily_rollup, rollup
from tallymark.schemas import BEACON, CALL_REQUEST, EVENT, EVENT_NAMES, EXPORT_KEYS, LOOKUP, MARKER


def read_beacons(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(BEACON).json(path)


def read_calls(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(CALL_REQUEST).parquet(path)


def read_lookup(spark: SparkSession, path: str, prefix: str, name: str) -> DataFrame:
    """Key-value pairs of a prefix (``campaign:``, ``number:``) as ``name`` and ``value``."""
    d = spark.read.schema(LOOKUP).json(path).where(F.col("key").startswith(prefix))
    return d.select(F.col("key").substr(F.lit(len(prefix) + 1), F.length("key")).alias(name), "value")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored impressions; names that older files lack read as empty."""
    return spark.read.schema(EVENT).parquet(path).fillna("", list(EVENT_NAMES))


def read_area_codes(spark: SparkSession, path: str) -> DataFrame:
    """Area codes and their states from comma-separated text; the table is public and belongs to the installation."""
    return spark.read.schema("area_code string, state string").option("header", "true").csv(path)


def numeric(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Numbers that came as text in a report's result, by the type the result names; nulls stay."""
    return df.withColumns({n: F.col(n).try_cast(spark_type(k)) for n, k in kinds.items() if spark_type(k) != "string"})


def spark_type(kind: str) -> str:
    """The type of a result's column by the name that the result gives it, with or without ``Nullable``."""
    inner = re.sub(r"\ANullable\((.+)\)\Z", r"\1", kind)
    if re.match(r"U?Int(8|16|32|64|128|256)", inner):
        return "bigint"
    return "double" if re.match(r"Float(32|64)|Decimal", inner) else "string"


def results(documents: DataFrame, column: str = "value") -> DataFrame:
    """The rows of result documents, ``{"meta": [{"name", "type"}], "data": [{...}]}``, in the columns that ``meta`` names.

    The names and types are those of the first document that has some; numbers may stand as text. What is no number of
    its column's type is null, as are columns that a row lacks. Documents that cannot be read have no rows.
    """
    v = documents.select(F.try_parse_json(column).alias("v"))
    meta = F.try_variant_get("v", "$.meta", "array<struct<name: string, type: string>>")
    first = v.select(meta.alias("meta")).where(F.size("meta") > 0).limit(1).collect()
    rows = v.select(F.explode(F.try_variant_get("v", "$.data", "array<variant>")).alias("row"))
    field = lambda n: F.try_variant_get("row", "$['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']", "string")
    columns = [(m["name"], spark_type(m["type"])) for m in (first[0]["meta"] if first else [])]
    value = lambda n, k: field(n) if k == "string" else F.trim(field(n)).try_cast(k)
    return rows.select(*[value(n, k).alias(n) for n, k in columns])


def append_daily(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a table of days."""
    df.withColumn("dt", F.col(ts).cast("date")).write.mode("append").partitionBy("dt").parquet(path)


def write_raw(rows: DataFrame, path: str) -> None:
    """Append raw rows in their day, shard and hour."""
    # The shard of rows without an identity is as large as all others together: it is dealt by hour and row.
    apart = F.when(F.col("h") == "anon", F.concat_ws("|", "hh", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("dt", "h", "hh")]), F.lit(16))))
    rows.repartition("dt", "h", apart).sortWithinPartitions("dt", "h", "hh").write.mode("append").options(**RAW_OPTIONS).partitionBy("dt", "h", "hh").parquet(path)


def write_rollup(events: DataFrame, path: str) -> None:
    """Hourly counts of all days, a folder a day."""
    rollup(events).write.mode("overwrite").partitionBy("dt").parquet(path)


def add_to_rollup(spark: SparkSession, late: DataFrame, path: str) -> list[str]:
    """Add events that came late to the hourly counts of their days: sums of sums. Only those days are rewritten."""
    new = rollup(late)
    days = [r["dt"] for r in new.select("dt").distinct().collect()]  # a row a day
    if days:
        old = spark.read.schema(new.schema).parquet(path).where(F.col("dt").isin(days))
        both = old.unionByName(new).groupBy("dt", *EXPORT_KEYS).agg(F.sum("impressions").alias("impressions"))
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    return sorted(days)


def export_day(spark: SparkSession, events: DataFrame, path: str, day: str, now: datetime, partial: bool = False) -> DataFrame:
    """Replace one day's export and its status document; fails if fewer rows were written than there are."""
    rollup = daily_rollup(events, day, EXPORT_KEYS)
    rollup.write.mode("overwrite").json(f"{path}/dt={day}")
    written = spark.read.schema(rollup.schema).json(f"{path}/dt={day}").count()
    expected = rollup.count()
    if written < expected:
        raise ValueError(f"the export of {day} has {written} of {expected} rows")
    marker = spark.createDataFrame([(day, written, f"dt={day}", now, partial)], MARKER)
    marker.coalesce(1).write.mode("overwrite").json(f"{path}/_status/last_export.json")
    return marker


def backfill(spark: SparkSession, events: DataFrame, path: str, day: str, now: datetime) -> DataFrame:
    """Export a day again; later days are refused, and a day that is not over is marked as partial."""
    day, partial = checked_date(day, now.date().isoformat())
    return export_day(spark, events, path, day, now, partial)


def nightly_export(spark: SparkSession, events: DataFrame, path: str, now: datetime) -> DataFrame:
    """The export of a nightly run: the day before ``now``."""
    return export_day(spark, events, path, export_date(now), now)


def read_marker(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKER).json(f"{path}/_status/last_export.json")


def write_status(row: DataFrame, path: str, name: str) -> None:
    """A verdict of one row as a document."""
    row.coalesce(1).write.mode("overwrite").json(f"{path}/_status/{name}.json")


def write_payloads(df: DataFrame, path: str) -> None:
    """Conversion events to send, one document a line; sending is another program's work."""
    df.select(F.col("payload").cast(T.StringType()).alias("value")).write.mode("append").text(path)
