"""Erasure of a subject: raw rows by hash, live keys by prefix."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.dedup import erase_prefix
from tallymark.sources.files import delete, exists, listed, mark, move

MAX_SCAN, MAX_CAMPAIGNS = 100_000, 200
#: How raw rows are written: with filters by which a file shows that it cannot hold a subject.
RAW_OPTIONS = {"parquet.bloom.filter.enabled#ifa_hash": "true", "parquet.bloom.filter.expected.ndv#ifa_hash": "100000"}


def preview(raw: DataFrame, ifa_hash: str, first_day: str, last_day: str) -> DataFrame:
    """By day: rows scanned in the subject's shard, rows to delete, and rows without a hash, for which erasure stops."""
    rows = raw.where(F.col("dt").between(first_day, last_day) & (F.col("h") == ifa_hash[:4]))
    return rows.groupBy("dt").agg(F.count("*").alias("scanned"), F.count_if(F.col("ifa_hash") == ifa_hash).alias("to_delete"), F.count_if(F.col("ifa_hash").isNull()).alias("without_hash"))


def read_raw(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """Raw rows with the names of their folders as text, which a reader would else take for numbers; ``files``: of these alone."""
    fields = spark.read.parquet(path).schema.fields
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("dt", "h", "hh") else f.dataType) for f in fields])
    return spark.read.schema(schema).option("basePath", path).parquet(*(files or [path]))


def scanned_days(raw: DataFrame, ifa_hash: str, first_day: str, last_day: str, max_scan: int) -> tuple[str, bool, int, int]:
    """The first day that a scan from ``last_day`` backwards reaches, whether it was cut, its days and its rows.

    A day is scanned whole; no further day is begun once ``max_scan`` rows are scanned.
    """
    counts = {r["dt"]: r["scanned"] for r in preview(raw, ifa_hash, first_day, last_day).collect()}  # a row a day
    day, end, total, days = date.fromisoformat(last_day), date.fromisoformat(first_day), 0, 0
    while True:
        total, days = total + counts.get(day.isoformat(), 0), days + 1
        if day <= end or total >= max_scan:
            return day.isoformat(), total >= max_scan, days, total
        day -= timedelta(days=1)


def shard_of(raw: DataFrame, ifa_hash: str, first_day: str, last_day: str) -> DataFrame:
    return raw.where(F.col("dt").between(first_day, last_day) & (F.col("h") == ifa_hash[:4]))


def erase_raw(spark: SparkSession, path: str, ifa_hash: str, first_day: str, last_day: str, max_scan: int = MAX_SCAN) -> dict:
    """Rewrite the files that hold rows of the subject without them. Fails before writing if a row there has no hash.

    Files are found by the hash: ``write_raw`` gives them Bloom filters, so those that cannot hold it are not read beyond
    their footers, and files that do not hold it stay as they are. What is kept of the others is first written beside
    the table, with their list, and marked as finished. An erasure that stops before that has changed nothing; one that
    stops later is carried out first by the next call, from the finished copy.
    """
    resume(spark, path)
    raw = read_raw(spark, path)
    first_day, truncated, days, scanned = scanned_days(raw, ifa_hash, first_day, last_day, max_scan)
    shard = shard_of(raw, ifa_hash, first_day, last_day)
    if without := shard.where(F.col("ifa_hash").isNull()).count():
        raise ValueError(f"{without} rows of the shard have no hash; nothing was erased")
    file = F.col("_metadata.file_path")
    mine = shard.where(F.col("ifa_hash") == ifa_hash).groupBy(file.alias("file")).agg(F.count("*").alias("erased"))
    beside = _beside(path)
    mine.coalesce(1).write.mode("overwrite").parquet(f"{beside}/files")
    files = spark.read.parquet(f"{beside}/files")
    deleted = files.agg(F.coalesce(F.sum("erased"), F.lit(0))).first()[0]
    if deleted:
        names = [r["file"] for r in files.select("file").collect()]  # at most as many as the subject has rows
        own = read_raw(spark, path, names).where(F.col("ifa_hash") != ifa_hash)
        own.write.mode("overwrite").options(**RAW_OPTIONS).partitionBy("dt", "h", "hh").parquet(f"{beside}/kept")
        mark(spark, f"{beside}/finished")
    resume(spark, path)
    return {"scanned": scanned, "deleted": deleted, "days_scanned": days, "truncated": truncated}


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}.erasing"


def resume(spark: SparkSession, path: str) -> bool:
    """Carry out an erasure whose copy is finished, and drop one whose copy is not. Whether there was one to carry out.

    Old files go before new ones come, each step can be done again, and the copy goes last.
    """
    beside = _beside(path)
    finished = exists(spark, f"{beside}/finished")
    if finished:
        for r in spark.read.parquet(f"{beside}/files").collect():
            delete(spark, r["file"])
        for folder, name in found(spark, f"{beside}/kept"):
            move(spark, f"{beside}/kept/{folder}/{name}", f"{path.rstrip('/')}/{folder}")
        for folder in {r["file"].rsplit("/", 1)[0] for r in spark.read.parquet(f"{beside}/files").collect()}:
            if not any(n.endswith(".parquet") for n in listed(spark, folder)):
                delete(spark, folder)
    delete(spark, beside)
    return finished


def found(spark: SparkSession, kept: str) -> list[tuple[str, str]]:
    """Folder and name of each data file below ``dt=``, ``h=`` and ``hh=``."""
    folders = [""]
    for part in ("dt=", "h=", "hh="):
        folders = [f"{f}/{n}".lstrip("/") for f in folders for n in listed(spark, f"{kept}/{f}") if n.startswith(part)]
    return [(f, n) for f in folders for n in listed(spark, f"{kept}/{f}") if n.endswith(".parquet")]


def erase_keys(keys: DataFrame, key: str, hashes: list[str], campaigns: list[str]) -> DataFrame:
    """Live keys without the subject's, under each of its hashes (current and previous salt), in each campaign."""
    for h in hashes:
        for campaign in campaigns:
            keys = erase_prefix(keys, key, f"{h}|{campaign}|")
    return keys


def scope_of(campaigns: DataFrame, requested: list[str], cap: int = MAX_CAMPAIGNS) -> tuple[list[str], bool]:
    """The campaigns that an erasure covers, and whether that is provably all: none was asked for and none left out."""
    if requested:
        return requested[:cap], False
    listed = [r["campaign_id"] for r in campaigns.select("campaign_id").distinct().orderBy("campaign_id").limit(cap + 1).collect()]
    return listed[:cap], len(listed) <= cap


#: The one row that every erasure answers with.
RESULT = "dedup_deleted bigint, raw_scanned bigint, raw_deleted bigint, raw_truncated boolean, raw_days_scanned int, campaigns_scanned int, scope_complete boolean, error string"


def answer(spark: SparkSession, deleted: int, scans: list[dict], covered: list[str], complete: bool, error: str | None) -> DataFrame:
    """The result's row. A failure is never complete."""
    row = (deleted, sum(s["scanned"] for s in scans), sum(s["deleted"] for s in scans), any(s["truncated"] for s in scans), max((s["days_scanned"] for s in scans), default=0), len(covered), complete and error is None, error)
    return spark.createDataFrame([row], RESULT)


def erase_subject(
    spark: SparkSession, raw_path: str, keys: DataFrame, campaigns: DataFrame, hashes: list[str], first_day: str, last_day: str, requested: list[str] = [], max_scan: int = MAX_SCAN,
) -> tuple[DataFrame, DataFrame]:
    """Erase a subject's live keys and raw rows: the keys that are left, and the result's row.

    Every result says whether its scope is complete; a failure never is.
    """
    return _erased(spark, keys, campaigns, hashes, requested, lambda h: erase_raw(spark, raw_path, h, first_day, last_day, max_scan))


def expected_result(raw: DataFrame, keys: DataFrame, campaigns: DataFrame, hashes: list[str], first_day: str, last_day: str, requested: list[str] = [], max_scan: int = MAX_SCAN) -> DataFrame:
    """The result's row of an erasure that is only looked at, with nothing changed."""

    def look(h: str) -> dict:
        first, truncated, days, scanned = scanned_days(raw, h, first_day, last_day, max_scan)
        n = shard_of(raw, h, first, last_day).agg(F.count_if(F.col("ifa_hash") == h), F.count_if(F.col("ifa_hash").isNull())).first()
        if n[1]:
            raise ValueError(f"{n[1]} rows of the shard have no hash")
        return {"scanned": scanned, "deleted": n[0], "truncated": truncated, "days_scanned": days}

    return _erased(raw.sparkSession, keys, campaigns, hashes, requested, look)[1]


def _erased(spark: SparkSession, keys: DataFrame, campaigns: DataFrame, hashes: list[str], requested: list[str], scan) -> tuple[DataFrame, DataFrame]:
    """What is left of ``keys``, and the result's row of an erasure whose raw rows are ``scan``'s."""
    covered, complete = scope_of(campaigns, requested)
    if not covered:
        return keys, answer(spark, 0, [], [], False, "no_campaigns")
    left, scans, error = erase_keys(keys, "key", hashes, covered), [], None
    deleted = keys.count() - left.count()
    try:
        for h in hashes:
            scans.append(scan(h))
    except ValueError:
        error = "raw_erase_failed"
    return left, answer(spark, deleted, scans, covered, complete, error)
