"""Reports over impressions and the ledger. Counts are sums of row weights; ``as_of`` stands for now."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.config import report_days, report_hours
from tallymark.schemas import EXPORT_KEYS

WEIGHT = "_sample_interval"


def since(df: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    """Strictly later than ``hours`` before ``as_of``: a literal bound, so scans can skip by it."""
    return df.where(F.col("ts") > F.lit((as_of - timedelta(hours=hours)).isoformat(sep=" ")).cast("timestamp_ntz"))


def events(name: str = "impressions"):
    return F.sum(WEIGHT).cast("bigint").alias(name)


def hour():
    return F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")


def by_campaign(imps: DataFrame, as_of: datetime, days: float = 7) -> DataFrame:
    return since(imps, as_of, 24 * report_days(days)).groupBy("campaign_id").agg(events()).orderBy(F.desc("impressions"), "campaign_id")


def by_country(imps: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    return since(imps, as_of, report_hours(hours)).groupBy("country").agg(events()).orderBy(F.desc("impressions"), "country")


def hourly_trend(imps: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """Hours without impressions have no row."""
    return since(imps, as_of, report_hours(hours)).groupBy(hour()).agg(events()).orderBy("hour")


def reach(imps: DataFrame, as_of: datetime, campaign: str | None = None, days: float = 30, exact: bool = True) -> DataFrame:
    """Distinct known devices; a campaign asked for has a row even if it has none."""
    d = since(imps, as_of, 24 * report_days(days, 30)).where("ifa_present = '1'")
    n = (F.countDistinct if exact else F.approx_count_distinct)("ifa_hash").alias("reach")
    if campaign is None:
        return d.groupBy("campaign_id").agg(n)
    return d.where(F.col("campaign_id") == campaign).agg(n).select(F.lit(campaign).alias("campaign_id"), "reach")


def frequency(imps: DataFrame, as_of: datetime, days: float = 30) -> DataFrame:
    """How many devices saw a campaign how often."""
    d = since(imps, as_of, 24 * report_days(days, 30)).where("ifa_present = '1'")
    return d.groupBy("campaign_id", "ifa_hash").agg(events("frequency")).groupBy("campaign_id", "frequency").agg(F.count("*").alias("devices"))


def ledger_summary(ledger: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    return since(ledger, as_of, report_hours(hours)).groupBy("outcome").agg(events("events")).orderBy(F.desc("events"), "outcome")


def daily_rollup(imps: DataFrame, day: str, keys: tuple[str, ...] = EXPORT_KEYS) -> DataFrame:
    """Hourly counts of one day by all stored dimensions; the day is half open."""
    start = F.lit(day).cast("timestamp_ntz")
    end = F.lit((datetime.fromisoformat(day) + timedelta(days=1)).isoformat(sep=" ")).cast("timestamp_ntz")
    d = imps.where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy(hour(), *[k for k in keys if k != "hour"]).agg(events())
    return d.orderBy(*keys)


def rollup(imps: DataFrame) -> DataFrame:
    """Hourly counts of every day by all stored dimensions, with the day as text in ``dt``."""
    d = imps.groupBy(hour(), *[k for k in EXPORT_KEYS if k != "hour"]).agg(events())
    return d.withColumn("dt", F.date_format("hour", "yyyy-MM-dd"))


#: Logarithm of the registers of a stored sketch, and the error that an estimate stays within (three standard errors).
SKETCH_BITS = 12


def sketch_bound(bits: int = SKETCH_BITS) -> float:
    return 3 * 1.04 / 2 ** (bits / 2)


def reach_sketches(imps: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """A mergeable sketch of the known devices of each ``day`` and campaign, to be stored instead of read again."""
    known = imps.where("ifa_present = '1'")
    return known.groupBy(F.col("ts").cast("date").alias("day"), "campaign_id").agg(F.hll_sketch_agg("ifa_hash", F.lit(bits)).alias("sketch"))


def merged_sketches(*stored: DataFrame) -> DataFrame:
    """Stored sketches and those of rows that came later, as one of each day and campaign."""
    d = stored[0]
    for more in stored[1:]:
        d = d.unionByName(more)
    return d.groupBy("day", "campaign_id").agg(F.hll_union_agg("sketch").alias("sketch"))


def reach_between(sketches: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Estimated ``reach`` of each campaign over any span of days, both included, from the sketches alone."""
    d = sketches.where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    return d.groupBy("campaign_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("reach"))


def native_ids(imps: DataFrame, as_of: datetime, days: float = 30) -> DataFrame:
    d = since(imps, as_of, 24 * report_days(days, 30)).where("platform = 'roku'")
    return d.groupBy("roku_advertiser_id", "roku_campaign_id", "roku_creative_id").agg(events(), F.max("ts").alias("last_seen")).orderBy(F.desc("impressions"), "roku_campaign_id", "roku_creative_id")


def volume_alerts(imps: DataFrame, deviation: float = 0.2) -> DataFrame:
    """Days whose count is further from the day before than ``deviation`` of it."""
    day = F.col("ts").cast("date").alias("day")
    d = imps.groupBy(day).agg(events()).withColumn("before", F.lag("impressions").over(Window.orderBy("day")))
    off = F.abs(F.col("impressions") - F.col("before")) / F.col("before")
    return d.withColumn("is_alert", F.coalesce(off > deviation, F.lit(False)))


def counted_alerts(ledger: DataFrame, least: float = 0.5) -> DataFrame:
    """Days on which fewer of the beacons received were counted than ``least`` of them."""
    sums = [F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col(WEIGHT))), F.lit(0)).cast("bigint").alias(o) for o in ("received", "counted")]
    d = ledger.groupBy(F.col("ts").cast("date").alias("day")).agg(*sums)
    ratio = F.when(F.col("received") > 0, F.col("counted").cast("double") / F.col("received").cast("double"))
    return d.withColumn("counted_ratio", ratio).withColumn("is_alert", F.coalesce(ratio < least, F.lit(False)))


def page(df: DataFrame, keys: list[str], offset: int, size: int) -> DataFrame:
    """A page in the order of all keys."""
    return df.orderBy(*keys).offset(offset).limit(size)


def listing(keys: DataFrame, key: str, prefix: str, limit: int = 200) -> DataFrame:
    """Keys of a prefix in order, at most ``limit``, with ``complete``: whether that is all of them."""
    found = keys.where(F.col(key).startswith(prefix)).select(key).orderBy(key).limit(limit + 1)
    n = found.withColumn("_n", F.row_number().over(Window.orderBy(key)))
    return n.withColumn("complete", F.max("_n").over(Window.partitionBy()) <= limit).where(F.col("_n") <= limit).drop("_n")
