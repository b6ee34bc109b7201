"""The driver's ``events`` as beacons, impressions, calls and ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import expressions as x

CREATIVES = 10
STATES = ("California", "Texas", "New York", "Illinois")
AREA_CODES = (("415", "California"), ("214", "Texas"), ("212", "New York"), ("312", "Illinois"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "ts", "user_id", "event_type", "value", x.second_of(F.col("ts")).alias("t"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e, k = F.col("user_id"), F.col("event_id"), F.col("k")
    roku = u % 2 == 0
    present = (k >= 10).cast("int").cast("string")
    native = lambda p, x: F.when(roku, F.concat(F.lit(p), x.cast("string"))).otherwise("")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return events(spark, sf_dir).where(F.col("event_type").isin("view", "click")).select(
        "t", "seq", "ts", "user_id", "event_type", "k",
        name("adv_", u % 3).alias("advertiser_id"),
        name("camp_", e % 5).alias("campaign_id"),
        name("cre_", u % CREATIVES).alias("creative_id"),
        F.when(roku, "roku").otherwise("ua").alias("platform"),
        F.when(k % 10 == 0, "XX").when(k % 10 == 1, "CA").otherwise("US").alias("country"),
        (k < 5).alias("lmt"),
        present.alias("ifa_present"),
        F.when(k >= 10, F.sha2(F.concat(F.lit("salt|"), u.cast("string")).cast("binary"), 256)).otherwise("anon").alias("ifa_hash"),
        F.element_at(F.array(*map(F.lit, STATES)), (u % 4 + 1).cast("int")).alias("region"),
        (500 + u % 20).cast("string").alias("dma"),
        F.concat(F.lit("app."), (k % 3).cast("string")).alias("app_id"),
        F.when(roku, "ip").otherwise("rida").alias("ifa_type"),
        native("ra_", u % 3).alias("roku_advertiser_id"),
        native("rc_", e % 5).alias("roku_campaign_id"),
        native("rr_", u % CREATIVES).alias("roku_creative_id"),
        (1 + e % 4).alias("_sample_interval"),
    )


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    blank = F.lit("")
    return impressions(spark, sf_dir).select(
        F.col("creative_id").alias("store_key"), F.col("t").alias("ts"), "seq",
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip"),
        F.when(F.col("platform") == "ua", F.concat(F.lit("dev-"), u)).otherwise(blank).alias("rida"),
        F.when(F.col("platform") == "ua", F.concat(F.lit("hh-"), u)).otherwise(blank).alias("hh_id"),
        "region", blank.alias("city"), blank.alias("postal"), "lmt",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c, _ in AREA_CODES]), (F.col("event_id") % 4 + 1).cast("int"))
    return events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.col("seq").alias("call_seq"), "seq", "t", "k",
        F.concat(F.lit("call-"), F.col("event_id").cast("string")).alias("callId"),
        F.concat(F.lit("cre_"), (F.col("user_id") % CREATIVES).cast("string")).alias("creative_id"),
        F.concat(F.lit("cre_"), (F.col("user_id") % CREATIVES).cast("string")).alias("store_key"),
        F.col("t").alias("call_ts"), F.col("t").alias("start_time"), F.col("value").alias("duration"),
        F.concat(F.lit("+1"), code, F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("ani"),
        F.when(F.col("k") >= 50, F.col("value")).alias("sale_value"),
        F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("event_group_id"),
    )


def area_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AREA_CODES, "area_code string, state string")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``received`` row for each beacon and a terminal row for each beacon and call."""
    e = events(spark, sf_dir)
    k, kind = F.col("k"), F.col("event_type")
    terminal = (
        F.when(kind == "view", "counted").when(kind == "click", "duplicate")
        .when((kind == "error") & (k < 50), "reject_bad_signature").when(kind == "error", "reject_outside_flight")
        .when(kind == "signup", "reject_not_allowlisted")
        .when(k < 40, "call_fired").when(k < 80, "call_dry_run").otherwise("call_not_qualified")
    )
    rows = F.when(kind == "purchase", F.array(terminal)).otherwise(F.array(F.lit("received"), terminal))
    return e.select("ts", F.explode(rows).alias("outcome"), F.concat(F.lit("camp_"), (F.col("event_id") % 5).cast("string")).alias("campaign_id"), F.lit(1).cast("bigint").alias("_sample_interval"))


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query string for each event, with missing, unfilled, damaged and repeated parameters among them."""
    e, k, u = F.col("event_id"), F.col("k"), F.col("user_id")
    s = lambda x: x.cast("string")
    camp = F.when(k == 0, "").when(k == 1, "no such").otherwise(F.concat(F.lit("camp_"), s(e % 7)))
    ip = F.when(k % 10 == 3, "0.0.0.0").when(k % 10 == 4, "[[[DEVICE_IP]]]").when(k % 10 == 5, "10.0.0.256").otherwise(F.concat(F.lit("10.0."), s(u % 200), F.lit("."), s(u % 250)))
    ifa = F.when(k % 10 == 3, "00000000-0000-0000-0000-000000000000").when(k % 10 == 4, "%%RIDA%%").when(k % 10 == 5, "FFFF-FFFF").otherwise(F.concat(F.lit("dev-"), s(u)))
    country = F.when(k % 10 == 1, "ca").when(k % 10 == 2, "${CC}").otherwise("US")
    dma = F.when(k % 4 == 1, F.concat(F.lit("&dma"), s(500 + u % 20))).when(k % 4 == 2, "&dma=x").otherwise(F.concat(F.lit("&dma="), s(500 + u % 20)))
    query = F.concat(
        F.lit("advertiser_id=adv_"), s(u % 3), F.when(k % 11 == 3, "&campaign%5Fid=").otherwise("&campaign_id="), camp, F.lit("&creative_id=cre%5F"), s(u % CREATIVES),
        F.when(u % 2 == 1, "&pf=ua").otherwise(""), F.lit("&device_ip="), ip, F.lit("&ifa="), ifa, F.lit("&lmt="),
        F.when(k % 7 == 0, "1").when(k % 7 == 1, "[LMT]").when(k % 7 == 2, "no").otherwise(""),
        F.lit("&country="), country, dma, F.lit("&campaign_id=other"),
    )
    return events(spark, sf_dir).select("seq", "t", F.col("t").alias("recv_ts"), query.alias("query"), F.concat(F.lit("192.0.2."), s(u % 7)).alias("connecting_ip"), "k", "user_id", "event_id")


def campaigns(spark: SparkSession) -> DataFrame:
    rows = [
        ("camp_0", "active"), ("camp_1", "child_directed"), ("camp_2", '{"start": "2024-01-05", "end": "2024-01-20"}'),
        ("camp_3", '{"status": "paused"}'), ("camp_4", '{"markets": ["us", "CA", "bogus"]}'), ("camp_5", "{not json"),
    ]
    return spark.createDataFrame(rows, "campaign_id string, value string")


CALL_KEY = "call-key"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed request for each call, with forged, damaged, unknown, short and repeated ones among them."""
    e, k, u, t = F.col("event_id"), F.col("k"), F.col("user_id"), F.col("t")
    s = lambda x: x.cast("string")
    code = F.element_at(F.array(*[F.lit(c) for c, _ in AREA_CODES]), (e % 4 + 1).cast("int"))
    dnis = F.when(k.between(15, 19), "+18005550177").when(k.between(20, 24), "+18005550199").otherwise(F.concat(F.lit("+1800555010"), s(u % CREATIVES)))
    body = F.concat(
        F.lit('{"callId":"c'), s(e % 200), F.lit('","dnis":"'), dnis, F.lit('","ani":"+1'), code, F.lpad(s(u), 7, "0"),
        F.lit('","startTime":'), s(t), F.lit(',"durationSeconds":'), s(F.col("value")), F.when(k.between(10, 14), "").otherwise("}"),
    )
    stamp = s(t + 5)
    signature = F.when(k < 10, "00").otherwise(x.hmac_sha256(CALL_KEY, F.concat_ws(".", stamp, body)))
    calls = events(spark, sf_dir).where("event_type = 'purchase'")
    return calls.select("seq", (t + 5).alias("recv_ts"), F.concat(F.lit("198.51.100."), s(u % 3)).alias("ip"), stamp.alias("x_timestamp"), signature.alias("x_signature"), body.cast("binary").alias("body"), (k % 2 == 0).alias("sent"))


def numbers(spark: SparkSession) -> DataFrame:
    """Ten mapped numbers: odd ones of the other platform, one that every call qualifies for; and a bad mapping."""
    rows = [(f"+1800555010{i}", f'{{"creativeId": "cre_{i}", "campaignId": "camp_{i % 5}"' + (', "platform": "ua"' if i % 2 else "") + (', "qualifySeconds": 0' if i == 3 else "") + "}") for i in range(CREATIVES)]
    return spark.createDataFrame([*rows, ("+18005550199", '{"creativeId": "a b"}')], "dnis string, value string")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed side writes and jobs, for some of the events."""
    kind = F.when(F.col("k") == 97, "raw_write_error").when(F.col("k") == 98, "export_failed").otherwise("recent_write_error")
    return events(spark, sf_dir).where("k >= 97").select("t", kind.alias("kind"), F.concat(F.lit("camp_"), (F.col("event_id") % 5).cast("string")).alias("campaign_id"))
