"""Beacons: parsing, the ordered verdict, deduplication and the tables that come of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.config import Settings, is_placeholder
from tallymark.functions import expressions as x
from tallymark.operators.dedup import dedup_key, fixed_window, live_keys, scope
from tallymark.operators.dimensions import dimension
from tallymark.operators.ratelimit import rate_limited
from tallymark.schemas import CAMPAIGN, EVENT_NAMES
from tallymark.sources.tables import written


def campaign_configs(campaigns: DataFrame) -> DataFrame:
    """``campaign_id`` and its settings; malformed or inactive ones are absent. A bare word is active."""
    raw = campaigns.select(F.col("campaign_id").alias("c_id"), x.trimmed(F.col("value")).alias("v"))
    j = F.from_json("v", CAMPAIGN, {"columnNameOfCorruptRecord": "_bad"})
    c = raw.withColumn("j", F.when(F.col("v").startswith("{"), j))
    status = F.lower(x.trimmed(F.coalesce(F.col("j.status"), F.lit("active"))))
    child = F.when(F.col("j").isNull(), F.col("v") == "child_directed").otherwise((status == "child_directed") | F.coalesce(F.col("j.child_directed") == "true", F.lit(False)))
    markets = F.filter(F.transform(F.coalesce("j.markets", F.array().cast("array<string>")), lambda m: F.upper(x.trimmed(m))), lambda m: m.rlike(x.COUNTRY))
    ok = (F.col("v") != "") & (F.col("j").isNull() | (F.col("j._bad").isNull() & status.isin("active", "child_directed")))
    return c.where(ok).select("c_id", child.alias("child_directed"), x.boundary(F.col("j.start"), False).alias("starts_at"), x.boundary(F.col("j.end"), True).alias("ends_at"), markets.alias("markets"))


def parsed(beacons: DataFrame, campaigns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All fields of each beacon, and ``reason``: null, or why it is refused (the first reason in order)."""
    q, now = F.col("query"), F.col("recv_ts")
    names = ("advertiser_id", "campaign_id", "creative_id", "pf", "device_ip", "ifa", "ifa_type", "lmt", "app_id", "country", "exp", "sig", "cb", "roku_advertiser_id", "roku_campaign_id", "roku_creative_id", "roku_postal_code", "hh_id")
    plain = F.col("_plain")
    d = beacons.withColumn("_plain", x.plain_keys(q))
    d = d.select(*beacons.columns, *[x.written(plain, n).alias(f"_v_{n}") for n in names], x.market_area(plain).alias("dma"))
    d = d.select(*beacons.columns, *[x.read(F.col(f"_v_{n}")).alias(f"p_{n}") for n in names], "dma")
    d = d.join(dimension(campaign_configs(campaigns)), F.col("p_campaign_id") == F.col("c_id"), "left")
    p = {n: F.col(f"p_{n}") for n in names}
    roku = p["pf"] != "ua"
    child = F.coalesce("child_directed", F.lit(False))
    limited = F.when(roku, child | (p["device_ip"] == "0.0.0.0")).otherwise(x.limits_tracking(p["lmt"], child))
    subject = F.when(roku, F.concat(F.lit("ip:"), p["device_ip"])).otherwise(p["ifa"])
    usable = ~limited & F.when(roku, x.usable_ipv4(p["device_ip"])).otherwise(x.usable_ad_id(p["ifa"]))
    usable = usable & F.lit(not is_placeholder(settings.hash_salt))
    edge = F.upper(x.text(F.col("cf.country"))) if "cf" in beacons.columns else F.lit("")
    country = F.when(F.upper(p["country"]).rlike(x.COUNTRY), F.upper(p["country"])).when(edge.rlike(x.COUNTRY), edge).otherwise("XX")
    d = d.withColumns({"is_roku": roku, "lmt": limited, "identified": usable, "subject": subject, "country": country, "child": child})
    licensed = F.array(*map(F.lit, settings.licensed_markets))
    markets = F.when(F.size(F.coalesce("markets", F.array().cast("array<string>"))) > 0, F.col("markets")).otherwise(licensed)
    known = F.col("country") != "XX"
    reason = F.when(~(p["advertiser_id"].rlike(x.ID) & p["campaign_id"].rlike(x.ID) & p["creative_id"].rlike(x.ID)), "missing_params")
    if settings.signature_required:
        verdict = x.tag_verdict(settings.signing_key, p["advertiser_id"], p["campaign_id"], p["creative_id"], p["exp"], p["sig"], now)
        reason = reason.when(verdict.isNotNull(), verdict)
    reason = (
        reason.when(F.col("c_id").isNull(), "not_allowlisted")
        .when((now < F.col("starts_at")) | (now > F.col("ends_at")), "outside_flight")
        .when((known & ~F.array_contains(markets, F.col("country"))) | (~known & F.lit(settings.reject_unknown_market)), "out_of_market")
    )
    native = lambda n: F.when(F.col("is_roku"), x.valid_or(F.col(f"p_{n}"), x.ID)).otherwise("")
    encoded = x.raw_param(q, "roku_creative_id_encoded")
    out = {
        "reason": reason,
        "advertiser_id": p["advertiser_id"],
        "campaign_id": p["campaign_id"],
        "creative_id": p["creative_id"],
        "platform": F.when(F.col("is_roku"), "roku").otherwise("ua"),
        "ifa_hash": F.when(F.col("identified"), x.hashed(settings.hash_salt or "", F.col("subject"))).otherwise("anon"),
        "previous_hash": F.when(F.col("identified"), x.hashed(settings.previous_salt, F.col("subject"))) if settings.previous_salt else F.lit(None).cast("string"),
        "ifa_present": F.col("identified").cast("int").cast("string"),
        "app_id": x.valid_or(p["app_id"], x.APP_ID, "unknown"),
        "ifa_type": F.when(F.col("is_roku"), "ip").otherwise(x.valid_or(F.lower(p["ifa_type"]), x.TOKEN)),
        "device_ip": F.when(F.col("is_roku") & F.col("identified"), p["device_ip"]).otherwise(""),
        "sent_device_ip": p["device_ip"],
        "ad_id": F.when(~F.col("is_roku") & F.col("identified"), p["ifa"]).otherwise(""),
        **{n: native(n) for n in ("roku_advertiser_id", "roku_campaign_id", "roku_creative_id")},
        "roku_creative_id_encoded": F.when(F.col("is_roku") & encoded.rlike(r"\A[A-Za-z0-9+/=_-]{1,128}\z"), encoded).otherwise(""),
        "roku_postal_code": F.when(F.col("is_roku") & ~F.col("lmt"), x.valid_or(p["roku_postal_code"], r"\A[A-Za-z0-9 -]{1,16}\z")).otherwise(""),
        "roku_cachebuster": F.when(F.col("is_roku"), x.valid_or(p["cb"], r"\A[A-Za-z0-9_-]{1,128}\z")).otherwise(""),
        "hh_id": F.when(~F.col("is_roku") & F.col("identified"), p["hh_id"]).otherwise(""),
    }
    keep = [c for c in beacons.columns if c not in out]
    return d.select(*keep, *[v.alias(k) for k, v in out.items()], "lmt", "country", "dma")


def ingested(beacons: DataFrame, campaigns: DataFrame, settings: Settings = Settings(), seen: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Each beacon with its one terminal ``outcome``. Needs ``seq`` and ``recv_ts``.

    The kill switch comes first, then the rate limit by connecting address, then the verdict, then repeats. ``seen``
    is the store of live keys at the start (``stored`` of the batch before), ``hits`` the hits of earlier batches. While ``settings.previous_salt`` is set, a
    beacon whose device lives there under the previous salt is a repeat too. A beacon without a time is ``reject_internal``.
    ``is_seed`` says whether a beacon sets its key. What is parsed is written to the shared folder once.
    """
    d = rate_limited(beacons.withColumn("t", F.col("recv_ts")), "connecting_ip", settings.rate_limit, before=hits)
    d = parsed(d, campaigns, settings)
    early = (
        F.when(F.lit(not settings.enabled), "disabled")
        .when(F.col("t").isNull(), "reject_internal")
        .when(~F.col("allowed"), "reject_rate_limited")
        .when(F.col("reason").isNotNull(), F.concat(F.lit("reject_"), F.col("reason")))
    )
    d = d.withColumn("early", early)
    s = scope(F.col("platform"), F.col("campaign_id"), F.col("creative_id"), F.col("roku_campaign_id"), F.col("roku_creative_id"))
    key = dedup_key(F.col("ifa_present") == "1", F.col("ifa_hash"), s, F.col("connecting_ip"), F.col("t"), settings)
    before = F.when(F.col("previous_hash").isNotNull(), F.concat_ws("|", F.col("previous_hash"), s))
    d = d.withColumns({"dedup_key": F.when(F.col("early").isNull(), key), "previous_key": F.when(F.col("early").isNull(), before)})
    # The keys are read apart from the rows, and parsing them twice costs more than a table.
    d = fixed_window(written(d, "parsed"), "dedup_key", settings.dedup_ttl, seen, "previous_key" if settings.previous_salt else None)
    return d.withColumn("outcome", F.coalesce("early", F.when(F.col("is_first"), "counted").otherwise("duplicate"))).drop("early", "is_first", "allowed", "previous_key")


def stored(outcomes: DataFrame, settings: Settings, as_of: int, seen: DataFrame | None = None) -> DataFrame:
    """The store of live keys after ``ingested``, whose rows say which of them set their key."""
    return live_keys(outcomes.select("dedup_key", "t", "is_seed"), "dedup_key", settings.dedup_ttl, as_of, seen)


def ledger(outcomes: DataFrame) -> DataFrame:
    """Two rows for each beacon in the stored columns: ``received`` and its terminal outcome. Ids that are none are ``unknown``."""
    return ledger_rows(outcomes, F.col("campaign_id"), F.lit("received"), F.col("outcome"))


def ledger_rows(rows: DataFrame, campaign, *outcomes) -> DataFrame:
    """A row of ``schemas.LEDGER`` for each of ``outcomes`` that is not null. Needs ``t``."""
    campaign = x.valid_or(F.coalesce(campaign, F.lit("")), x.ID, "unknown")
    ts = x.at_second(F.col("t")).alias("ts")
    d = rows.select(ts, F.explode(F.filter(F.array(*outcomes), lambda o: o.isNotNull())).alias("outcome"), campaign.alias("campaign_id"))
    return d.withColumn("_sample_interval", F.lit(1).cast("bigint"))


def alerts(failures: DataFrame) -> DataFrame:
    """Ledger rows of failed side writes and jobs: ``t``, ``kind`` (without its prefix) and ``campaign_id``."""
    return ledger_rows(failures, F.col("campaign_id"), F.concat(F.lit("alert_"), F.col("kind")))


def impression_events(outcomes: DataFrame) -> DataFrame:
    """Counted impressions in the stored columns."""
    ts = x.at_second(F.col("t")).alias("ts")
    return outcomes.where("outcome = 'counted'").select(ts, *EVENT_NAMES, F.lit(1).cast("bigint").alias("_sample_interval"))


def store_key(roku_creative, creative) -> Column:
    return F.when(x.text(roku_creative) != "", F.concat(F.lit("roku-creative:"), roku_creative)).otherwise(creative)


def recent_impressions(outcomes: DataFrame) -> DataFrame:
    """What call matching sees: counted impressions, with device fields only where they may be used. The connecting
    address is never one of them."""
    edge = "cf" in outcomes.columns
    ua = F.col("platform") == "ua"
    return outcomes.where("outcome = 'counted'").select(
        store_key(F.col("roku_creative_id"), F.col("creative_id")).alias("store_key"),
        F.col("t").alias("ts"),
        "seq",
        F.col("device_ip").alias("ip"),
        F.when(ua, F.col("ad_id")).otherwise("").alias("rida"),
        F.when(ua, F.col("hh_id")).otherwise("").alias("hh_id"),
        (x.text(F.col("cf.region")) if edge else F.lit("")).alias("region"),
        (x.text(F.col("cf.city")) if edge else F.lit("")).alias("city"),
        F.lit("").alias("postal"),
        "lmt",
    )


#: Names of the edge's fields as stored, by their names in a beacon.
EDGE = {"country": "country", "region": "region", "regionCode": "region_code", "city": "city", "postalCode": "postal_code", "metroCode": "metro_code", "latitude": "latitude", "longitude": "longitude", "timezone": "timezone", "asn": "asn", "asOrganization": "as_org", "colo": "colo"}
ROKU_NAMES = ("roku_advertiser_id", "roku_campaign_id", "roku_creative_id", "roku_creative_id_encoded", "roku_postal_code", "roku_cachebuster")


def raw_rows(outcomes: DataFrame) -> DataFrame:
    """Counted and repeated beacons as stored raw, with what was sent and seen of the connection; fields of the one
    platform are null on the other. ``dt``, ``h`` and ``hh`` are their folders."""
    at = x.at_second(F.col("t"))
    shard = F.when(F.col("ifa_hash") == "anon", "anon").otherwise(F.substring("ifa_hash", 1, 4))
    names = ("campaign_id", "creative_id", "advertiser_id", "app_id", "country", "dma", "ifa_hash", "ifa_present", "ifa_type", "platform")
    seen = [F.col(n) if n in outcomes.columns else F.lit("").alias(n) for n in ("connecting_ip", "user_agent", "query")]
    edge = [F.struct(*[F.col(f"cf.{a}").alias(b) for a, b in EDGE.items()]).alias("edge")] if "cf" in outcomes.columns else []
    return outcomes.where(F.col("outcome").isin("counted", "duplicate")).select(
        "seq",
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
        *names,
        *[F.when(F.col("platform") == "roku", F.col(n)).alias(n) for n in ROKU_NAMES],
        "outcome",
        F.col("sent_device_ip").alias("device_ip"),
        *seen,
        *edge,
        F.date_format(at, "yyyy-MM-dd").alias("dt"),
        shard.alias("h"),
        F.date_format(at, "HH").alias("hh"),
    )
