"""Registered queries by the operator's letter and number, and the same in SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from tallymark.config import Settings
from tallymark.functions import expressions as x
from tallymark.operators import attribution, beacons, dedup, erase, health, payloads, ratelimit, reports
from tallymark.plans import domain
from tallymark.sources import io

AS_OF = datetime(2024, 1, 31)
DAY = "2024-01-15"
TTL = 86_400


def _match(s, d, limit=10):
    calls = attribution.caller_states(domain.calls(s, d), domain.area_codes(s))
    return attribution.matched(calls, domain.recent(s, d), Settings(max_candidates=limit))


def _match_columns(df):
    return df.select("callId", "candidates", F.col("best.imp_seq").alias("best_seq"), "confidence", "gate", "device_ids")


def _payload(platform):
    def run(s, d):
        p = payloads.payload(_match(s, d, 2), platform, Settings(event_group_id="group1"))
        e = F.col("event")
        user = ("client_ip_address", "aRI", "st") if platform == "roku" else ("client_ip_address", "ifa", "household_id", "st")
        custom = ("match_candidates", "match_type", "match_gate", "match_confidence", "call_duration_seconds", "value", "currency")
        return p.select(e["event_id"].alias("event_id"), e["opt_out"].alias("opt_out"), e["user_data"]["ph"].alias("ph"), *[e["user_data"][n].alias(n) for n in user], *[e["custom_data"][n].alias(n) for n in custom])

    return run


def _values(s, d, values):
    v = F.array(*map(F.lit, values))
    return domain.events(s, d).select("event_id", F.element_at(v, (F.col("event_id") % len(values) + 1).cast("int")).alias("v"))


IPS = ("10.0.0.1", "0.0.0.0", "256.1.1.1", "1.2.3", "01.2.3.4", "255.255.255.255", "1.2.3.4.5", "[[[DEVICE_IP]]]", "", "1.2.3.4\n")
AD_IDS = ("abc-123", "00000000-0000-0000-0000-000000000000", "FFFF-FFFF", "ffffffff", "[IFA]", "${IDA}", "NULL", "n/a", "-", "", "a", "aab")
LIMITS = ("1", " Yes ", "true", "0", "no", "", "[LMT]", "2", "FALSE", "n")
DATES = ("2024-01-05", "2024-01-05T10:00:00Z", "2024-02-30", "soon", "", "2024-01-05 10:30:00")
PHONES = ("+1 (415) 555-0142", "0044 20 7946 0958", "14155550142", "212.555.0199", "12", "1999", "", "+1-312-555-0100", "00012145550123")


def _rotation(s, d):
    i = domain.impressions(s, d).withColumn("after", F.col("t") >= 1705276800)
    return dedup.rotating(i, "user_id", TTL * 3).select("seq", "is_first")


def _claims(s, d):
    c = domain.calls(s, d).withColumn("sent", F.col("k") < 50).withColumn("callId", F.concat(F.lit("c"), (F.col("seq") % 40).cast("string")))
    return attribution.claimed_calls(c).select("seq", "is_claimed")


def _ledger_closure(s, d):
    return reports_closure(domain.ledger(s, d))


def reports_closure(ledger):
    """Beacons received, and their terminal outcomes: the two must be equal."""
    beacon = ~F.col("outcome").startswith("call_") & (F.col("outcome") != "received")
    return ledger.groupBy("campaign_id").agg(F.count_if(F.col("outcome") == "received").alias("received"), F.count_if(beacon).alias("terminal"))


def _beacons(s, d):
    # The table is one row group, which one task would parse.
    b = beacons.parsed(domain.beacons(s, d).repartition(s.sparkContext.defaultParallelism), domain.campaigns(s))
    return b.select("seq", "reason", "platform", "ifa_present", "ifa_hash", "lmt", "country", "dma", "creative_id")


ROTATED = 1705276800
LIMITED = Settings(rate_limit=1, ip_salt="pepper")


def _ingested(s, d):
    return beacons.ingested(domain.beacons(s, d), domain.campaigns(s), LIMITED)


def _rotated(s, d):
    """A batch under the old salt, and one under the new that knows the old one's store."""
    b, c = domain.beacons(s, d), domain.campaigns(s)
    first = beacons.ingested(b.where(F.col("t") < ROTATED), c, LIMITED)
    store = beacons.stored(first, LIMITED, ROTATED)
    after = replace(LIMITED, hash_salt="new", previous_salt="salt")
    second = beacons.ingested(b.where(F.col("t") >= ROTATED), c, after, store)
    return first.select("seq", "outcome").union(second.select("seq", "outcome"))


def _concluded(s, d):
    settings = Settings(call_key=domain.CALL_KEY, call_rate_limit=1, event_group_id="group1")
    return attribution.concluded(domain.requests(s, d), domain.numbers(s), domain.recent(s, d), domain.area_codes(s), settings)


def _calls(s, d):
    return _concluded(s, d).select("seq", "outcome", F.col("best.imp_seq").alias("best_seq"), "candidates", "gate", "caller_state")


def _whole_ledger(s, d):
    return beacons.ledger(_ingested(s, d)).unionByName(attribution.call_ledger(_concluded(s, d))).unionByName(beacons.alerts(domain.failures(s, d)))


def _ledger_summary(s, d):
    return reports.ledger_summary(_whole_ledger(s, d), AS_OF, 24 * 30)


def _numeric(s, d):
    text = domain.events(s, d).groupBy("event_type").agg(F.count("*").cast("string").alias("n"), F.when(F.col("event_type") != "error", F.sum("k").cast("string")).alias("k"))
    return io.numeric(text, {"event_type": "String", "n": "UInt64", "k": "Nullable(UInt64)"})


def _erasure_result(requested):
    def run(s, d):
        campaigns = domain.impressions(s, d).select("campaign_id").distinct()
        return erase.expected_result(_raw(s, d), _keys(s, d), campaigns, [_subject()], "2024-01-03", "2024-01-25", requested, 60)

    return run


def _raw(s, d):
    i = domain.impressions(s, d)
    at = F.date_format("ts", "yyyy-MM-dd")
    return i.select("ifa_hash", at.alias("dt"), F.when(F.col("ifa_hash") == "anon", "anon").otherwise(F.substring("ifa_hash", 1, 4)).alias("h"))


def _subject():
    import hashlib

    return hashlib.sha256(b"salt|17").hexdigest()


def _keys(s, d):
    i = domain.impressions(s, d).where("ifa_present = '1'")
    key = F.concat_ws("|", "ifa_hash", "campaign_id", "creative_id")
    return dedup.live_keys(i.select(key.alias("key"), "t", "seq"), "key", TTL, 1706659200)


def _erased(s, d):
    left = erase.erase_keys(_keys(s, d), "key", [_subject()], [f"camp_{i}" for i in range(5)])
    return left.agg(F.count("*").alias("kept"))


def _marker(s, d):
    """A marker for each campaign: of its last day, and of the hour of its last impression."""
    m = domain.impressions(s, d).groupBy("campaign_id").agg(F.max("ts").alias("last"), F.count("*").alias("rows"))
    return m.select("campaign_id", F.date_format("last", "yyyy-MM-dd").alias("date"), "rows", F.date_trunc("hour", "last").cast("timestamp_ntz").alias("ts"))


def _freshness(s, d):
    return health.export_freshness(_marker(s, d), AS_OF, 4)


def _overall(s, d):
    one = health.export_freshness(_marker(s, d).where("campaign_id = 'camp_1'"), AS_OF)
    return health.overall(health.ledger_health(_ledger_summary(s, d)), one)


def _qualified(s, d):
    c = domain.calls(s, d).withColumn("limit", F.when(F.col("k") < 30, 100.0).when(F.col("k") < 60, 0.0))
    return c.groupBy(attribution.qualified(F.col("duration"), F.col("limit")).alias("qualified")).agg(F.count("*").alias("calls"))


def _tags(s, d):
    """Signatures of tags, and the verdicts on them with several expiries."""
    e, k = domain.events(s, d), F.col("k")
    parts = F.lit("adv"), F.concat(F.lit("camp_"), (F.col("event_id") % 5).cast("string")), F.lit("cre")
    exp = F.when(k < 20, "1767225600").when(k < 40, "01767225600.0").when(k < 50, "").when(k < 60, "soon").when(k < 70, "1700000000").otherwise("1767225601")
    sig = x.hmac_sha256("signing-key", F.concat_ws("|", *parts, F.lit("1767225600")))
    given = F.when(k % 10 == 0, "").when(k % 10 == 1, F.upper(sig)).otherwise(sig)
    return e.select("event_id", sig.alias("sig"), x.tag_verdict("signing-key", *parts, exp, given, F.col("t")).alias("verdict"))


#: Expiries of tags as they are written, and the number that a signature covers; none is no number.
EXPIRIES = (
    ("1767225600d", None), ("1767225600f", None), ("1767225600.5", "1767225600.5"), ("0x69554200", "1767195136"), ("1.7672256e9", "1767225600"), ("+1767225600", "1767225600"), (" 1767225600 ", "1767225600"),
    ("1_767_225_600", None), ("Infinity", None), ("1e400", None), (".5e10", "5000000000"), ("1767225600.", "1767225600"), ("1e21", "1e+21"), ("0b110", "6"), ("0O15125241000", "1767195136"), ("1767225600L", None), ("0x", None),
)
#: What stands before and behind a request's stamp, or in its place, and whether it is a number near the time.
STAMPS = (("", "", True), ("", "d", False), ("", "f", False), ("", ".25", True), ("+", "", True), (" ", " ", True), ("", "e0", True), ("-", "", False), ("0x", "", False), ("", "9", False), ("", "_", False))


def _number_forms(s, d):
    """Each event as a tag with an expiry in one of the forms, signed for the number that it stands for."""
    e, i = domain.events(s, d), (F.col("event_id") % len(EXPIRIES) + 1).cast("int")
    form, covered = (F.element_at(F.array(*[F.lit(v[n]) for v in EXPIRIES]), i) for n in (0, 1))
    ids = F.concat(F.lit("adv_"), F.col("user_id").cast("string")), F.concat(F.lit("camp_"), (F.col("event_id") % 5).cast("string")), F.lit("cre")
    sig = x.hmac_sha256("signing-key", F.concat_ws("|", *ids, F.coalesce(covered, form)))
    return e.select("event_id", sig.alias("sig"), x.tag_verdict("signing-key", *ids, form, sig, F.col("t")).alias("verdict"))


def _stamped(s, d):
    """Each event as a request whose stamp, in one of the forms, is a given number of seconds off."""
    e, i = domain.events(s, d), (F.col("event_id") % len(STAMPS) + 1).cast("int")
    before, behind = (F.element_at(F.array(*[F.lit(v[n]) for v in STAMPS]), i) for n in (0, 1))
    body = F.concat(F.lit('{"callId":"c'), F.col("event_id").cast("string"), F.lit('"}')).cast("binary")
    stamp = F.concat(before, (F.col("t") + F.col("k") * 10).cast("string"), behind)
    sig = x.hmac_sha256("call-key", F.concat(stamp.cast("binary"), F.lit(bytearray(b".")), body))
    given = F.when(F.col("k") % 7 == 0, "00").when(F.col("k") % 7 == 1, F.upper(sig)).otherwise(sig)
    return e.select("event_id", attribution.signed("call-key", stamp, body, given, F.col("t"), 300).alias("signed"))


def _one_key(s, d):
    """All impressions under one key: its seconds are dealt out over blocks of time."""
    i = domain.impressions(s, d).withColumn("key", F.lit("all"))
    return dedup.fixed_window(i, "key", 21_600).select("seq", "is_first")


QUERIES = {
    "a1_impressions_by_campaign": lambda s, d: reports.by_campaign(domain.impressions(s, d), AS_OF),
    "a2_impressions_by_country": lambda s, d: reports.by_country(domain.impressions(s, d), AS_OF, 48),
    "a3_hourly_trend": lambda s, d: reports.hourly_trend(domain.impressions(s, d), AS_OF, 72),
    "a4_reach_exact": lambda s, d: reports.reach(domain.impressions(s, d), AS_OF),
    "a4_reach_of_campaign": lambda s, d: reports.reach(domain.impressions(s, d), AS_OF, "camp_3", 14).union(reports.reach(domain.impressions(s, d), AS_OF, "camp_9")),
    "a4_reach_estimate": lambda s, d: reports.reach(domain.impressions(s, d), AS_OF, exact=False),
    "a5_recon_summary": lambda s, d: reports.ledger_summary(domain.ledger(s, d), AS_OF, 24 * 30),
    "a6_daily_rollup": lambda s, d: reports.daily_rollup(domain.impressions(s, d), DAY),
    "a9_native_ids": lambda s, d: reports.native_ids(domain.impressions(s, d), AS_OF),
    "a10_frequency": lambda s, d: reports.frequency(domain.impressions(s, d), AS_OF),
    "a12_volume_alerts": lambda s, d: reports.volume_alerts(domain.impressions(s, d)),
    "d1_fixed_window": lambda s, d: dedup.fixed_window(domain.impressions(s, d).withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type")), "key", TTL).select("seq", "is_first"),
    "d1_one_key": _one_key,
    "d2_rotation": _rotation,
    "d4_live_keys": _keys,
    "d5_call_claims": _claims,
    "d6_erase_prefix": _erased,
    "d10_ledger_closure": _ledger_closure,
    "e1_erase_preview": lambda s, d: erase.preview(_raw(s, d), _subject(), "2024-01-03", "2024-01-25"),
    "f1_phones": lambda s, d: _values(s, d, PHONES).select("event_id", x.e164(F.col("v")).alias("e164"), x.phone_hash(F.col("v")).alias("hash"), x.area_code(F.col("v")).alias("area_code")),
    "f4_caller_state": lambda s, d: attribution.caller_states(domain.calls(s, d), domain.area_codes(s)).groupBy("caller_state").agg(F.count("*").alias("calls")),
    "f13_payload_roku": _payload("roku"),
    "f14_payload_ua": _payload("ua"),
    "h1_ledger_health": lambda s, d: health.ledger_health(_ledger_summary(s, d)),
    "h2_export_freshness": _freshness,
    "h3_overall": _overall,
    "j4_match_best": lambda s, d: _match_columns(_match(s, d)),
    "j4_match_gated": lambda s, d: _match_columns(_match(s, d, 2)),
    "o3_page": lambda s, d: reports.page(reports.daily_rollup(domain.impressions(s, d), DAY), ["hour", "campaign_id", "creative_id", "country", "app_id", "ifa_present", "advertiser_id", "dma"], 5, 20).select("hour", "campaign_id", "creative_id", "impressions"),
    "p1_beacon_fields": _beacons,
    "p5_tag_signatures": _tags,
    "p5_number_forms": _number_forms,
    "p19_stamps": _stamped,
    "a8_candidates": lambda s, d: attribution.candidate_counts(domain.calls(s, d).withColumn("caller_state", F.lit("")), domain.recent(s, d), Settings(match_window_minutes=180)),
    "p12_usable_ipv4": lambda s, d: _values(s, d, IPS).select("event_id", x.usable_ipv4(F.col("v")).alias("usable")),
    "p13_usable_ad_id": lambda s, d: _values(s, d, AD_IDS).select("event_id", x.usable_ad_id(F.col("v")).alias("usable")),
    "p14_limits": lambda s, d: _values(s, d, LIMITS).select("event_id", x.limits_tracking(F.col("v"), F.col("event_id") % 3 == 0).alias("lmt")),
    "p15_identity": lambda s, d: domain.events(s, d).select("event_id", x.hashed("salt", F.col("user_id").cast("string")).alias("hash")),
    "p21_qualified": _qualified,
    "s5_listing": lambda s, d: reports.listing(_keys(s, d), "key", "0", 20),
    "w1_rate_limit": lambda s, d: ratelimit.rate_limited(domain.events(s, d).withColumn("key", F.col("user_id") % 7), "key", 3, 3600).select("seq", "allowed"),
    "d3_outcomes": lambda s, d: _ingested(s, d).select("seq", "outcome"),
    "d3_rotation": _rotated,
    "c1_call_outcomes": _calls,
    "s9_ledger": lambda s, d: _whole_ledger(s, d).groupBy("outcome", "campaign_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")),
    "s7_numeric": _numeric,
    "p8_boundaries": lambda s, d: _values(s, d, DATES).select("event_id", x.boundary(F.col("v"), False).alias("starts_at"), x.boundary(F.col("v"), True).alias("ends_at")),
    "p23_recent": lambda s, d: beacons.recent_impressions(_ingested(s, d)).select("store_key", "ts", "seq", "ip", "rida", "hh_id", "lmt"),
    "p24_raw_rows": lambda s, d: beacons.raw_rows(_ingested(s, d)).select("seq", "ts", "outcome", "campaign_id", "device_ip", "connecting_ip", "ifa_present", "roku_creative_id", "dt", "h", "hh"),
    "f11_ceiling": lambda s, d: attribution.matched(attribution.caller_states(domain.calls(s, d), domain.area_codes(s)), domain.recent(s, d), Settings(candidate_ceiling=2)).select("callId", "candidates", "matched", F.col("best.imp_seq").alias("best_seq"), "confidence", "gate"),
    "a11_store_size": lambda s, d: dedup.store_size(_keys(s, d)),
    "a12_counted_alerts": lambda s, d: reports.counted_alerts(_whole_ledger(s, d)).select("day", "received", "counted", "is_alert"),
    "e4_erasure_result": _erasure_result([]),
    "e4_partial_erasure": _erasure_result(["camp_1", "camp_2"]),
}
