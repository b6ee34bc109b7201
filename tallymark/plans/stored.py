"""Registered queries over what is written and read back, over arguments and forms of input, and their SQL."""

from __future__ import annotations

import math
import uuid
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import config
from tallymark.config import Settings
from tallymark.functions import expressions as x
from tallymark.operators import attribution, beacons, dedup, erase, health, payloads, ratelimit, reports
from tallymark.plans import domain, oracles, queries
from tallymark.schemas import EXPORT_KEYS
from tallymark.sources import io
from tallymark.sources.tables import shared_folder


def folder(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def pick(values, event_id):
    """The value of a list whose turn it is."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (event_id % len(values) + 1).cast("int"))


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


META = (("event_type", "String"), ("grp", "UInt8"), ("n", "UInt64"), ("k", "Nullable(UInt64)"), ("share", "Nullable(Float64)"))


def documents(s, d) -> DataFrame:
    """A result document for each kind of event, with numbers as text and absent ones among them."""
    g = domain.events(s, d).groupBy("event_type", (F.col("user_id") % 5).cast("string").alias("grp"))
    g = g.agg(F.count("*").cast("string").alias("n"), F.when(F.col("event_type") != "error", F.sum("k").cast("string")).alias("k"), F.when(F.col("event_type") == "view", "0.25").when(F.col("event_type") == "click", "n/a").alias("share"))
    meta = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("type")) for n, k in META])
    docs = g.groupBy("event_type").agg(F.collect_list(F.struct(*[n for n, _ in META])).alias("data"))
    return docs.select(F.to_json(F.struct(meta.alias("meta"), "data")).alias("value"))


def sketched(s, d) -> DataFrame:
    """Reach over some days, and whether the estimate from two halves' stored sketches is within its bound."""
    i, first, last = domain.impressions(s, d), "2024-01-05", "2024-01-20"
    halves = [reports.reach_sketches(i.where(F.col("seq") % 2 == n)) for n in (0, 1)]
    estimate = reports.reach_between(reports.merged_sketches(*halves), first, last).withColumnRenamed("reach", "estimate")
    span = i.where((F.col("ifa_present") == "1") & F.col("ts").cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    exact = span.groupBy("campaign_id").agg(F.countDistinct("ifa_hash").alias("reach"))
    near = F.abs(F.col("estimate") - F.col("reach")) <= reports.sketch_bound() * F.col("reach")
    return exact.join(estimate, "campaign_id").select("campaign_id", "reach", near.alias("within_bound"))


def late(s, d) -> DataFrame:
    """A stored roll-up to which a tenth of the impressions came late."""
    i, path = domain.impressions(s, d), folder(s, "rollup")
    io.write_rollup(i.where(F.col("seq") % 10 != 3), path)
    io.add_to_rollup(s, i.where(F.col("seq") % 10 == 3), path)
    r = s.read.schema(reports.rollup(i).schema).parquet(path)
    return r.groupBy("dt", "campaign_id").agg(F.count("*").alias("rows"), F.sum("impressions").alias("impressions"))


PEOPLE, SUBJECT = 20, 7


def people(s, d) -> DataFrame:
    """Impressions of a few devices, so that each day has a folder for each of them."""
    subject = F.sha2(F.concat(F.lit("salt|"), (F.col("user_id") % PEOPLE).cast("string")).cast("binary"), 256)
    return domain.impressions(s, d).where("ifa_present = '1'").withColumn("ifa_hash", subject)


def erased(s, d) -> tuple[str, DataFrame]:
    """The raw table after an erasure, and the erasure's answer."""
    p, path = people(s, d), folder(s, "raw")
    io.write_raw(p.select("seq", "ifa_hash", F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.substring("ifa_hash", 1, 4).alias("h"), F.lit("00").alias("hh")), path)
    key = F.concat_ws("|", "ifa_hash", "campaign_id", "creative_id")
    keys = dedup.live_keys(p.select(key.alias("key"), "t", "seq"), "key", queries.TTL, 1706659200)
    import hashlib

    subject = hashlib.sha256(f"salt|{SUBJECT}".encode()).hexdigest()
    _, row = erase.erase_subject(s, path, keys, p.select("campaign_id").distinct(), [subject], "2024-01-03", "2024-01-25")
    return path, row


#: Bodies of calls, and what is wrong with them; times stand for the second of arrival and one before or behind it.
BODIES = (
    ('{"callId":"c","dnis":"+18005550100","ani":"4155550142","startTime":@,"durationSeconds":5}', None),
    ("not json", "bad_json"), ('"text"', "bad_json"), ("", "bad_json"), ("[]", "missing_fields"),
    ('{"callId":"c","ani":"4155550142","startTime":@,"durationSeconds":5}', "missing_fields"),
    ('{"callId":"c","dnis":18005550100,"ani":"4155550142","startTime":@,"durationSeconds":5}', "missing_fields"),
    ('{"callId":"","dnis":"+18005550100","ani":"4155550142","startTime":@,"durationSeconds":5}', "missing_fields"),
    ('{"callId":"' + "c" * 129 + '","dnis":"+18005550100","ani":"4155550142","startTime":@,"durationSeconds":5}', "bad_fields"),
    ('{"callId":"' + "c" * 128 + '","dnis":"+18005550100","ani":"4155550142","startTime":@,"durationSeconds":0}', None),
    ('{"callId":"c\\u0001","dnis":"+18005550100","ani":"4155550142","startTime":@,"durationSeconds":5}', "bad_fields"),
    ('{"callId":"c","dnis":"+18005550100","ani":"4155550142","startTime":@,"durationSeconds":"5"}', "bad_fields"),
    ('{"callId":"c","dnis":"+18005550100","ani":"4155550142","startTime":@,"durationSeconds":-1}', "bad_fields"),
    ('{"callId":"c","dnis":"+18005550100","ani":"4155550142","startTime":@301,"durationSeconds":5}', "bad_fields"),
    ('{"callId":"c","dnis":"+18005550100","ani":"4155550142","startTime":@300,"durationSeconds":5}', None),
    ('{"callId":"c","dnis":"+18005550100","ani":"4155550142","startTime":@-86401,"durationSeconds":5}', "bad_fields"),
    ('{"callId":"c","dnis":"+18005550100","ani":"4155550142","startTime":@-86400,"durationSeconds":5}', None),
    ('{"callId":"c","dnis":"+18005550100","ani":"4155550142","startTime":@,"durationSeconds":5,"saleValue":"12"}', "bad_fields"),
    ('{"callId":"c","dnis":"+18005550100","ani":"4155550142","startTime":@,"durationSeconds":5.5,"saleValue":12.5}', None),
    ('{"callId":"c","dnis":"+18005550100","ani":"415555014","startTime":@,"durationSeconds":5}', "bad_fields"),
)


def reasons(s, d) -> DataFrame:
    e = domain.events(s, d)
    body = pick([b for b, _ in BODIES], F.col("event_id"))
    for off in (301, 300, -86401, -86400):
        body = F.replace(body, F.lit(f"@{off}"), (F.col("t") + off).cast("string"))
    body = F.replace(body, F.lit("@"), F.col("t").cast("string"))
    return e.select("event_id", attribution.call_reason(body, F.col("t")).alias("reason"))


def native_stores(s, d) -> DataFrame:
    """Beacons of which some name the other platform's creative."""
    more = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("&roku_creative_id=rr_"), (F.col("user_id") % 3).cast("string"))).otherwise("")
    b = domain.beacons(s, d).withColumn("query", F.concat("query", more))
    return beacons.recent_impressions(beacons.ingested(b, domain.campaigns(s), queries.LIMITED)).select("store_key", "ts", "seq")


def live_calls(s, d) -> DataFrame:
    """Calls of an installation that sends."""
    settings = Settings(call_key=domain.CALL_KEY, call_rate_limit=1, event_group_id="group1", live=True, send_key="send-key")
    out = attribution.concluded(domain.requests(s, d), domain.numbers(s), domain.recent(s, d), domain.area_codes(s), settings, "https://example.test")
    return out.select("seq", "outcome", "candidates")


#: Values as they are written, and as they are read with ``+`` kept.
ENCODED = (("a+b/c=", "a+b/c="), ("a%2Bb%3D", "a+b="), ("%zz", ""), ("%20x%20", "x"), ("", ""), ("%C3%A9", "é"), ("a%2", ""))


def raw_values(s, d) -> DataFrame:
    e = domain.events(s, d)
    query = F.concat(F.lit("a=1&v2=no&v="), pick([v for v, _ in ENCODED], F.col("event_id")), F.lit("&v=second"))
    return e.select("event_id", x.raw_param(query, "v").alias("value"), x.raw_param(query, "none").alias("absent"))


def signed_tags(s, d) -> DataFrame:
    """Generated tags, their own verdict, and that of one whose campaign was exchanged."""
    e, u = domain.events(s, d), F.col("user_id")
    ids = F.concat(F.lit("adv_"), (u % 3).cast("string")), F.concat(F.lit("camp_"), (F.col("event_id") % 5).cast("string")), F.lit("cre_1")
    exp = F.lit(1_767_225_600)
    tag = F.when(u % 2 == 0, x.signed_tag("signing-key", *ids, exp, "roku")).otherwise(x.signed_tag("signing-key", *ids, exp, "ua"))
    d = e.select("event_id", "t", tag.alias("tag")).withColumn("forged", F.regexp_replace("tag", "campaign_id=camp_", "campaign_id=other_"))
    names = ("advertiser_id", "campaign_id", "creative_id", "exp", "sig")
    verdict = lambda c: x.tag_verdict("signing-key", *[x.param(F.col(c), n) for n in names], F.col("t"))
    return d.select("event_id", "tag", verdict("tag").alias("verdict"), verdict("forged").alias("forged_verdict"), x.param(F.col("tag"), "pf").alias("platform"))


def stored_impressions(s, d) -> DataFrame:
    path = folder(s, "impressions")
    io.append_daily(beacons.impression_events(queries._ingested(s, d)), path)
    return io.read_events(s, path).groupBy("campaign_id", "platform").agg(F.sum("_sample_interval").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def exported(s, d) -> tuple[DataFrame, DataFrame]:
    """The rows and the marker of a nightly export."""
    i, path = domain.impressions(s, d), folder(s, "export")
    io.nightly_export(s, i, path, datetime(2024, 1, 16, 2))
    return s.read.schema(reports.daily_rollup(i, queries.DAY).schema).json(f"{path}/dt={queries.DAY}"), io.read_marker(s, path)


def sent_lines(s, d) -> DataFrame:
    path = folder(s, "payloads")
    io.write_payloads(payloads.payload(queries._match(s, d, 2), "ua", Settings(event_group_id="group1")), path)
    of = lambda p: F.get_json_object("value", p)
    lines = s.read.text(path)
    return lines.select(of("$.events[0].event_id").alias("event_id"), of("$.event_group_id").alias("event_group_id"), of("$.events[0].user_data.ph").alias("ph"), of("$.events[0].user_data.household_id").alias("household_id"), of("$.events[0].custom_data.match_gate").alias("gate"))


def status(s, d) -> DataFrame:
    path = folder(s, "status")
    row = health.ledger_health(reports.ledger_summary(domain.ledger(s, d), queries.AS_OF, 24 * 30))
    io.write_status(row.select("received", "accounted", "call_attempts", "healthy"), path, "health")
    return s.read.schema("received bigint, accounted bigint, call_attempts bigint, healthy boolean").json(f"{path}/_status/health.json")


#: Days that reports are asked for, and those that they give.
DAYS = ((0, 7), (math.nan, 7), (7.9, 7), (1000, 90), (-3, 1), (None, 7))
#: Limits as a setting says them, and those that hold; the fallback is 2.
LIMITS = ((" 3 ", 3), ("", 2), (None, 2), ("2.9", 2), ("-1", 2), ("many", 2), ("1e0", 1), ("Infinity", 2))


def arguments(s, d) -> DataFrame:
    i = domain.impressions(s, d)
    return all_of([reports.by_campaign(i, queries.AS_OF, n).withColumn("asked", F.lit(k)) for k, (n, _) in enumerate(DAYS)])


def limits(s, d) -> DataFrame:
    """How many hits are allowed under each limit; the keys that count as none refuse all signatures."""
    e = domain.events(s, d).withColumn("key", F.col("user_id") % 7)
    return all_of([ratelimit.rate_limited(e, "key", config.config_int(v, 2, 1), 3600).agg(F.count_if("allowed").alias("allowed")).withColumn("asked", F.lit(k)) for k, (v, _) in enumerate(LIMITS)])


KEYS = ("your-analytics-read-token", "  ", "2" * 64, " call-key ", "call-key")


def placeholders(s, d) -> DataFrame:
    e = domain.events(s, d)
    body = F.col("event_id").cast("string").cast("binary")
    sig = x.hmac_sha256("call-key", F.concat(F.col("t").cast("string").cast("binary"), F.lit(bytearray(b".")), body))
    ok = [F.count_if(attribution.signed(k, F.col("t").cast("string"), body, sig, F.col("t"), 300)).alias(f"key_{i}") for i, k in enumerate(KEYS)]
    return e.agg(*ok, F.count("*").alias("events"))


def stored_rotation(s, d) -> DataFrame:
    """``d3_rotation`` with the store of the first batch in buckets."""
    from tallymark.operators.store import KeyStore

    b, c = domain.beacons(s, d), domain.campaigns(s)
    first = beacons.ingested(b.where(F.col("t") < queries.ROTATED), c, queries.LIMITED)
    store = KeyStore(s, folder(s, "store"), int(s.conf.get("spark.sql.shuffle.partitions"))).write(beacons.stored(first, queries.LIMITED, queries.ROTATED), 0)
    after = replace(queries.LIMITED, hash_salt="new", previous_salt="salt")
    second = beacons.ingested(b.where(F.col("t") >= queries.ROTATED), c, after, store)
    return first.select("seq", "outcome").union(second.select("seq", "outcome"))


QUERIES = {
    "s7_documents": lambda s, d: io.results(documents(s, d)),
    "a4_reach_sketches": sketched,
    "a6_late_rollup": late,
    "e4_erase_subject": lambda s, d: erased(s, d)[1],
    "e1_rows_left": lambda s, d: erase.read_raw(s, erased(s, d)[0]).groupBy("dt").agg(F.count("*").alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")),
    "p18_call_reasons": reasons,
    "p22_native_stores": native_stores,
    "c2_live_calls": live_calls,
    "p2_raw_values": raw_values,
    "p30_signed_tags": signed_tags,
    "s8_stored_impressions": stored_impressions,
    "s11_exported": lambda s, d: exported(s, d)[0],
    "s13_marker": lambda s, d: exported(s, d)[1].select("date", "rows", "key", "partial"),
    "s14_payload_lines": sent_lines,
    "s15_status": status,
    "p27_arguments": arguments,
    "p28_limits": limits,
    "p6_placeholder_keys": placeholders,
    "j5_stored_rotation": stored_rotation,
}


def text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


E, IMP = oracles.E, oracles.IMP
PEOPLE_SQL = f"{IMP}, person AS (SELECT *, sha256('salt|' || user_id % {PEOPLE}) AS person, strftime(ts, '%Y-%m-%d') AS dt FROM imp WHERE ifa_present = '1'), subject AS (SELECT sha256('salt|{SUBJECT}') AS h)"
LIVE_CALLS = oracles.CONCLUDED.replace("user_id % 2 = 0 AND k % 2 = 0 AS sent", "k % 2 = 0 AS sent").replace(" WHEN user_id % 2 = 1 THEN 'call_skipped'", "").replace("'call_dry_run'", "'call_fired'")
TAG = "'advertiser_id=adv_' || user_id % 3 || '&campaign_id=camp_' || event_id % 5 || '&creative_id=cre_1&exp=1767225600&sig=' || sig || CASE WHEN user_id % 2 = 0 THEN '&pf=roku&device_ip=[[[DEVICE_IP]]]&dma=[[[METRO_CODE]]]' ELSE '&pf=ua&ifa=[IFA]&lmt=[LMT]' END"

SQL = {
    "s7_documents": f"WITH {E} SELECT event_type, user_id % 5 AS grp, count(*) AS n, CASE WHEN event_type <> 'error' THEN sum(k)::BIGINT END AS k, CASE WHEN event_type = 'view' THEN 0.25::DOUBLE END AS share FROM e GROUP BY event_type, user_id % 5",
    "a4_reach_sketches": f"WITH {IMP} SELECT campaign_id, count(DISTINCT ifa_hash) AS reach, true AS within_bound FROM imp WHERE ifa_present = '1' AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1",
    "a6_late_rollup": f"""WITH {IMP}, r AS (SELECT date_trunc('hour', ts) AS hour, {", ".join(k for k in EXPORT_KEYS if k != "hour")}, sum(w) AS n FROM imp GROUP BY ALL)
SELECT strftime(hour, '%Y-%m-%d') AS dt, campaign_id, count(*) AS rows, sum(n)::BIGINT AS impressions FROM r GROUP BY 1, 2""",
    "e4_erase_subject": f"""WITH RECURSIVE {PEOPLE_SQL}, keyed AS (SELECT person || '|' || campaign_id || '|' || creative_id AS key, t, seq FROM person), {oracles.FIRST}, live AS (SELECT key FROM firsts GROUP BY key HAVING max(t) + 86400 > 1706659200),
shard AS (SELECT person = h AS mine FROM person, subject WHERE dt BETWEEN '2024-01-03' AND '2024-01-25' AND substr(person, 1, 4) = substr(h, 1, 4))
SELECT (SELECT count(*) FROM live, subject WHERE starts_with(key, h || '|')) AS dedup_deleted, count(*) AS raw_scanned, count(*) FILTER (mine) AS raw_deleted, false AS raw_truncated, 23::INT AS raw_days_scanned, 5::INT AS campaigns_scanned, true AS scope_complete, NULL::VARCHAR AS error FROM shard""",
    "e1_rows_left": f"WITH {PEOPLE_SQL} SELECT dt, count(*) AS rows, min(seq) AS first_seq, max(seq) AS last_seq FROM person, subject WHERE NOT (person = h AND dt BETWEEN '2024-01-03' AND '2024-01-25') GROUP BY dt",
    "p18_call_reasons": f"SELECT event_id, [{', '.join(text(r) for _, r in BODIES)}][event_id % {len(BODIES)} + 1] AS reason FROM events",
    "p22_native_stores": f"""WITH RECURSIVE {oracles.OUTCOMES}, {oracles.STORE}, {oracles.ENDED}
SELECT CASE WHEN platform = 'roku' AND user_id % 4 = 0 THEN 'roku-creative:rr_' || user_id % 3 ELSE creative_id END AS store_key, t AS ts, seq FROM ended WHERE outcome = 'counted'""",
    "c2_live_calls": f"WITH RECURSIVE {oracles.match(10)}, {LIVE_CALLS} SELECT c.seq, outcome, CASE WHEN goes_on THEN candidates ELSE 0 END AS candidates FROM concluded c JOIN g ON g.call_seq = c.seq",
    "p2_raw_values": f"SELECT event_id, [{', '.join(text(v) for _, v in ENCODED)}][event_id % {len(ENCODED)} + 1] AS value, '' AS absent FROM events",
    "p30_signed_tags": f"""WITH {E}, g AS (SELECT *, {oracles.signatures("signing-key", "'adv_' || user_id % 3 || '|camp_' || event_id % 5 || '|cre_1|1767225600'")} AS sig FROM e)
SELECT event_id, {TAG} AS tag, NULL::VARCHAR AS verdict, 'bad_signature' AS forged_verdict, CASE WHEN user_id % 2 = 0 THEN 'roku' ELSE 'ua' END AS platform FROM g""",
    "s8_stored_impressions": f"WITH RECURSIVE {oracles.OUTCOMES}, {oracles.STORE}, {oracles.ENDED} SELECT camp AS campaign_id, platform, count(*) AS n, TIMESTAMP '1970-01-01' + to_seconds(min(t)) AS first, TIMESTAMP '1970-01-01' + to_seconds(max(t)) AS last FROM ended WHERE outcome = 'counted' GROUP BY 1, 2",
    "s11_exported": f"WITH {IMP}, {oracles.ROLLUP} SELECT * FROM rollup",
    "s13_marker": f"WITH {IMP}, {oracles.ROLLUP} SELECT '2024-01-15' AS date, count(*) AS rows, 'dt=2024-01-15' AS key, false AS partial FROM rollup",
    "s14_payload_lines": f"""WITH {oracles.match(2)}
SELECT 'call_' || call_id || '_' || store AS event_id, 'group1' AS event_group_id, sha256('+1' || code || rest) AS ph, CASE WHEN gate = 'ok' AND NOT lmt AND platform = 'ua' THEN 'hh-' || user_id END AS household_id, gate FROM g""",
    "s15_status": f"WITH {oracles.LEDGER} SELECT received, accounted, call_attempts, healthy FROM ({oracles.HEALTH})",
    "p27_arguments": f"WITH {IMP} " + " UNION ALL ".join(f"SELECT campaign_id, sum(w)::BIGINT AS impressions, {k}::INT AS asked FROM imp WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL {n} DAY GROUP BY 1" for k, (_, n) in enumerate(DAYS)),
    "p28_limits": f"WITH {E}, r AS (SELECT row_number() OVER (PARTITION BY user_id % 7, t // 3600 ORDER BY t, seq) AS nth FROM e) " + " UNION ALL ".join(f"SELECT count(*) FILTER (nth <= {n}) AS allowed, {k}::INT AS asked FROM r" for k, (_, n) in enumerate(LIMITS)),
    "p6_placeholder_keys": "SELECT 0::BIGINT AS key_0, 0::BIGINT AS key_1, 0::BIGINT AS key_2, 0::BIGINT AS key_3, count(*) AS key_4, count(*) AS events FROM events",
    "j5_stored_rotation": oracles.SQL["d3_rotation"],
}
