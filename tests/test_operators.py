import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymark.config import Settings
from tallymark.operators import attribution, beacons, dedup, erase, health, payloads, ratelimit, reports
from tallymark.schemas import EXPORT_KEYS
from tallymark.sources import files, io


def walk(events, ttl):
    end, out = {}, {}
    for key, t, seq in sorted(events, key=lambda e: (e[1], e[2])):
        out[seq] = not end.get(key, -1) > t
        if out[seq]:
            end[key] = t + ttl
    return out


def test_window_does_not_slide(spark):
    r = random.Random(4)
    events = [(f"k{r.randrange(6)}", r.randrange(2000), i) for i in range(600)] + [("a", 0, 1000), ("a", 60, 1001), ("a", 99, 1002), ("a", 100, 1003), ("a", 199, 1004), ("a", 200, 1005)]
    df = spark.createDataFrame(events, "key string, t long, seq long")
    assert {x.seq: x.is_first for x in dedup.fixed_window(df, "key", 100).collect()} == walk(events, 100)
    null = spark.createDataFrame([(None, 1, 1), (None, 2, 2)], "key string, t long, seq long")
    assert [x.is_first for x in dedup.fixed_window(null, "key", 100).collect()] == [True, True]


def test_rotation_seeds_the_new_key_for_a_full_lifetime(spark):
    rows = [("d", 0, 1, False), ("d", 50, 2, True), ("d", 120, 3, True), ("d", 149, 4, True), ("d", 150, 5, True), ("e", 60, 6, True)]
    got = dedup.rotating(spark.createDataFrame(rows, "d string, t long, seq long, after boolean"), "d", 100).collect()
    assert {x.seq for x in got if x.is_first} == {1, 5, 6}


def test_failed_sends_release_their_claim(spark):
    rows = [("k", 0, 1, False), ("k", 1, 2, True), ("k", 2, 3, True), ("k", 102, 4, True)]
    got = dedup.claims(spark.createDataFrame(rows, "k string, t long, seq long, sent boolean"), "k", 100).collect()
    assert {x.seq for x in got if x.is_claimed} == {1, 2, 4}


def test_rate_limit_counts_refused_hits(spark):
    rows = [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 60, 4), ("", 0, 5), ("", 0, 6), ("", 0, 7)]
    df = spark.createDataFrame(rows, "k string, t long, seq long")
    assert {x.seq for x in ratelimit.rate_limited(df, "k", 2).collect() if not x.allowed} == {3}
    assert all(x.allowed for x in ratelimit.rate_limited(df, "k", 0).collect())


BEACON = "seq long, recv_ts long, query string, connecting_ip string"
ROKU = "advertiser_id=adv1&campaign_id=camp1&creative_id=cre1&device_ip=203.0.113.7&country=US&dma=501"


def ingest(spark, queries, settings=Settings(), at=None, ip="192.0.2.1", seen=None):
    rows = [(i, at[i] if at else 1000 + i, q, ip) for i, q in enumerate(queries)]
    config = spark.createDataFrame([("camp1", "active"), ("kids", "child_directed"), ("off", '{"status": "paused"}'), ("late", '{"start": "2030-01-01"}'), ("eu", '{"markets": ["de"]}')], "campaign_id string, value string")
    return beacons.ingested(spark.createDataFrame(rows, BEACON), config, settings, seen)


def test_every_beacon_has_one_outcome(spark):
    q = [ROKU, ROKU, ROKU.replace("camp1", "nope"), ROKU.replace("cre1", ""), ROKU.replace("camp1", "off"), ROKU.replace("camp1", "late"), ROKU.replace("camp1", "eu"), ROKU.replace("country=US", "country=${C}"), ROKU.replace("7&", "9&")]
    out = ingest(spark, q)
    want = ["counted", "duplicate", "reject_not_allowlisted", "reject_missing_params", "reject_not_allowlisted", "reject_outside_flight", "reject_out_of_market", "duplicate", "counted"]
    assert [r.outcome for r in out.orderBy("seq").collect()] == want
    led = beacons.ledger(out).groupBy("outcome").count().collect()
    n = {r.outcome: r["count"] for r in led}
    assert n.pop("received") == sum(n.values()) == len(q)
    assert beacons.impression_events(out).count() == 2 and beacons.raw_rows(out).count() == 4 and beacons.recent_impressions(out).count() == 2


def test_order_of_reasons(spark):
    assert {r.outcome for r in ingest(spark, [ROKU, "x"], Settings(enabled=False)).collect()} == {"disabled"}
    got = ingest(spark, [ROKU, ROKU, "bad"], Settings(rate_limit=2), at=[1020, 1021, 1022])
    assert [r.outcome for r in got.orderBy("seq").collect()] == ["counted", "duplicate", "reject_rate_limited"]
    assert ingest(spark, [ROKU], Settings(signature_required=True)).first().outcome == "reject_not_configured"
    assert ingest(spark, [ROKU], Settings(signature_required=True, signing_key="k")).first().outcome == "reject_bad_signature"


def test_identity_and_coarse_keys(spark):
    opted = ROKU.replace("203.0.113.7", "0.0.0.0")
    ua = "pf=ua&advertiser_id=a&campaign_id=camp1&creative_id=c&ifa=device-1&lmt=0&app_id=com.example.channel&ifa_type=RIDA&country=US"
    rows = ingest(spark, [opted, opted, ua, ua.replace("lmt=0", "lmt=1"), ROKU.replace("camp1", "kids")], at=[0, 3599, 10, 11, 12]).orderBy("seq").collect()
    assert [r.outcome for r in rows] == ["counted", "duplicate", "counted", "counted", "counted"]
    assert [(r.ifa_present, r.lmt, r.platform, r.ifa_type) for r in rows] == [("0", True, "roku", "ip"), ("0", True, "roku", "ip"), ("1", False, "ua", "rida"), ("0", True, "ua", "rida"), ("0", True, "roku", "ip")]
    assert {r.outcome for r in ingest(spark, [opted, opted], Settings(cap_unattributable=False)).collect()} == {"counted"}


RECENT = "store_key string, ts long, seq long, ip string, rida string, hh_id string, region string, city string, postal string, lmt boolean"
CALLS = "call_seq long, store_key string, call_ts long, caller_state string, callId string, creative_id string, ani string, start_time long, duration double, sale_value double, currency string, event_group_id string"


def match(spark, imps, settings=Settings(), state="Texas"):
    r = spark.createDataFrame([("cre", t, i, "10.0.0.1", "rida", "hh", region, "", "", lmt) for i, (t, region, lmt) in enumerate(imps)], RECENT)
    c = spark.createDataFrame([(1, "cre", 10_000, state, "c1", "cre", "4155550142", 10_000, 90.0, 12.5, None, None)], CALLS)
    return attribution.matched(c, r, settings)


def test_a_previous_salt_joins_batches(spark):
    """A device seen under the old salt is a repeat after the change, and its new key is set for a full lifetime."""
    old, new = Settings(hash_salt="old"), Settings(hash_salt="new", previous_salt="old")
    first = ingest(spark, [ROKU], old, at=[1000])
    store = beacons.stored(first, old, 2000)
    again = ingest(spark, [ROKU, ROKU.replace("7&", "8&")], new, at=[2000, 2001], seen=store)
    assert [r.outcome for r in again.orderBy("seq").collect()] == ["duplicate", "counted"]
    assert [r.outcome for r in ingest(spark, [ROKU], Settings(hash_salt="new"), at=[2000], seen=store).collect()] == ["counted"]
    store = beacons.stored(again, new, 3000, store)
    assert sorted(r.exp for r in store.collect()) == [1000 + 86_400, 2000 + 86_400, 2001 + 86_400]
    late = ingest(spark, [ROKU, ROKU], Settings(hash_salt="new"), at=[1000 + 86_400, 2000 + 86_400], seen=store)
    assert [r.outcome for r in late.orderBy("seq").collect()] == ["duplicate", "counted"]


def test_repeated_numbers_count_once(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("b", 5, 1)], "key string, t long, seq long")
    assert sorted((r.key, r.is_first) for r in dedup.fixed_window(df, "key", 100).collect()) == [("a", False), ("a", True), ("b", True)]


def test_call_path(spark):
    import hashlib
    import hmac
    import json

    def row(i, t, sent=True, **more):
        body = json.dumps({"callId": "c1", "dnis": "+18005550100", "ani": "4155550142", "startTime": t, "durationSeconds": 75} | more).encode()
        return (i, t, "192.0.2.1", str(t), hmac.new(b"ck", f"{t}.".encode() + body, hashlib.sha256).hexdigest(), bytearray(body), sent)

    rows = [row(1, 10_000, False), row(2, 10_100), row(3, 10_200), row(4, 10_300, callId="c2", durationSeconds=5), row(5, 10_400, callId="c3", dnis="+18005550101"), row(6, 10_500, callId="c4", dnis="x" * 12)]
    r = spark.createDataFrame(rows, "seq long, recv_ts long, ip string, x_timestamp string, x_signature string, body binary, sent boolean")
    n = spark.createDataFrame([("+18005550100", '{"creativeId": "cre", "campaignId": "camp1"}'), ("+18005550101", '{"creativeId": "cre", "platform": "ua"}')], "dnis string, value string")
    i = spark.createDataFrame([("cre", 9_990, 1, "10.0.0.1", "", "", "California", "", "", False)], RECENT)
    a = spark.createDataFrame([("415", "California")], "area_code string, state string")
    settings = Settings(call_key="ck", live=True, send_key="k", event_group_id="g")
    got = attribution.concluded(r, n, i, a, settings).orderBy("seq").collect()
    assert [x.outcome for x in got] == ["call_capi_error", "call_fired", "call_duplicate", "call_not_qualified", "call_skipped", "call_bad_request"]
    assert [x.gate for x in got[:3]] == ["ok", "ok", "no_match"] and got[1].caller_state == "California"
    led = {(x.outcome, x.campaign_id) for x in attribution.call_ledger(attribution.concluded(r, n, i, a, settings)).collect()}
    assert ("call_fired", "camp1") in led and ("call_skipped", "unknown") in led and ("call_bad_request", "unknown") in led
    dry = attribution.concluded(r, n, i, a, Settings(call_key="ck", event_group_id="g"), "https://example.test")
    assert [x.outcome for x in dry.orderBy("seq").collect()][:2] == ["call_capi_error", "call_dry_run"]


def test_ledgers_can_be_reported(spark):
    out = ingest(spark, [ROKU, ROKU, "bad"], at=[1704067201, 1704067202, 1704067203])
    failed = spark.createDataFrame([(1704067203, "raw_write_error", "camp1")], "t long, kind string, campaign_id string")
    led = beacons.ledger(out).unionByName(beacons.alerts(failed))
    got = {r.outcome: r.events for r in reports.ledger_summary(led, datetime(2024, 1, 2)).collect()}
    assert got == {"received": 3, "counted": 1, "duplicate": 1, "reject_missing_params": 1, "alert_raw_write_error": 1}
    day = reports.counted_alerts(led).first()
    assert (day.received, day.counted, day.is_alert) == (3, 1, True)


def test_matching(spark):
    assert match(spark, [(9_940, "Texas", False)]).first().confidence > 0.9
    edge = match(spark, [(6_400, "Texas", False), (6_399, "Texas", False), (10_001, "Texas", False)]).first()
    assert edge.candidates == 1 and edge.best.ts == 6_400
    tie = match(spark, [(9_000, "Texas", False), (9_000, "Texas", False)]).first()
    assert tie.best.imp_seq == 1
    assert match(spark, [(9_000, "Ohio", False)] * 11).first().gate == "too_many_candidates"
    over = match(spark, [(9_000, "Texas", False)] * 5, Settings(candidate_ceiling=4)).first()
    assert (over.matched, over.best, over.confidence) == (True, None, 0.0)
    none = match(spark, [(1, "Texas", False)]).first()
    assert (none.matched, none.gate, none.confidence) == (False, "no_match", 0.0)
    assert match(spark, [(6_500, "Ohio", False)] * 3).first().gate == "low_confidence"


def test_payloads(spark):
    import json

    body = json.loads(payloads.payload(match(spark, [(9_990, "Texas", False)]), "roku", Settings(event_group_id="g")).first().payload)
    event = body["events"][0]
    assert body["event_group_id"] == "g" and event["event_id"] == "call_c1_cre" and event["opt_out"] == "false"
    assert event["user_data"] == {"is_hashed": True, "ph": event["user_data"]["ph"], "client_ip_address": "10.0.0.1", "aRI": "rida", "st": "Texas"}
    assert event["custom_data"]["match_type"] == "probabilistic_ip" and event["custom_data"]["currency"] == "USD"
    limited = json.loads(payloads.payload(match(spark, [(9_990, "Texas", True)]), "ua").first().payload)["events"][0]
    assert limited["opt_out"] == "true" and limited["custom_data"]["match_type"] == "probabilistic_ip" and set(limited["user_data"]) == {"is_hashed", "ph", "st"}
    many = json.loads(payloads.payload(match(spark, [(9_990, "Texas", False)] * 12), "ua").first().payload)["events"][0]
    assert "match_confidence" not in many["custom_data"]
    assert payloads.skipped("roku", Settings(), "k") == "no_event_group" and payloads.skipped("ua", Settings(), "k") == "no_endpoint" and payloads.skipped("ua", Settings(live=True), None, "u") == "no_key"


def verdict(spark, **n):
    return health.ledger_health(spark.createDataFrame(list(n.items()), "outcome string, events long")).first()


def test_health(spark):
    assert verdict(spark, received=1000, counted=100, duplicate=900).healthy
    bad = verdict(spark, received=1000, reject_out_of_market=900, reject_bad_signature=60, counted=40)
    assert bad.reject_ratio == pytest.approx(0.6) and not bad.healthy
    assert not verdict(spark, received=1_000_000, counted=1_000_000, alert_export_failed=1).healthy
    assert not verdict(spark, received=10, counted=9).healthy and not verdict(spark, received=10, counted=9, reject_internal=1).healthy
    assert not verdict(spark, call_capi_error=6, call_fired=4).call_healthy and verdict(spark, received=0).healthy


@pytest.mark.parametrize(("date", "ts", "fresh"), [("2026-09-14", "2026-09-15 02:00:00", True), ("2026-09-10", "2026-09-15 02:00:00", False), ("2026-09-14", "2026-09-13 23:00:00", False), ("x", "2026-09-15 02:00:00", False)])
def test_freshness(spark, date, ts, fresh):
    m = spark.createDataFrame([(date, 1, ts)], "date string, rows long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert health.export_freshness(m, datetime(2026, 9, 15, 3)).first().fresh is fresh


def test_export_and_marker(spark, tmp_path):
    keys = [k for k in io.EXPORT_KEYS if k != "hour"]
    e = spark.createDataFrame([(f"2026-09-{d:02d} 05:30:00", 2) for d in (13, 14, 14, 15)], "ts string, _sample_interval long")
    e = e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumns({k: F.lit("x") for k in keys})
    for _ in range(2):  # a day is replaced, not added to
        io.export_day(spark, e, str(tmp_path), "2026-09-14", datetime(2026, 9, 15, 2))
    got = spark.read.json(f"{tmp_path}/dt=2026-09-14").collect()
    assert [r.impressions for r in got] == [4]
    m = io.read_marker(spark, str(tmp_path)).first()
    assert (m.date, m.rows, m.partial) == ("2026-09-14", 1, False)


def test_erasure(spark, tmp_path):
    h, sibling = "ab12" + "0" * 60, "ab12" + "1" * 60
    rows = [(h, "2026-09-13", "ab12", "01", 1), (h, "2026-09-14", "ab12", "02", 2), (sibling, "2026-09-14", "ab12", "02", 3), (h, "2026-09-20", "ab12", "02", 4), ("ff" * 32, "2026-09-14", "ffff", "02", 5)]
    io.write_raw(spark.createDataFrame(rows, "ifa_hash string, dt string, h string, hh string, n long"), f"{tmp_path}/raw")
    got = erase.erase_raw(spark, f"{tmp_path}/raw", h, "2026-09-13", "2026-09-15")
    assert (got["scanned"], got["deleted"], got["days_scanned"]) == (3, 2, 3)
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/raw").collect()) == [3, 4, 5]
    io.write_raw(spark.createDataFrame([(None, "2026-09-20", "ab12", "03", 6)], "ifa_hash string, dt string, h string, hh string, n long"), f"{tmp_path}/raw")
    with pytest.raises(ValueError, match="no hash"):
        erase.erase_raw(spark, f"{tmp_path}/raw", h, "2026-09-19", "2026-09-21")
    keys = spark.createDataFrame([(f"{h}|c1|x",), (f"{h}|c_|x",), (f"{sibling}|c1|x",)], "k string")
    assert erase.erase_keys(keys, "k", [h], ["c1"]).count() == 2 and dedup.erase_prefix(keys, "k", "").count() == 3


RAW = "ifa_hash string, dt string, h string, hh string, n long"


def raw_rows(spark, path, h):
    rows = [(h, f"2026-09-{10 + d}", h[:4], f"{hour:02d}", 10 * d + hour) for d in range(4) for hour in (1, 2)] + [(h[:4] + "f" * 60, "2026-09-12", h[:4], "01", 99)]
    io.write_raw(spark.createDataFrame(rows, RAW), path)


def test_erasure_stops_at_its_cap(spark, tmp_path):
    h = "ab12" + "0" * 60
    raw_rows(spark, f"{tmp_path}/raw", h)
    got = erase.erase_raw(spark, f"{tmp_path}/raw", h, "2026-09-01", "2026-09-14", max_scan=4)
    assert got == {"scanned": 5, "deleted": 4, "days_scanned": 3, "truncated": True}
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/raw").collect()) == [1, 2, 11, 12, 99]
    got = erase.erase_raw(spark, f"{tmp_path}/raw", h, "2026-09-09", "2026-09-14")
    assert got == {"scanned": 5, "deleted": 4, "days_scanned": 6, "truncated": False}


@pytest.mark.parametrize("after", ["folders", "kept", "replaced"])
def test_an_interrupted_erasure_loses_nothing(spark, tmp_path, monkeypatch, after):
    h, path = "ab12" + "0" * 60, f"{tmp_path}/raw"
    raw_rows(spark, path, h)

    def stop(*_):
        raise RuntimeError("stopped")

    real, calls = erase.resume, []

    def resume(s, p):
        calls.append(p)
        if len(calls) == 1:
            return False
        if after == "replaced":  # stopped when the old files are gone and one new one has come
            for r in s.read.parquet(f"{p}.erasing/files").collect():
                files.delete(s, r["file"])
            folder, name = erase.found(s, f"{p}.erasing/kept")[0]
            files.move(s, f"{p}.erasing/kept/{folder}/{name}", f"{p}/{folder}")
        stop()

    monkeypatch.setattr(erase, "resume", resume)
    with pytest.raises(RuntimeError):
        erase.erase_raw(spark, path, h, "2026-09-12", "2026-09-13")
    monkeypatch.setattr(erase, "resume", real)
    if after == "folders":  # the copy itself was not finished
        (tmp_path / "raw.erasing" / "finished").unlink()
    erase.erase_raw(spark, path, h, "2026-09-01", "2026-09-02")
    left = sorted(r.n for r in spark.read.parquet(path).collect())
    assert left == ([1, 2, 11, 12, 99] if after != "folders" else [1, 2, 11, 12, 21, 22, 31, 32, 99])
    assert not (tmp_path / "raw.erasing").exists()


def test_only_files_that_hold_the_subject_are_rewritten(spark, tmp_path):
    """Hundreds of subjects of one shard in many files: one subject's erasure leaves the others' files as they are."""
    h = lambda i: f"ab12{i:060x}"
    path = tmp_path / "raw"
    for part in range(6):  # files of their own, as batches write them
        rows = [(h(i), "2026-09-14", "ab12", f"{i % 3:02d}", i) for i in range(part * 50, part * 50 + 50)]
        io.write_raw(spark.createDataFrame(rows, RAW), str(path))
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    got = erase.erase_raw(spark, str(path), h(60), "2026-09-13", "2026-09-15")
    after = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    assert (got["scanned"], got["deleted"]) == (300, 1) and len(before) == 18
    assert len(before.keys() - after.keys()) == len(after.keys() - before.keys()) == 1
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert sorted(r.n for r in spark.read.parquet(str(path)).collect()) == [i for i in range(300) if i != 60]
    import pyarrow.parquet as pq

    assert any(pq.ParquetFile(f).metadata.row_group(0).column(0).statistics.has_min_max for f in after)  # by which a scan leaves files out


def test_late_rows_are_added_to_their_days_alone(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rows = lambda *r: spark.createDataFrame(list(r), "ts string, campaign_id string, _sample_interval long").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumns({k: F.lit("x") for k in EXPORT_KEYS if k not in ("hour", "campaign_id")})
    first = rows(("2026-09-13 05:10:00", "a", 2), ("2026-09-13 06:10:00", "a", 1), ("2026-09-14 05:00:00", "b", 4))
    late = rows(("2026-09-13 05:59:59", "a", 3), ("2026-09-13 07:00:00", "c", 1), ("2026-09-15 00:00:00", "a", 9))
    io.write_rollup(first, path)
    before = {f.name for f in (tmp_path / "rollup" / "dt=2026-09-14").glob("*.parquet")}
    assert io.add_to_rollup(spark, late, path) == ["2026-09-13", "2026-09-15"] and io.add_to_rollup(spark, late.where("false"), path) == []
    got = spark.read.schema(reports.rollup(first).schema).parquet(path)
    want = reports.rollup(first.unionByName(late))
    read = lambda d: sorted((tuple(r) for r in d.select(*sorted(d.columns)).collect()), key=str)
    assert read(got) == read(want) and {f.name for f in (tmp_path / "rollup" / "dt=2026-09-14").glob("*.parquet")} == before


def test_reach_from_sketches_of_days(spark):
    imps = spark.range(30_000).select((F.date_add(F.lit("2026-09-01"), (F.col("id") % 7).cast("int"))).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("c"), F.col("id") % 2).alias("campaign_id"), F.sha2((F.col("id") % 9_000).cast("string"), 256).alias("ifa_hash"), F.when(F.col("id") % 10 > 0, "1").otherwise("0").alias("ifa_present"))
    whole, again = reports.reach_sketches(imps), reports.reach_sketches(imps.where("ifa_hash < '8'"))
    for d in (whole, reports.merged_sketches(whole, again)):
        for first, last in (("2026-09-01", "2026-09-30"), ("2026-09-03", "2026-09-04")):
            got = {r.campaign_id: r.reach for r in reports.reach_between(d, first, last).collect()}
            want = {r.campaign_id: r.n for r in imps.where(F.col("ts").between(first, f"{last} 23:59:59") & (F.col("ifa_present") == "1")).groupBy("campaign_id").agg(F.countDistinct("ifa_hash").alias("n")).collect()}
            assert got.keys() == want.keys() and all(abs(got[c] - n) <= reports.sketch_bound() * n for c, n in want.items())


def test_one_frequent_key_and_rows_without_a_time(spark):
    """A million events of one key over blocks of time, against a walk over its distinct seconds."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(400_000)) + 7).alias("t"), F.col("id").alias("seq"))
    seconds = sorted(r.t for r in df.select("t").distinct().collect())
    for ttl in (1000, 86_400):
        got = sorted(r.t for r in dedup.fixed_window(df, "key", ttl).where("is_first").select("t").collect())
        want, end = [], -1
        for t in seconds:
            if t >= end:
                want.append(t)
                end = t + ttl
        assert got == want
    rows = [("a", None, 1), ("a", 5, 2), (None, None, 3), ("a", 6, 4), (None, 7, 5), ("b", None, 6)]
    d = spark.createDataFrame(rows, "key string, t long, seq long")
    assert {r.seq for r in dedup.fixed_window(d, "key", 10).collect() if r.is_first} == {2, 5}
    assert {r.seq for r in dedup.rotating(d.withColumn("after", F.lit(False)), "key", 10).collect() if r.is_first} == {2, 5}
    assert {r.seq for r in dedup.fixed_window(d, "key", 0).collect() if r.is_first} == {2, 4, 5}


def test_matching_equals_every_impression_against_every_call(spark):
    """Bursts outside the windows, stores above the ceiling, several calls in a second, calls without a store."""
    r = random.Random(11)
    states = ["Texas", "Ohio", ""]
    imps = [(f"s{r.randrange(5)}", 10_000 + r.randrange(30_000), i, f"ip{i}", "", "", r.choice(states), "", "", False) for i in range(700)]
    imps += [("s0", 25_000, 1000 + i, "burst", "", "", "Texas", "", "", False) for i in range(90)] + [(None, 12_000, 5000, "", "", "", "", "", "", False)]
    calls = [(i, r.choice(["s0", "s1", "s2", "s3", "s4", "none", None]), 10_000 + r.randrange(32_000), r.choice([*states, None]), f"c{i}") for i in range(300)]
    calls += [(1000 + i, "s0", t, "Texas", "x") for i, t in enumerate([24_999, 25_000, 25_000, 28_600, 28_601])]
    df = spark.createDataFrame(calls, "call_seq long, store_key string, call_ts long, caller_state string, callId string")
    for settings in (Settings(candidate_ceiling=40), Settings(candidate_ceiling=3, match_window_minutes=7), Settings(match_window_minutes=0)):
        w = settings.match_window_minutes * 60
        got = attribution.matched(df, spark.createDataFrame(imps, RECENT), settings).collect()
        assert len(got) == len(calls)
        for x in got:
            near = [i for i in imps if i[0] is not None and i[0] == x.store_key and x.call_ts - w <= i[1] <= x.call_ts]
            assert x.candidates == len(near) and (x.best is None) == (not 0 < len(near) <= settings.candidate_ceiling)
            if x.best is not None:
                s = 1.0 if len(near) <= 1 else 1 / math.log2(len(near) + 1)
                geo = lambda i: 0.8 if (x.caller_state or "") and i[6].lower() == x.caller_state.lower() else 0.5 if not x.caller_state else 0.2
                score = {i[2]: 0.5 * s + 0.3 * (1 - (x.call_ts - i[1]) / max(w, 1)) + 0.2 * geo(i) for i in near}
                assert score[x.best.imp_seq] == pytest.approx(max(score.values())) and x.best.score == pytest.approx(max(score.values()))
                assert (x.best.ts, x.best.imp_seq) == max((i[1], i[2]) for i in near if score[i[2]] == score[x.best.imp_seq])


def test_every_erasure_says_whether_its_scope_is_complete(spark, tmp_path):
    h, path = "ab12" + "0" * 60, f"{tmp_path}/raw"
    raw_rows(spark, path, h)
    keys = spark.createDataFrame([(f"{h}|c1|x", 1), (f"{h}|c2|x", 1), ("ff|c1|x", 1)], "key string, exp long")
    campaigns = spark.createDataFrame([("c1",), ("c2",)], "campaign_id string")
    call = lambda **n: erase.erase_subject(spark, path, keys, n.pop("campaigns", campaigns), [h], "2026-09-10", "2026-09-13", **n)
    want = erase.expected_result(erase.read_raw(spark, path), keys, campaigns, [h], "2026-09-10", "2026-09-13", ["c1"]).first()
    left, row = call(requested=["c1"])
    assert left.count() == 2 and row.first() == want and (want.dedup_deleted, want.raw_deleted, want.scope_complete) == (1, 8, False)
    assert call()[1].first().scope_complete
    assert call(campaigns=campaigns.where("false"))[1].first()[-2:] == (False, "no_campaigns")
    assert erase.scope_of(campaigns, [], 1) == (["c1"], False)
    io.write_raw(spark.createDataFrame([(None, "2026-09-12", "ab12", "03", 6)], RAW), path)
    assert call()[1].first()[-2:] == (False, "raw_erase_failed")


def test_reports_weigh_rows(spark):
    rows = [("2024-01-30 23:00:00", "c1", 5), ("2024-01-24 00:00:00", "c1", 7), ("2024-01-24 00:00:01", "c2", 9)]
    d = spark.createDataFrame(rows, "ts string, campaign_id string, _sample_interval long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [tuple(r) for r in reports.by_campaign(d, datetime(2024, 1, 31)).collect()] == [("c2", 9), ("c1", 5)]
    assert reports.listing(d, "campaign_id", "c", 2).first().complete is False


def test_call_requests(spark):
    import hashlib
    import hmac
    import json

    call = {"callId": "c1", "dnis": "+18005550100", "ani": "4155550142", "startTime": 1000, "durationSeconds": 75}
    def row(i, c, ts="1000", sig=None):
        body = json.dumps(c).encode()
        return (i, 1000, f"192.0.2.{i}", ts, sig or hmac.new(b"ck", f"{ts}.".encode() + body, hashlib.sha256).hexdigest(), bytearray(body))

    rows = [row(1, call), row(2, call, sig="00"), row(3, call, ts="1"), row(4, {**call, "dnis": "+18005550199"}), row(5, {**call, "durationSeconds": 5}), row(6, {**call, "callId": ""}), row(7, {**call, "dnis": "+18005550101"})]
    r = spark.createDataFrame(rows, "seq long, recv_ts long, ip string, x_timestamp string, x_signature string, body binary")
    n = spark.createDataFrame([("+18005550100", '{"creativeId": "cre"}'), ("+18005550101", '{"creativeId": "a b"}')], "dnis string, value string")
    got = attribution.received_calls(r, n, Settings(call_key="ck")).orderBy("seq").collect()
    assert [x.outcome for x in got] == [None, "call_unauthorized", "call_unauthorized", "call_unknown_number", "call_not_qualified", "call_bad_request", "call_bad_number_mapping"]
    assert {x.outcome for x in attribution.received_calls(r, n).collect()} == {"call_not_configured"}
