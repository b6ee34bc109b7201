"""The registered queries in SQL, written against the driver's ``events`` alone."""

from __future__ import annotations

E = """e AS (
  SELECT event_id, ts, user_id, event_type, value, floor(epoch(ts))::BIGINT AS t, event_id AS seq,
         json_extract_string(props, '$.k')::INT AS k
  FROM events)"""

IMP = (
    E
    + """, imp AS (
  SELECT t, seq, ts, user_id, event_type, k, 'adv_' || user_id % 3 AS advertiser_id, 'camp_' || event_id % 5 AS campaign_id,
         'cre_' || user_id % 10 AS creative_id, CASE WHEN user_id % 2 = 0 THEN 'roku' ELSE 'ua' END AS platform,
         CASE WHEN k % 10 = 0 THEN 'XX' WHEN k % 10 = 1 THEN 'CA' ELSE 'US' END AS country, k < 5 AS lmt,
         CASE WHEN k >= 10 THEN '1' ELSE '0' END AS ifa_present,
         CASE WHEN k >= 10 THEN sha256('salt|' || user_id) ELSE 'anon' END AS ifa_hash,
         ['California', 'Texas', 'New York', 'Illinois'][user_id % 4 + 1] AS region, (500 + user_id % 20)::VARCHAR AS dma,
         'app.' || k % 3 AS app_id, CASE WHEN user_id % 2 = 0 THEN 'ip' ELSE 'rida' END AS ifa_type,
         CASE WHEN user_id % 2 = 0 THEN 'ra_' || user_id % 3 ELSE '' END AS roku_advertiser_id,
         CASE WHEN user_id % 2 = 0 THEN 'rc_' || event_id % 5 ELSE '' END AS roku_campaign_id,
         CASE WHEN user_id % 2 = 0 THEN 'rr_' || user_id % 10 ELSE '' END AS roku_creative_id,
         1 + event_id % 4 AS w
  FROM e WHERE event_type IN ('view', 'click'))"""
)

LEDGER = (
    E
    + """, led AS (
  SELECT ts, unnest(CASE WHEN event_type = 'purchase' THEN [o] ELSE ['received', o] END) AS outcome, 'camp_' || event_id % 5 AS campaign_id
  FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'counted' WHEN event_type = 'click' THEN 'duplicate'
          WHEN event_type = 'error' AND k < 50 THEN 'reject_bad_signature' WHEN event_type = 'error' THEN 'reject_outside_flight'
          WHEN event_type = 'signup' THEN 'reject_not_allowlisted' WHEN k < 40 THEN 'call_fired' WHEN k < 80 THEN 'call_dry_run'
          ELSE 'call_not_qualified' END AS o FROM e)),
summary AS (SELECT outcome, count(*)::BIGINT AS events FROM led WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 720 HOUR GROUP BY outcome)"""
)

CALLS = """, calls AS (
  SELECT seq AS call_seq, t AS call_ts, k, value, 'call-' || event_id AS call_id, 'cre_' || user_id % 10 AS store,
         ['415', '214', '212', '312'][event_id % 4 + 1] AS code, lpad(user_id::VARCHAR, 7, '0') AS rest,
         ['California', 'Texas', 'New York', 'Illinois'][event_id % 4 + 1] AS state
  FROM e WHERE event_type = 'purchase')"""


def match(limit: int) -> str:
    """Best candidates, with weights as doubles and four places by the exact binary value."""
    return (
        IMP
        + CALLS
        + f"""
, pairs AS (
  SELECT c.call_seq, i.seq, i.t, i.user_id, i.region, i.lmt, i.platform, count(*) OVER (PARTITION BY c.call_seq) AS n,
         1::DOUBLE - greatest(0, c.call_ts - i.t)::DOUBLE / 3600::DOUBLE AS tm,
         CASE WHEN lower(i.region) = lower(c.state) THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS geo
  FROM calls c JOIN imp i ON c.store = i.creative_id AND i.t BETWEEN c.call_ts - 3600 AND c.call_ts),
scored AS (SELECT *, 0.5::DOUBLE * (CASE WHEN n <= 1 THEN 1::DOUBLE ELSE 1::DOUBLE / log2(n + 1) END) + 0.3::DOUBLE * tm + 0.2::DOUBLE * geo AS score FROM pairs),
best AS (SELECT *, row_number() OVER (PARTITION BY call_seq ORDER BY score DESC, t DESC, seq DESC) AS r FROM scored),
m AS (
  SELECT c.*, coalesce(b.n, 0)::BIGINT AS candidates, b.seq AS best_seq, b.user_id, b.region, b.lmt, b.platform,
         CASE WHEN b.seq IS NULL THEN 0::DOUBLE ELSE (((b.score * 1152921504606846976.0::DOUBLE)::BIGINT::HUGEINT * 20000 + 1152921504606846976::HUGEINT)
           // 2305843009213693952::HUGEINT)::DOUBLE / 10000.0::DOUBLE END AS confidence
  FROM calls c LEFT JOIN best b ON c.call_seq = b.call_seq AND b.r = 1),
g AS (SELECT *, CASE WHEN candidates = 0 THEN 'no_match' WHEN candidates > {limit} THEN 'too_many_candidates'
        WHEN confidence < 0.6::DOUBLE THEN 'low_confidence' ELSE 'ok' END AS gate FROM m)"""
    )


def payload(platform: str) -> str:
    device = "gate = 'ok' AND NOT lmt"
    ua = f"{device} AND platform = 'ua'"
    if platform == "roku":
        user = f"CASE WHEN {ua} THEN 'dev-' || user_id END AS aRI, CASE WHEN {device} THEN region ELSE state END AS st"
    else:
        user = f"CASE WHEN {ua} THEN 'dev-' || user_id END AS ifa, CASE WHEN {ua} THEN 'hh-' || user_id END AS household_id, CASE WHEN {device} THEN region ELSE state END AS st"
    return f"""WITH {match(2)}
SELECT 'call_' || call_id || '_' || store AS event_id, CASE WHEN coalesce(lmt, false) THEN 'true' ELSE 'false' END AS opt_out,
       sha256('+1' || code || rest) AS ph, CASE WHEN {device} THEN '10.0.0.' || user_id % 250 END AS client_ip_address, {user},
       candidates AS match_candidates, CASE WHEN gate = 'ok' THEN 'probabilistic_ip' ELSE 'phone_only' END AS match_type, gate AS match_gate,
       CASE WHEN gate <> 'too_many_candidates' THEN confidence END AS match_confidence, value AS call_duration_seconds,
       CASE WHEN k >= 50 THEN value END AS value, CASE WHEN k >= 50 THEN 'USD' END AS currency
FROM g"""


def values(items: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + i.replace("'", "''") + "'" for i in items)
    return f"v AS (SELECT event_id, [{quoted}][event_id % {len(items)} + 1] AS v FROM events)"


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MATCH_COLUMNS = "SELECT call_id AS \"callId\", candidates, best_seq, confidence, gate, gate = 'ok' AS device_ids FROM g"
KEYS = """, keyed AS (SELECT ifa_hash || '|' || campaign_id || '|' || creative_id AS key, t, seq FROM imp WHERE ifa_present = '1')"""

HEALTH = """SELECT *, beacon_healthy AND call_healthy AS healthy FROM (
  SELECT *, internal_errors = 0 AND unexpected = 0 AND received = accounted AND infra_alerts = 0 AND alert_ratio <= 0.01 AND reject_ratio <= 0.5 AS beacon_healthy,
         call_error_ratio <= 0.5 AND call_reject_ratio <= 0.5 AS call_healthy FROM (
    SELECT *, greatest(0, received - accounted)::BIGINT AS unexpected, CASE WHEN received > 0 THEN counted::DOUBLE / received ELSE 0::DOUBLE END AS counted_ratio,
           CASE WHEN received > policy_rejects THEN greatest(0, rejects - policy_rejects)::DOUBLE / (received - policy_rejects) ELSE 0::DOUBLE END AS reject_ratio,
           CASE WHEN received > 0 THEN alerts::DOUBLE / received WHEN alerts > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS alert_ratio,
           CASE WHEN call_attempts > 0 THEN call_errors::DOUBLE / call_attempts ELSE 0::DOUBLE END AS call_error_ratio,
           CASE WHEN call_attempts > 0 THEN call_rejections::DOUBLE / call_attempts ELSE 0::DOUBLE END AS call_reject_ratio FROM (
      SELECT *, counted + duplicate + rejects + disabled AS accounted FROM (
        SELECT coalesce(sum(events) FILTER (outcome = 'received'), 0)::BIGINT AS received, coalesce(sum(events) FILTER (outcome = 'counted'), 0)::BIGINT AS counted,
               coalesce(sum(events) FILTER (outcome = 'duplicate'), 0)::BIGINT AS duplicate, coalesce(sum(events) FILTER (outcome = 'disabled'), 0)::BIGINT AS disabled,
               coalesce(sum(events) FILTER (starts_with(outcome, 'reject_')), 0)::BIGINT AS rejects,
               coalesce(sum(events) FILTER (outcome IN ('reject_outside_flight', 'reject_out_of_market')), 0)::BIGINT AS policy_rejects,
               coalesce(sum(events) FILTER (outcome = 'reject_internal'), 0)::BIGINT AS internal_errors,
               coalesce(sum(events) FILTER (starts_with(outcome, 'alert_')), 0)::BIGINT AS alerts,
               coalesce(sum(events) FILTER (outcome IN ('alert_export_failed', 'alert_health_check_failed', 'alert_health_write_failed', 'alert_claim_release_failed', 'alert_admin_dsar_error', 'alert_notify_failed')), 0)::BIGINT AS infra_alerts,
               coalesce(sum(events) FILTER (starts_with(outcome, 'call_')), 0)::BIGINT AS call_attempts,
               coalesce(sum(events) FILTER (outcome IN ('call_unauthorized', 'call_unknown_number', 'call_bad_request', 'call_not_qualified', 'call_bad_number_mapping', 'call_not_configured', 'call_rate_limited')), 0)::BIGINT AS call_rejections,
               coalesce(sum(events) FILTER (outcome IN ('call_capi_error', 'call_internal_error')), 0)::BIGINT AS call_errors
        FROM summary))))"""

ROLLUP = """rollup AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, campaign_id, creative_id, country, app_id, advertiser_id, ifa_present, platform, dma,
         roku_advertiser_id, roku_campaign_id, roku_creative_id, sum(w)::BIGINT AS impressions
  FROM imp WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY ALL)"""

FIRST = """firsts AS (
  SELECT key, min(t) AS t FROM keyed GROUP BY key
  UNION ALL
  SELECT key, t FROM (SELECT f.key, k.t, row_number() OVER (PARTITION BY f.key ORDER BY k.t) AS r FROM firsts f JOIN keyed k ON k.key = f.key AND k.t >= f.t + 86400) WHERE r = 1)"""

BEACONS = f"""{E}, b AS (
  SELECT seq, user_id, k, t, event_id, user_id % 2 = 0 AS roku,
         CASE WHEN k = 0 THEN '' WHEN k = 1 THEN 'no such' ELSE 'camp_' || event_id % 7 END AS camp,
         CASE WHEN k % 10 = 1 THEN 'CA' WHEN k % 10 = 2 THEN 'XX' ELSE 'US' END AS country
  FROM e),
c AS (
  SELECT *, camp = 'camp_1' AS child, camp IN ('camp_0', 'camp_1', 'camp_2', 'camp_4') AS allowed FROM b),
l AS (
  SELECT *, CASE WHEN roku THEN (child AND allowed) OR k % 10 = 3 ELSE (child AND allowed) OR k % 7 IN (0, 1) END AS lmt FROM c),
p AS (
  SELECT *, NOT lmt AND k % 10 NOT IN (3, 4, 5) AS known,
         CASE WHEN camp IN ('', 'no such') THEN 'missing_params' WHEN NOT allowed THEN 'not_allowlisted'
              WHEN camp = 'camp_2' AND (t < 1704412800 OR t > 1705795199) THEN 'outside_flight'
              WHEN country = 'CA' AND camp <> 'camp_4' THEN 'out_of_market' END AS reason,
         CASE WHEN roku THEN 'ip:10.0.' ELSE '' END AS x
  FROM l),
parsed AS (
  SELECT seq, t, user_id, k, reason, CASE WHEN roku THEN 'roku' ELSE 'ua' END AS platform, CASE WHEN known THEN '1' ELSE '0' END AS ifa_present,
         CASE WHEN known THEN sha256('salt|' || CASE WHEN roku THEN 'ip:10.0.' || user_id % 200 || '.' || user_id % 250 ELSE 'dev-' || user_id END) ELSE 'anon' END AS ifa_hash,
         lmt, country, CASE WHEN k % 4 = 2 THEN '' ELSE (500 + user_id % 20)::VARCHAR END AS dma, 'cre_' || user_id % 10 AS creative_id, camp
  FROM p)"""

#: A replay of the store of live keys, key by key, and each beacon's terminal outcome.
OUTCOMES = f"""{BEACONS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id % 7, t // 60 ORDER BY t, seq) <= 1 AS allowed FROM parsed),
early AS (
  SELECT *, CASE WHEN NOT allowed THEN 'reject_rate_limited' WHEN reason IS NOT NULL THEN 'reject_' || reason END AS early,
         CASE WHEN ifa_present = '1' THEN ifa_hash ELSE sha256('pepper|ip:192.0.2.' || user_id % 7 || ':' || t // 3600) END || '|' || camp || '|' || creative_id AS key
  FROM o),
live AS (SELECT key, t, seq, t >= 1705276800 AS after, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS n FROM early WHERE early IS NULL)"""
ENDED = "ended AS (SELECT e.*, coalesce(early, CASE WHEN is_first THEN 'counted' ELSE 'duplicate' END) AS outcome FROM early e LEFT JOIN store USING (seq))"
STORE = """store AS (
  SELECT key, n, seq, t + 86400 AS exp, true AS is_first FROM live WHERE n = 1
  UNION ALL
  SELECT k.key, k.n, k.seq, CASE WHEN w.exp > k.t THEN w.exp ELSE k.t + 86400 END, NOT w.exp > k.t FROM store w JOIN live k ON k.key = w.key AND k.n = w.n + 1)"""
ROTATED_STORE = """store AS (
  SELECT key, n, seq, CASE WHEN after THEN 0 ELSE t + 86400 END AS old, CASE WHEN after THEN t + 86400 ELSE 0 END AS new, true AS is_first FROM live WHERE n = 1
  UNION ALL
  SELECT k.key, k.n, k.seq, CASE WHEN NOT k.after AND w.old <= k.t THEN k.t + 86400 ELSE w.old END, CASE WHEN k.after AND w.new <= k.t THEN k.t + 86400 ELSE w.new END,
         NOT (w.old > k.t OR k.after AND w.new > k.t)
  FROM store w JOIN live k ON k.key = w.key AND k.n = w.n + 1)"""

#: Call requests: verdict, claim and end. Needs ``e``.
CONCLUDED = """req AS (SELECT *, row_number() OVER (PARTITION BY user_id % 3, (t + 5) // 60 ORDER BY t, seq) AS nth FROM e WHERE event_type = 'purchase'),
pre AS (
  SELECT *, CASE WHEN nth > 1 THEN 'call_rate_limited' WHEN k < 10 THEN 'call_unauthorized' WHEN k < 15 THEN 'call_bad_request' WHEN k < 20 THEN 'call_unknown_number'
              WHEN k < 25 THEN 'call_bad_number_mapping' WHEN value < CASE WHEN user_id % 10 = 3 THEN 0 ELSE 60 END THEN 'call_not_qualified' END AS early_end,
         user_id % 2 = 0 AND k % 2 = 0 AS sent, (event_id % 200) || ':' || user_id % 10 AS claim
  FROM req),
tries AS (SELECT claim, t, seq, sent, row_number() OVER (PARTITION BY claim ORDER BY t, seq) AS n FROM pre WHERE early_end IS NULL),
held AS (
  SELECT claim, n, seq, CASE WHEN sent THEN t + 172800 ELSE 0 END AS exp, true AS is_claimed FROM tries WHERE n = 1
  UNION ALL
  SELECT k.claim, k.n, k.seq, CASE WHEN w.exp > k.t THEN w.exp WHEN k.sent THEN k.t + 172800 ELSE 0 END, NOT w.exp > k.t FROM held w JOIN tries k ON k.claim = w.claim AND k.n = w.n + 1),
concluded AS (
  SELECT p.*, coalesce(is_claimed, false) AS goes_on,
         coalesce(early_end, CASE WHEN NOT is_claimed THEN 'call_duplicate' WHEN user_id % 2 = 1 THEN 'call_skipped' WHEN k % 2 = 1 THEN 'call_capi_error' ELSE 'call_dry_run' END) AS outcome
  FROM pre p LEFT JOIN held USING (seq))"""

#: The ledger of beacons, calls and alerts together.
WHOLE = f"""WITH RECURSIVE {OUTCOMES}, {STORE}, {ENDED}, {CONCLUDED}, led AS (
  SELECT TIMESTAMP '1970-01-01' + to_seconds(t) AS ts, unnest(['received', outcome]) AS outcome, CASE WHEN camp IN ('', 'no such') THEN 'unknown' ELSE camp END AS campaign_id FROM ended
  UNION ALL
  SELECT TIMESTAMP '1970-01-01' + to_seconds(t + 5), outcome,
         CASE WHEN outcome IN ('call_rate_limited', 'call_unauthorized', 'call_bad_request', 'call_unknown_number', 'call_bad_number_mapping') THEN 'unknown' ELSE 'camp_' || (user_id % 10) % 5 END FROM concluded
  UNION ALL
  SELECT TIMESTAMP '1970-01-01' + to_seconds(t), CASE k WHEN 97 THEN 'alert_raw_write_error' WHEN 98 THEN 'alert_export_failed' ELSE 'alert_recent_write_error' END, 'camp_' || event_id % 5 FROM e WHERE k >= 97),
summary AS (SELECT outcome, count(*)::BIGINT AS events FROM led WHERE ts > TIMESTAMP '2024-01-01' GROUP BY outcome)"""


def fresh(hours: int, where: str = "true") -> str:
    return f"""SELECT date, rows, age_hours, age_hours <= {hours} AND date_diff('day', date::DATE, DATE '2024-01-31') BETWEEN 1 AND 2 AS fresh FROM (
  SELECT strftime(max(ts), '%Y-%m-%d') AS date, count(*) AS rows, (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('hour', max(ts)))) / 3600.0::DOUBLE AS age_hours FROM imp WHERE {where} GROUP BY campaign_id)"""


def pads(key: str) -> tuple[str, str]:
    """The two padded keys of a keyed digest, as SQL text."""
    return tuple("'" + "".join(chr(b ^ p) for b in key.encode().ljust(64, b"\0")).replace("'", "''") + "'" for p in (0x36, 0x5C))


def erasure(campaigns: str, count: int, complete: bool) -> str:
    return f"""WITH RECURSIVE {IMP}{KEYS}, {FIRST}, live AS (SELECT key FROM firsts GROUP BY key HAVING max(t) + 86400 > 1706659200),
days AS (SELECT day, count(ifa_hash) AS n, count(ifa_hash) FILTER (ifa_hash = sha256('salt|17')) AS mine FROM (SELECT unnest(generate_series(DATE '2024-01-03', DATE '2024-01-25', INTERVAL 1 DAY))::DATE AS day)
  LEFT JOIN imp ON imp.ts::DATE = day AND imp.ifa_present = '1' AND substr(ifa_hash, 1, 4) = substr(sha256('salt|17'), 1, 4) GROUP BY day),
reached AS (SELECT *, coalesce(sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS ok FROM days)
SELECT (SELECT count(*) FROM live WHERE {campaigns}) AS dedup_deleted, sum(n)::BIGINT AS raw_scanned, sum(mine)::BIGINT AS raw_deleted, sum(n) >= 60 AS raw_truncated,
       count(*)::INT AS raw_days_scanned, {count}::INT AS campaigns_scanned, {str(complete).lower()} AS scope_complete, NULL::VARCHAR AS error FROM reached WHERE ok"""


_KINDS = {
    "dates": ("2024-01-05", "2024-01-05T10:00:00Z", "2024-02-30", "soon", "", "2024-01-05 10:30:00"),
    "ips": ("10.0.0.1", "0.0.0.0", "256.1.1.1", "1.2.3", "01.2.3.4", "255.255.255.255", "1.2.3.4.5", "[[[DEVICE_IP]]]", "", "1.2.3.4\n"),
    "ids": ("abc-123", "00000000-0000-0000-0000-000000000000", "FFFF-FFFF", "ffffffff", "[IFA]", "${IDA}", "NULL", "n/a", "-", "", "a", "aab"),
    "limits": ("1", " Yes ", "true", "0", "no", "", "[LMT]", "2", "FALSE", "n"),
    "phones": ("+1 (415) 555-0142", "0044 20 7946 0958", "14155550142", "212.555.0199", "12", "1999", "", "+1-312-555-0100", "00012145550123"),
}

def signatures(key: str, message: str) -> str:
    inner, outer = pads(key)
    return f"sha256(encode({outer}) || unhex(sha256({inner} || {message})))"


#: By form, the text that a signature covers, and the least time from which the tag has expired; null: always.
_FORMS = (
    ("1767225600d", None), ("1767225600f", None), ("1767225600.5", 1), ("1767195136", 1), ("1767225600", 1), ("1767225600", 1), ("1767225600", 1), ("1_767_225_600", None), ("Infinity", None), ("1e400", None),
    ("5000000000", 1), ("1767225600", 1), ("1e+21", 1), ("6", None), ("1767195136", 1), ("1767225600L", None), ("0x", None),
)

SQL = {
    "a1_impressions_by_campaign": f"WITH {IMP} SELECT campaign_id, sum(w)::BIGINT AS impressions FROM imp WHERE ts > TIMESTAMP '2024-01-24' GROUP BY 1",
    "a2_impressions_by_country": f"WITH {IMP} SELECT country, sum(w)::BIGINT AS impressions FROM imp WHERE ts > TIMESTAMP '2024-01-29' GROUP BY 1",
    "a3_hourly_trend": f"WITH {IMP} SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, sum(w)::BIGINT AS impressions FROM imp WHERE ts > TIMESTAMP '2024-01-28' GROUP BY 1",
    "a4_reach_exact": f"WITH {IMP} SELECT campaign_id, count(DISTINCT ifa_hash) AS reach FROM imp WHERE ts > TIMESTAMP '2024-01-01' AND ifa_present = '1' GROUP BY 1",
    "a4_reach_of_campaign": f"""WITH {IMP} SELECT 'camp_3' AS campaign_id, count(DISTINCT ifa_hash) AS reach FROM imp WHERE campaign_id = 'camp_3' AND ts > TIMESTAMP '2024-01-17' AND ifa_present = '1'
UNION ALL SELECT 'camp_9', count(DISTINCT ifa_hash) FROM imp WHERE campaign_id = 'camp_9'""",
    "a5_recon_summary": f"WITH {LEDGER} SELECT * FROM summary",
    "a6_daily_rollup": f"WITH {IMP}, {ROLLUP} SELECT * FROM rollup",
    "a9_native_ids": f"WITH {IMP} SELECT roku_advertiser_id, roku_campaign_id, roku_creative_id, sum(w)::BIGINT AS impressions, max(ts) AS last_seen FROM imp WHERE platform = 'roku' AND ts > TIMESTAMP '2024-01-01' GROUP BY 1, 2, 3",
    "a10_frequency": f"WITH {IMP} SELECT campaign_id, frequency, count(*) AS devices FROM (SELECT campaign_id, ifa_hash, sum(w)::BIGINT AS frequency FROM imp WHERE ifa_present = '1' AND ts > TIMESTAMP '2024-01-01' GROUP BY 1, 2) GROUP BY 1, 2",
    "a12_volume_alerts": f"WITH {IMP} SELECT day, impressions, before, coalesce(abs(impressions - before)::DOUBLE / before > 0.2, false) AS is_alert FROM (SELECT day, impressions, lag(impressions) OVER (ORDER BY day) AS before FROM (SELECT ts::DATE AS day, sum(w)::BIGINT AS impressions FROM imp GROUP BY 1))",
    "d1_fixed_window": f"""WITH RECURSIVE {IMP}, keyed AS (SELECT user_id || '|' || event_type AS key, t, seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, seq) AS n FROM imp),
walk AS (
  SELECT key, n, seq, t + 86400 AS exp, true AS is_first FROM keyed WHERE n = 1
  UNION ALL
  SELECT k.key, k.n, k.seq, CASE WHEN w.exp > k.t THEN w.exp ELSE k.t + 86400 END, NOT w.exp > k.t FROM walk w JOIN keyed k ON k.key = w.key AND k.n = w.n + 1)
SELECT seq, is_first FROM walk""",
    "d1_one_key": f"""WITH RECURSIVE {IMP}, firsts AS (
  SELECT min(t) AS t FROM imp
  UNION ALL
  SELECT (SELECT min(i.t) FROM imp i WHERE i.t >= f.t + 21600) FROM firsts f WHERE EXISTS (SELECT 1 FROM imp i WHERE i.t >= f.t + 21600))
SELECT seq, t IN (SELECT t FROM firsts) AND row_number() OVER (PARTITION BY t ORDER BY seq) = 1 AS is_first FROM imp""",
    "d2_rotation": f"""WITH RECURSIVE {IMP}, keyed AS (SELECT user_id AS key, t, seq, t >= 1705276800 AS after, row_number() OVER (PARTITION BY user_id ORDER BY t, seq) AS n FROM imp),
walk AS (
  SELECT key, n, seq, CASE WHEN after THEN 0 ELSE t + 259200 END AS old, CASE WHEN after THEN t + 259200 ELSE 0 END AS new, true AS is_first FROM keyed WHERE n = 1
  UNION ALL
  SELECT k.key, k.n, k.seq, CASE WHEN NOT k.after AND w.old <= k.t THEN k.t + 259200 ELSE w.old END, CASE WHEN k.after AND w.new <= k.t THEN k.t + 259200 ELSE w.new END,
         NOT (w.old > k.t OR k.after AND w.new > k.t)
  FROM walk w JOIN keyed k ON k.key = w.key AND k.n = w.n + 1)
SELECT seq, is_first FROM walk""",
    "d4_live_keys": f"WITH RECURSIVE {IMP}{KEYS}, {FIRST} SELECT key, max(t) + 86400 AS exp FROM firsts GROUP BY key HAVING max(t) + 86400 > 1706659200",
    "d5_call_claims": f"""WITH RECURSIVE {E}, keyed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS n FROM (SELECT (seq % 40) || ':' || user_id % 10 AS key, t, seq, k < 50 AS sent FROM e WHERE event_type = 'purchase')),
walk AS (
  SELECT key, n, seq, CASE WHEN sent THEN t + 172800 ELSE 0 END AS exp, true AS is_claimed FROM keyed WHERE n = 1
  UNION ALL
  SELECT k.key, k.n, k.seq, CASE WHEN w.exp > k.t THEN w.exp WHEN k.sent THEN k.t + 172800 ELSE 0 END, NOT w.exp > k.t FROM walk w JOIN keyed k ON k.key = w.key AND k.n = w.n + 1)
SELECT seq, is_claimed FROM walk""",
    "d6_erase_prefix": f"""WITH RECURSIVE {IMP}{KEYS}, {FIRST}, live AS (SELECT key FROM firsts GROUP BY key HAVING max(t) + 86400 > 1706659200)
SELECT count(*) AS kept FROM live WHERE NOT starts_with(key, sha256('salt|17') || '|')""",
    "d10_ledger_closure": f"WITH {LEDGER} SELECT campaign_id, count(*) FILTER (outcome = 'received') AS received, count(*) FILTER (outcome <> 'received' AND NOT starts_with(outcome, 'call_')) AS terminal FROM led GROUP BY 1",
    "e1_erase_preview": f"""WITH {IMP}, r AS (SELECT ifa_hash, strftime(ts, '%Y-%m-%d') AS dt, CASE WHEN ifa_hash = 'anon' THEN 'anon' ELSE substr(ifa_hash, 1, 4) END AS h FROM imp)
SELECT dt, count(*) AS scanned, count(*) FILTER (ifa_hash = sha256('salt|17')) AS to_delete, count(*) FILTER (ifa_hash IS NULL) AS without_hash
FROM r WHERE dt BETWEEN '2024-01-03' AND '2024-01-25' AND h = substr(sha256('salt|17'), 1, 4) GROUP BY dt""",
    "f1_phones": f"""WITH {values(_KINDS["phones"])}, d AS (SELECT event_id, ltrim(regexp_replace(v, '[^0-9]', '', 'g'), '0') AS d FROM v),
n AS (SELECT event_id, CASE WHEN d = '' THEN '' WHEN length(d) = 10 THEN '+1' || d ELSE '+' || d END AS e164, CASE WHEN length(d) = 11 AND d[1] = '1' THEN substr(d, 2) ELSE d END AS a FROM d)
SELECT event_id, e164, sha256(e164) AS hash, CASE WHEN length(a) >= 3 THEN substr(a, 1, 3) ELSE '' END AS area_code FROM n""",
    "f4_caller_state": f"WITH {E}{CALLS} SELECT state AS caller_state, count(*) AS calls FROM calls GROUP BY 1",
    "f13_payload_roku": payload("roku"),
    "f14_payload_ua": payload("ua"),
    "h1_ledger_health": f"{WHOLE} {HEALTH}",
    "h2_export_freshness": f"WITH {IMP} {fresh(4)}",
    "h3_overall": f"{WHOLE}, {IMP.split('FROM events), ', 1)[1]}, f AS ({fresh(26, "campaign_id = 'camp_1'")}) SELECT healthy AS ledger_healthy, coalesce(bool_or(fresh), false) AS export_fresh, healthy AND coalesce(bool_or(fresh), false) AS all_healthy FROM ({HEALTH}) LEFT JOIN f ON true GROUP BY healthy",
    "j4_match_best": f"WITH {match(10)} {MATCH_COLUMNS}",
    "j4_match_gated": f"WITH {match(2)} {MATCH_COLUMNS}",
    "o3_page": f"WITH {IMP}, {ROLLUP} SELECT hour, campaign_id, creative_id, impressions FROM rollup ORDER BY hour, campaign_id, creative_id, country, app_id, ifa_present, advertiser_id, dma LIMIT 20 OFFSET 5",
    "p1_beacon_fields": f"WITH {BEACONS} SELECT seq, reason, platform, ifa_present, ifa_hash, lmt, country, dma, creative_id FROM parsed",
    "p12_usable_ipv4": f"WITH {values(_KINDS['ips'])} SELECT event_id, regexp_full_match(v, '{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}') AND v <> '0.0.0.0' AS usable FROM v",
    "p13_usable_ad_id": f"""WITH {values(_KINDS["ids"])}, b AS (SELECT event_id, v, regexp_replace(v, '[-: ]', '', 'g') AS bare FROM v)
SELECT event_id, v <> '' AND NOT regexp_matches(v, '[\\[\\]{{}}%#<>$]') AND NOT (length(bare) > 1 AND replace(bare, bare[1], '') = '') AND NOT regexp_full_match(bare, '[0-]+')
       AND lower(v) NOT IN ('undefined', 'null', 'nil', 'n/a', 'na', 'nan', 'none', 'unknown', 'false', '-') AS usable FROM b""",
    "p14_limits": f"WITH {values(_KINDS['limits'])} SELECT event_id, event_id % 3 = 0 OR NOT lower(trim(v)) IN ('0', 'false', 'no', 'n', '') AS lmt FROM v",
    "p15_identity": "SELECT event_id, sha256('salt|' || user_id) AS hash FROM events",
    "p21_qualified": f"WITH {E} SELECT value >= CASE WHEN k < 30 THEN 100 WHEN k < 60 THEN 0 ELSE 60 END AS qualified, count(*) AS calls FROM e WHERE event_type = 'purchase' GROUP BY 1",
    "s5_listing": f"""WITH RECURSIVE {IMP}{KEYS}, {FIRST}, live AS (SELECT key FROM firsts GROUP BY key HAVING max(t) + 86400 > 1706659200), f AS (SELECT key FROM live WHERE starts_with(key, '0'))
SELECT key, (SELECT count(*) FROM f) <= 20 AS complete FROM f ORDER BY key LIMIT 20""",
    "w1_rate_limit": f"WITH {E} SELECT seq, row_number() OVER (PARTITION BY user_id % 7, t // 3600 ORDER BY t, seq) <= 3 AS allowed FROM e",
    "d3_outcomes": f"WITH RECURSIVE {OUTCOMES}, {STORE}, {ENDED} SELECT seq, outcome FROM ended",
    "d3_rotation": f"WITH RECURSIVE {OUTCOMES}, {ROTATED_STORE}, {ENDED} SELECT seq, outcome FROM ended",
    "p5_tag_signatures": f"""WITH {E}, m AS (SELECT event_id, k, t, sha256(encode({pads("signing-key")[1]}) || unhex(sha256({pads("signing-key")[0]} || 'adv|camp_' || event_id % 5 || '|cre|1767225600'))) AS sig FROM e)
SELECT event_id, sig, CASE WHEN k % 10 = 0 THEN 'bad_signature' WHEN k BETWEEN 40 AND 69 THEN 'expired' WHEN k >= 70 THEN 'bad_signature' END AS verdict FROM m""",
    "p5_number_forms": f"""WITH {E}, f AS (SELECT *, {[f or '' for f, _ in _FORMS]}[event_id % {len(_FORMS)} + 1] AS form, {[1 if v else 0 for _, v in _FORMS]}[event_id % {len(_FORMS)} + 1] AS holds FROM e)
SELECT event_id, {signatures("signing-key", "'adv_' || user_id || '|camp_' || event_id % 5 || '|cre|' || form")} AS sig, CASE WHEN holds = 0 THEN 'expired' END AS verdict FROM f""",
    "p19_stamps": f"WITH {E} SELECT event_id, k % 7 <> 0 AND event_id % 11 IN (0, 3, 4, 5, 6) AND k * 10 + CASE WHEN event_id % 11 = 3 THEN 0.25 ELSE 0 END <= 300 AS signed FROM e",
    "a8_candidates": f"WITH {IMP}{CALLS} SELECT c.call_seq, count(*) AS candidates FROM calls c JOIN imp i ON c.store = i.creative_id AND i.t BETWEEN c.call_ts - 10800 AND c.call_ts GROUP BY c.call_seq",
    "p8_boundaries": f"""WITH {values(_KINDS['dates'])}, s AS (SELECT event_id, regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS bare, epoch(try_cast(replace(replace(v, 'T', ' '), 'Z', '') AS TIMESTAMP))::BIGINT AS second FROM v)
SELECT event_id, second AS starts_at, CASE WHEN bare THEN second + 86399 ELSE second END AS ends_at FROM s""",
    "p23_recent": f"""WITH RECURSIVE {OUTCOMES}, {STORE}, {ENDED} SELECT creative_id AS store_key, t AS ts, seq, CASE WHEN platform = 'roku' AND ifa_present = '1' THEN '10.0.' || user_id % 200 || '.' || user_id % 250 ELSE '' END AS ip,
       CASE WHEN platform = 'ua' AND ifa_present = '1' THEN 'dev-' || user_id ELSE '' END AS rida, '' AS hh_id, lmt FROM ended WHERE outcome = 'counted'""",
    "p24_raw_rows": f"""WITH RECURSIVE {OUTCOMES}, {STORE}, {ENDED} SELECT seq, strftime(TIMESTAMP '1970-01-01' + to_seconds(t), '%Y-%m-%dT%H:%M:%S.000Z') AS ts, outcome, camp AS campaign_id,
       CASE k % 10 WHEN 3 THEN '0.0.0.0' WHEN 4 THEN '[[[DEVICE_IP]]]' WHEN 5 THEN '10.0.0.256' ELSE '10.0.' || user_id % 200 || '.' || user_id % 250 END AS device_ip, '192.0.2.' || user_id % 7 AS connecting_ip, ifa_present,
       CASE WHEN platform = 'roku' THEN '' END AS roku_creative_id, strftime(TIMESTAMP '1970-01-01' + to_seconds(t), '%Y-%m-%d') AS dt, CASE WHEN ifa_hash = 'anon' THEN 'anon' ELSE substr(ifa_hash, 1, 4) END AS h,
       strftime(TIMESTAMP '1970-01-01' + to_seconds(t), '%H') AS hh FROM ended WHERE outcome IN ('counted', 'duplicate')""",
    "c1_call_outcomes": f"""WITH RECURSIVE {match(10)}, {CONCLUDED}
SELECT c.seq, outcome, CASE WHEN goes_on THEN best_seq END AS best_seq, CASE WHEN goes_on THEN candidates ELSE 0 END AS candidates, CASE WHEN goes_on THEN gate ELSE 'no_match' END AS gate,
       CASE WHEN c.k BETWEEN 10 AND 14 THEN '' ELSE state END AS caller_state FROM concluded c JOIN g ON g.call_seq = c.seq""",
    "s9_ledger": f"{WHOLE} SELECT outcome, campaign_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM led GROUP BY 1, 2",
    "s7_numeric": f"WITH {E} SELECT event_type, count(*) AS n, CASE WHEN event_type <> 'error' THEN sum(k)::BIGINT END AS k FROM e GROUP BY event_type",
    "f11_ceiling": f"""WITH {match(10)}, c AS (SELECT *, CASE WHEN candidates <= 2 THEN confidence ELSE 0 END AS sure FROM m)
SELECT call_id AS "callId", candidates, candidates > 0 AS matched, CASE WHEN candidates <= 2 THEN best_seq END AS best_seq, sure AS confidence,
       CASE WHEN candidates = 0 THEN 'no_match' WHEN candidates > 2 THEN 'too_many_candidates' WHEN sure < 0.6::DOUBLE THEN 'low_confidence' ELSE 'ok' END AS gate FROM c""",
    "a11_store_size": f"WITH RECURSIVE {IMP}{KEYS}, {FIRST} SELECT count(*) AS keys FROM (SELECT key FROM firsts GROUP BY key HAVING max(t) + 86400 > 1706659200)",
    "a12_counted_alerts": f"{WHOLE} SELECT day, received, counted, coalesce(counted::DOUBLE / nullif(received, 0) < 0.5, false) AS is_alert FROM (SELECT ts::DATE AS day, count(*) FILTER (outcome = 'received') AS received, count(*) FILTER (outcome = 'counted') AS counted FROM led GROUP BY 1)",
    "e4_erasure_result": erasure("starts_with(key, sha256('salt|17') || '|')", 5, True),
    "e4_partial_erasure": erasure("starts_with(key, sha256('salt|17') || '|camp_1|') OR starts_with(key, sha256('salt|17') || '|camp_2|')", 2, False),
}
