"""Schemas of the inputs and of the stored tables, as DDL; nothing is inferred. Names of columns are fixed values."""

from __future__ import annotations

EDGE = "country string, region string, regionCode string, city string, postalCode string, metroCode string, latitude string, longitude string, timezone string, asn int, asOrganization string, colo string"
BEACON = f"seq bigint, recv_ts bigint, query string, connecting_ip string, user_agent string, cf struct<{EDGE.replace(' string', ':string').replace(' int', ':int')}>"
CALL_REQUEST = "seq bigint, recv_ts bigint, ip string, x_timestamp string, x_signature string, body binary"
CALL = "callId string, dnis string, ani string, startTime double, durationSeconds double, saleValue double, currency string"
LOOKUP = "key string, value string"
CAMPAIGN = "status string, start string, end string, markets array<string>, child_directed string, _bad string"
MAPPING = "creativeId string, campaignId string, advertiserId string, platform string, qualifySeconds double, eventGroupId string, rokuCreativeId string, _bad string"
#: The named string columns of an impression besides its time and weight, in stored order.
EVENT_NAMES = ("campaign_id", "creative_id", "ifa_hash", "country", "app_id", "advertiser_id", "ifa_present", "ifa_type", "platform", "dma", "roku_advertiser_id", "roku_campaign_id", "roku_creative_id")
EVENT = "ts timestamp_ntz, " + ", ".join(f"{n} string" for n in EVENT_NAMES) + ", _sample_interval bigint"
LEDGER = "ts timestamp_ntz, outcome string, campaign_id string, _sample_interval bigint"
RECENT = "store_key string, ts bigint, seq bigint, ip string, rida string, hh_id string, region string, city string, postal string, lmt boolean"
#: The keys of the daily export, in the order of its rows.
EXPORT_KEYS = ("hour", "campaign_id", "creative_id", "country", "app_id", "advertiser_id", "ifa_present", "platform", "dma", "roku_advertiser_id", "roku_campaign_id", "roku_creative_id")
MARKER = "date string, rows bigint, key string, ts timestamp_ntz, partial boolean"
