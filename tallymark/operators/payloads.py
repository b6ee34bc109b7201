"""Conversion events of matched calls, for both platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.config import Settings, is_placeholder
from tallymark.functions.expressions import phone_hash, text


def present(x) -> Column:
    """Null (and so left out) where empty."""
    return F.when(text(x) != "", x)


def payload(matched: DataFrame, platform: str, settings: Settings = Settings()) -> DataFrame:
    """Adds ``event`` and ``payload`` (JSON without absent fields).

    ``matched``: ``callId``, ``creative_id``, ``ani``, ``caller_state``, ``start_time``, ``duration``, ``sale_value``,
    ``currency``, ``event_group_id`` and what ``attribution.matched`` adds.
    """
    lmt = F.col("matched") & F.coalesce("best.lmt", F.lit(False))
    device = F.col("matched") & F.col("best").isNotNull() & F.col("device_ids") & ~lmt
    best = lambda n: F.when(device, present(F.col(f"best.{n}")))
    state = present(F.col("caller_state"))
    user = [F.lit(True).alias("is_hashed"), phone_hash(F.col("ani")).alias("ph"), best("ip").alias("client_ip_address")]
    if platform == "roku":
        user += [best("rida").alias("aRI"), F.coalesce(best("region"), state).alias("st"), best("city").alias("ct"), best("postal").alias("zp")]
    else:
        user += [best("rida").alias("ifa"), best("hh_id").alias("household_id"), F.when(device, best("region")).otherwise(state).alias("st"), best("postal").alias("zp")]
    sale = F.col("sale_value").isNotNull()
    custom = F.struct(
        F.array("creative_id").alias("content_ids"),
        F.lit("product").alias("content_type"),
        F.col("candidates").alias("match_candidates"),
        F.when(F.col("device_ids"), "probabilistic_ip").otherwise("phone_only").alias("match_type"),
        F.col("gate").alias("match_gate"),
        F.when(F.col("gate") != "too_many_candidates", F.col("confidence")).alias("match_confidence"),
        F.col("duration").alias("call_duration_seconds"),
        F.col("sale_value").alias("value"),
        F.when(sale, F.coalesce("currency", F.lit("USD"))).alias("currency"),
    )
    event = F.struct(
        F.concat(F.lit("call_"), F.col("callId"), F.lit("_"), F.col("creative_id")).alias("event_id"),
        F.lit(settings.event_name or "LEAD").alias("event_name"),
        F.lit("conversion").alias("event_type"),
        F.col("start_time").alias("event_time"),
        F.lit("phone_call").alias("event_source"),
        F.struct(*user).alias("user_data"),
        custom.alias("custom_data"),
        lmt.cast("string").alias("opt_out"),
    )
    group = F.coalesce(F.col("event_group_id"), F.lit(settings.event_group_id))
    d = matched.withColumn("event", event)
    return d.withColumn("payload", F.to_json(F.struct(group.alias("event_group_id"), F.array("event").alias("events")), {"ignoreNullFields": "true"}))


def skipped(platform: str, settings: Settings, key: str | None, endpoint: str | None = None) -> str | None:
    """Why a send would be skipped, or None: no key when live, no group id, no endpoint."""
    if settings.live and is_placeholder(key):
        return "no_key"
    if platform == "roku" and is_placeholder(settings.event_group_id):
        return "no_event_group"
    return "no_endpoint" if platform == "ua" and not endpoint else None
