"""Verdicts on the ledger and on the export's freshness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.config import Settings
from tallymark.functions.expressions import second_of

#: Names of outcomes by what they mean.
CALL_REJECTIONS = ("call_unauthorized", "call_unknown_number", "call_bad_request", "call_not_qualified", "call_bad_number_mapping", "call_not_configured", "call_rate_limited")
CALL_ERRORS = ("call_capi_error", "call_internal_error")
CALL_SENT = ("call_fired", "call_dry_run", "call_skipped", "call_duplicate")
POLICY = ("reject_outside_flight", "reject_out_of_market")
INFRASTRUCTURE = ("alert_export_failed", "alert_health_check_failed", "alert_health_write_failed", "alert_claim_release_failed", "alert_admin_dsar_error", "alert_notify_failed")


def _ratio(a, b):
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def ledger_health(summary: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row from ``(outcome, events)``: sums, ratios and verdicts."""
    o = F.col("outcome")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("events"))), F.lit(0)).cast("bigint")

    s = summary.agg(
        total(o == "received").alias("received"),
        total(o == "counted").alias("counted"),
        total(o == "duplicate").alias("duplicate"),
        total(o == "disabled").alias("disabled"),
        total(o.startswith("reject_")).alias("rejects"),
        total(o.isin(*POLICY)).alias("policy_rejects"),
        total(o == "reject_internal").alias("internal_errors"),
        total(o.startswith("alert_")).alias("alerts"),
        total(o.isin(*INFRASTRUCTURE)).alias("infra_alerts"),
        total(o.isin(*CALL_SENT, *CALL_REJECTIONS, *CALL_ERRORS)).alias("call_attempts"),
        total(o.isin(*CALL_REJECTIONS)).alias("call_rejections"),
        total(o.isin(*CALL_ERRORS)).alias("call_errors"),
    )
    c = F.col
    s = s.withColumn("accounted", c("counted") + c("duplicate") + c("rejects") + c("disabled"))
    s = s.withColumns(
        {
            "unexpected": F.greatest(F.lit(0), c("received") - c("accounted")).cast("bigint"),
            "counted_ratio": _ratio(c("counted"), c("received")),
            "reject_ratio": _ratio(F.greatest(F.lit(0), c("rejects") - c("policy_rejects")), F.greatest(F.lit(0), c("received") - c("policy_rejects"))),
            "alert_ratio": F.when(c("received") > 0, c("alerts").cast("double") / c("received").cast("double")).when(c("alerts") > 0, 1.0).otherwise(0.0),
            "call_error_ratio": _ratio(c("call_errors"), c("call_attempts")),
            "call_reject_ratio": _ratio(c("call_rejections"), c("call_attempts")),
        }
    )
    beacons = (
        (c("internal_errors") == 0)
        & (c("unexpected") == 0)
        & (c("received") == c("accounted"))
        & (c("infra_alerts") == 0)
        & (c("alert_ratio") <= settings.max_alert_ratio)
        & (c("reject_ratio") <= settings.max_reject_ratio)
    )
    calls = (c("call_error_ratio") <= settings.max_call_error_ratio) & (c("call_reject_ratio") <= settings.max_call_reject_ratio)
    return s.withColumns({"beacon_healthy": beacons, "call_healthy": calls, "healthy": beacons & calls})


def export_freshness(marker: DataFrame, now: datetime, max_age_hours: float = 26) -> DataFrame:
    """``age_hours`` and ``fresh`` of the last export's marker: recent, and of yesterday or the day before."""
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    age = (second_of(at) - second_of(F.col("ts"))) / 3600.0
    day = F.datediff(at.cast("date"), F.col("date").try_cast("date"))
    return marker.select("date", "rows", age.alias("age_hours"), F.coalesce((age <= max_age_hours) & day.between(1, 2), F.lit(False)).alias("fresh"))


def overall(health: DataFrame, freshness: DataFrame) -> DataFrame:
    """Both verdicts as one row; a missing marker is not fresh."""
    f = freshness.agg(F.coalesce(F.bool_or("fresh"), F.lit(False)).alias("export_fresh"))
    return health.select("healthy").crossJoin(F.broadcast(f)).select(F.col("healthy").alias("ledger_healthy"), "export_fresh", (F.col("healthy") & F.col("export_fresh")).alias("all_healthy"))
