"""Calls: validation, lookup, qualification and matching with recent impressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.config import Settings, is_placeholder
from tallymark.functions import expressions as x
from tallymark.operators.beacons import ledger_rows, store_key
from tallymark.operators.dedup import claims
from tallymark.operators.dimensions import dimension
from tallymark.operators.payloads import skipped
from tallymark.operators.ratelimit import rate_limited
from tallymark.schemas import CALL, MAPPING
from tallymark.sources.tables import written

#: Outcomes of calls whose number is not known to be mapped.
BEFORE_MAPPING = ("call_rate_limited", "call_not_configured", "call_bad_request", "call_unauthorized", "call_unknown_number", "call_bad_number_mapping")
MAX_BODY, MAX_CALL_ID, MAX_AGE, MAX_AHEAD, MAX_QUALIFY = 65_536, 128, 86_400, 300, 86_400


def call_reason(body, now) -> Column:
    """Null, or bad_json, missing_fields or bad_fields. Types count: a number in quotes is none."""
    v = F.try_parse_json(body)
    kind = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
    is_text = lambda n: (kind(n) == "STRING") & (F.length(F.try_variant_get(v, f"$.{n}", "string")) > 0)
    is_number = lambda n: kind(n).rlike(r"\A(BIGINT|DOUBLE|DECIMAL.*)\z")
    get = lambda n, t: F.try_variant_get(v, f"$.{n}", t)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    start = get("startTime", "double")
    return (
        F.when(v.isNull() | no(F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY")), "bad_json")
        .when(no(is_text("callId") & is_text("dnis") & is_text("ani")), "missing_fields")
        .when((F.length(get("callId", "string")) > MAX_CALL_ID) | get("callId", "string").rlike(r"[\x00-\x1f\x7f]"), "bad_fields")
        .when(no(is_number("durationSeconds") & (get("durationSeconds", "double") >= 0)), "bad_fields")
        .when(no(is_number("startTime") & (start <= now + MAX_AHEAD) & (now - start <= MAX_AGE)), "bad_fields")
        .when(kind("saleValue").isNotNull() & no(is_number("saleValue")), "bad_fields")
        .when((F.length(x.digits(get("dnis", "string"))) < 10) | (F.length(x.digits(get("ani", "string"))) < 10), "bad_fields")
    )


def signed(key: str | None, stamp, body, signature, now, skew: int) -> Column:
    """Whether ``stamp.body`` bears the signature and the stamp is near ``now``."""
    if is_placeholder(key):
        return F.lit(False)
    n = x.number(stamp)
    message = F.concat(stamp.cast("binary"), F.lit(bytearray(b".")), body.cast("binary"))
    return F.coalesce((F.abs(n - now) <= skew) & (F.lower(signature) == x.hmac_sha256(key, message)), F.lit(False))


def mappings(numbers: DataFrame) -> DataFrame:
    """``dnis`` and its mapping; ``valid`` says if each field has its form. Ids may be numbers, seconds may not be quoted."""
    v = F.try_parse_json("value")
    m = numbers.select(F.col("dnis").alias("m_dnis"), F.from_json("value", MAPPING, {"columnNameOfCorruptRecord": "_bad"}).alias("m"), F.schema_of_variant(F.try_variant_get(v, "$.qualifySeconds", "variant")).alias("kind"))
    ok = F.coalesce(F.col("m.creativeId"), F.lit("")).rlike(x.ID)
    for name in ("campaignId", "advertiserId", "eventGroupId", "rokuCreativeId"):
        ok = ok & F.coalesce(F.col(f"m.{name}").rlike(x.ID), F.lit(True))
    ok = ok & F.coalesce(F.col("m.platform").isin("roku", "ua"), F.lit(True))
    number = F.col("kind").rlike(r"\A(BIGINT|DOUBLE|DECIMAL.*)\z") & F.col("m.qualifySeconds").between(0, MAX_QUALIFY)
    ok = ok & (F.col("kind").isNull() | F.coalesce(number, F.lit(False)))
    return m.select("m_dnis", ok.alias("valid"), "m.creativeId", "m.campaignId", "m.advertiserId", "m.platform", "m.qualifySeconds", "m.eventGroupId", "m.rokuCreativeId")


def qualified(duration, mapping_seconds, default: int = 60) -> Column:
    return duration >= F.coalesce(mapping_seconds, F.lit(float(default)))


def received_calls(requests: DataFrame, numbers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Requests with their fields, mapping, and ``outcome``: null if the call goes on to matching."""
    text = F.col("body").cast("string")
    d = requests.withColumn("t", F.col("recv_ts")).withColumn("_rate", F.concat(F.lit("call:"), x.text(F.col("ip"))))
    d = rate_limited(d, "_rate", settings.call_rate_limit).withColumn("c", F.from_json(text, CALL))
    d = d.withColumn("reason", F.when(F.octet_length("body") > MAX_BODY, "too_large").otherwise(call_reason(text, F.col("t"))))
    d = d.join(dimension(mappings(numbers)), F.col("c.dnis") == F.col("m_dnis"), "left")
    auth = signed(settings.call_key, F.col("x_timestamp"), F.col("body"), F.col("x_signature"), F.col("t"), settings.call_skew_seconds)
    outcome = (
        F.when(~F.col("allowed"), "call_rate_limited")
        .when(F.lit(is_placeholder(settings.call_key)), "call_not_configured")
        .when(F.col("reason") == "too_large", "call_bad_request")
        .when(~auth, "call_unauthorized")
        .when(F.col("reason").isNotNull(), "call_bad_request")
        .when(F.col("m_dnis").isNull(), "call_unknown_number")
        .when(~F.col("valid"), "call_bad_number_mapping")
        .when(~qualified(F.col("c.durationSeconds"), F.col("qualifySeconds"), settings.qualify_seconds), "call_not_qualified")
    )
    return d.withColumn("outcome", outcome).drop("_rate", "allowed", "m_dnis")


def claimed_calls(calls: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``is_claimed`` by call and creative. ``sent`` is the result of the send, which the data must hold."""
    key = F.concat(F.lit("call:"), F.hex("callId"), F.lit(":"), F.col("creative_id"), F.lit("|"))
    return claims(calls.withColumn("claim", key), "claim", settings.call_ttl)


#: What tells calls apart that meet the same impressions with the same scores.
MOMENT = ["store_key", "call_ts", "caller_state"]
#: What a call keeps of its best impression, and the order by which it is the best.
BEST = ("ts", "imp_seq", "ip", "rida", "hh_id", "region", "city", "postal", "lmt", "score")
RANK = ("score", "ts", "imp_seq")


def by_second(recent: DataFrame, width: int) -> DataFrame:
    """How many impressions a store has in each second that has some; ``_h`` is the stretch of ``width`` seconds."""
    return recent.groupBy("store_key", F.floor(F.col("ts") / width).alias("_h"), "ts").agg(F.count("*").alias("n"))


def moment_counts(calls: DataFrame, recent: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each moment of ``calls`` with its ``candidates``: the impressions in the closed window before it.

    A window is as long as a stretch, so it starts in one and ends in the next. Running counts over the seconds of a
    stretch say how many impressions stand behind the start and before the end; the two add up. A stretch has as many
    seconds as the window at most, whatever the number of its impressions and calls.
    """
    seconds = settings.match_window_minutes * 60
    width = max(seconds, 1)
    moments = calls.where(F.col("store_key").isNotNull()).select(*MOMENT).distinct()
    start = F.col("call_ts") - seconds
    # Probes of a second come before its impressions (0) or behind them (2).
    probes = F.array(*[F.struct(F.floor(t / width).alias("_h"), t.alias("ts"), F.lit(side).alias("side")) for t, side in ((start, 0), (F.col("call_ts"), 2)) if seconds or side])
    probes = moments.select(*MOMENT, F.explode(probes).alias("p")).select(*MOMENT, "p.*", F.lit(0).cast("bigint").alias("n"))
    held = by_second(recent, width).withColumn("side", F.lit(1))
    along = Window.partitionBy("store_key", "_h").orderBy("ts", "side")
    before = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.when(F.col("side") == 0, whole - before).otherwise(before)
    d = probes.unionByName(held, allowMissingColumns=True).withColumn("inside", inside).where("side <> 1")
    return d.groupBy(*MOMENT).agg(F.sum("inside").alias("candidates"))


def candidate_counts(calls: DataFrame, recent: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``call_seq`` and ``candidates`` of each call that has some, without a row for any pair."""
    return at_moments(calls, moment_counts(calls, recent, settings)).where("candidates > 0").select("call_seq", "candidates")


def at_moments(calls: DataFrame, found: DataFrame) -> DataFrame:
    """``calls`` with what ``found`` has for their moments. Calls without a store meet nothing, and are spread."""
    f = found.select(*[F.col(c).alias(f"_{c}") for c in MOMENT], *[c for c in found.columns if c not in MOMENT])
    store = F.coalesce("store_key", F.concat(F.lit("\0"), F.col("call_seq").cast("string")))
    d = calls.withColumn("_store", store)
    same = (F.col("_store") == F.col("_store_key")) & (F.col("call_ts") == F.col("_call_ts")) & F.col("caller_state").eqNullSafe(F.col("_caller_state"))
    return d.join(f, same, "left").drop("_store", *[f"_{c}" for c in MOMENT])


def scored(pair: dict[str, Column], settings: Settings) -> Column:
    """Score of a call (``candidates``, ``call_ts``, ``caller_state``) with one of its candidates (``ts``, ``region``)."""
    seconds = max(settings.match_window_minutes * 60, 1)
    t = x.recency(pair["call_ts"], pair["ts"], seconds)
    return x.score(x.scarcity(pair["candidates"]), t, x.nearness(pair["region"], pair["caller_state"]), settings.weights)


def best_of_moments(counts: DataFrame, recent: DataFrame, settings: Settings) -> DataFrame:
    """``counts`` with ``best``, null where there are no candidates or more than the ceiling.

    A moment first meets the seconds of its two stretches, then the impressions of the seconds in its window: pairs are
    at most the ceiling for each moment, however many impressions its store has outside the window.
    """
    seconds = settings.match_window_minutes * 60
    width = max(seconds, 1)
    few = F.col("candidates").between(1, settings.candidate_ceiling)
    touched = F.sequence(F.floor((F.col("call_ts") - seconds) / width), F.floor(F.col("call_ts") / width))
    c = counts.withColumn("_h", F.explode_outer(F.when(few, touched)))
    held = by_second(recent, width).select(F.col("store_key").alias("_s"), F.col("_h").alias("_g"), F.col("ts").alias("_ts"))
    near = (F.col("store_key") == F.col("_s")) & (F.col("_h") == F.col("_g")) & F.col("_ts").between(F.col("call_ts") - seconds, F.col("call_ts"))
    # A moment without any second keeps one row, under a store that is its own.
    c = c.join(held, near, "left").withColumn("_at", F.coalesce("_s", F.concat(F.lit("\0"), "store_key", F.col("call_ts").cast("string")))).drop("_s", "_g", "_h")
    r = recent.withColumnRenamed("seq", "imp_seq").withColumnRenamed("store_key", "_s")
    pairs = c.join(r, (F.col("_at") == F.col("_s")) & (F.col("_ts") == F.col("ts")), "left")
    pairs = pairs.withColumn("score", scored({n: F.col(n) for n in ("candidates", "call_ts", "caller_state", "ts", "region")}, settings))
    best = F.max_by(F.struct(*BEST), F.when(F.col("imp_seq").isNotNull(), F.struct(*RANK)))
    return pairs.groupBy(*MOMENT).agg(F.first("candidates").alias("candidates"), best.alias("best"))


def decided(d: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``confidence``, ``gate``, ``matched`` and ``device_ids`` to calls with ``candidates`` and ``best``."""
    d = d.withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("bigint")).withColumn("score", F.col("best.score"))
    d = d.withColumn("confidence", F.when(F.col("best").isNull(), F.lit(0.0)).otherwise(x.four_places("score")))
    gate = x.gate(F.col("candidates"), F.col("confidence"), settings.max_candidates, settings.min_confidence)
    d = d.withColumn("gate", F.when(F.col("candidates") > settings.candidate_ceiling, "too_many_candidates").otherwise(gate))
    return d.withColumn("matched", F.col("candidates") > 0).withColumn("device_ids", F.col("gate") == "ok").drop("score")


def matched(calls: DataFrame, recent: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Best impression of each call, confidence and gate.

    ``calls``: ``call_seq``, ``store_key``, ``call_ts``, ``caller_state`` and others, which stay. ``recent``: see
    ``schemas.RECENT``. Candidates lie in the closed window before the call. They are counted first, and only calls
    with at most as many as the ceiling meet their candidates; with more, nothing is scored. Calls of one store, second
    and state are matched once. Calls without a store have no candidates.
    """
    counts = moment_counts(calls, recent, settings)
    return decided(at_moments(calls, best_of_moments(counts, recent, settings)), settings)


def caller_states(calls: DataFrame, area_codes: DataFrame, ani: str = "ani") -> DataFrame:
    """Adds ``caller_state``. ``area_codes``: ``area_code``, ``state``."""
    a = area_codes.select(F.col("area_code").alias("_a"), F.col("state").alias("_s"))
    return calls.join(dimension(a), x.area_code(F.col(ani)) == F.col("_a"), "left").withColumn("caller_state", x.text(F.col("_s"))).drop("_a", "_s")


def call_outcome(is_claimed, live, is_skipped, sent) -> Column:
    return F.when(~is_claimed, "call_duplicate").when(is_skipped, "call_skipped").when(~sent, "call_capi_error").when(live, "call_fired").otherwise("call_dry_run")


def with_store_key(calls: DataFrame) -> DataFrame:
    return calls.withColumn("store_key", store_key(F.col("rokuCreativeId"), F.col("creativeId")))


def concluded(requests: DataFrame, numbers: DataFrame, recent: DataFrame, area_codes: DataFrame, settings: Settings = Settings(), endpoint: str | None = None) -> DataFrame:
    """Each call request with its one ``outcome``, from the request over the claim and the match to the send.

    ``requests``: see ``schemas.CALL_REQUEST``; a Boolean column ``sent`` holds what became of each send (without it
    all succeed). Only calls that got their claim are matched; a skipped or failed send gives the claim back. A request
    without a time is ``call_internal_error``.
    """
    if "sent" not in requests.columns:
        requests = requests.withColumn("sent", F.lit(True))
    d = with_store_key(received_calls(requests, numbers, settings))
    platform = F.coalesce("platform", F.lit("roku"))
    is_skipped = F.lit(False)
    for name in ("roku", "ua"):
        is_skipped = F.when(platform == name, F.lit(skipped(name, settings, settings.send_key, endpoint) is not None)).otherwise(is_skipped)
    d = d.withColumns({"platform": platform, "is_skipped": is_skipped, "delivered": F.coalesce("sent", F.lit(False)), "call_seq": F.col("seq")})
    d = d.withColumns({"callId": F.col("c.callId"), "ani": F.col("c.ani"), "creative_id": F.col("creativeId"), "call_ts": F.floor("c.startTime").cast("bigint")})
    key = F.concat(F.lit("call:"), F.hex("callId"), F.lit(":"), F.col("creative_id"), F.lit("|"))
    d = d.withColumn("claim", F.when(F.col("outcome").isNull(), key)).withColumn("sent", F.col("delivered") & ~F.col("is_skipped"))
    failed = F.when(F.col("t").isNull(), "call_internal_error")
    d = d.withColumns({"outcome": F.coalesce(failed, "outcome"), "claim": F.when(failed.isNull(), F.col("claim"))})
    # Read for the claims, the moments of the calls and the calls: what comes before runs once.
    d = claims(written(d, "requests"), "claim", settings.call_ttl)
    goes_on = F.col("outcome").isNull() & F.col("is_claimed")
    d = written(caller_states(d, area_codes).withColumn("store_key", F.when(goes_on, F.col("store_key"))), "claimed")
    d = matched(d, recent, settings)
    end = call_outcome(F.col("is_claimed"), F.lit(settings.live), F.col("is_skipped"), F.col("delivered"))
    d = d.withColumns({"start_time": F.col("call_ts"), "duration": F.col("c.durationSeconds"), "sale_value": F.col("c.saleValue"), "currency": F.col("c.currency"), "event_group_id": F.col("eventGroupId")})
    return d.withColumn("outcome", F.coalesce("outcome", end)).drop("claim", "sent", "delivered", "is_claimed")


def call_ledger(outcomes: DataFrame) -> DataFrame:
    """One ledger row for each call; its campaign is the mapping's once the call is known to be valid."""
    known = ~F.col("outcome").isin(*BEFORE_MAPPING)
    return ledger_rows(outcomes, F.when(known, F.col("campaignId")), F.col("outcome"))
