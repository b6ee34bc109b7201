import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from tallymark import config
from tallymark.functions import expressions as x
from tallymark.operators import attribution


def evaluate(spark, rows, **columns):
    df = spark.createDataFrame(rows, "v string, w string")
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


@pytest.mark.parametrize(
    ("value", "e164", "area"),
    [("+1 (415) 555-0142", "+14155550142", "415"), ("0044 20 7946 0958", "+442079460958", "442"), ("4155550142", "+14155550142", "415"), ("12", "+12", ""), ("1999", "+1999", "199"), ("", "", "")],
)
def test_phones(spark, value, e164, area):
    assert evaluate(spark, [(value, "")], a=x.e164(F.col("v")), b=x.area_code(F.col("v"))) == [(e164, area)]


def test_phone_hash_is_that_of_the_printed_number(spark):
    got = evaluate(spark, [("+1 (415) 555-0142", "")], h=x.phone_hash(F.col("v")))[0][0]
    assert got == hashlib.sha256(b"+14155550142").hexdigest() and got.startswith("abbf04d6") and got.endswith("f135")


@pytest.mark.parametrize(("value", "ok"), [("203.0.113.7", True), ("0.0.0.0", False), ("256.1.1.1", False), ("01.2.3.4", False), ("1.2.3.4\n", False), ("[[[DEVICE_IP]]]", False), ("", False)])
def test_ipv4(spark, value, ok):
    assert evaluate(spark, [(value, "")], a=x.usable_ipv4(F.col("v"))) == [(ok,)]


@pytest.mark.parametrize(
    ("value", "ok"),
    [("device-1", True), ("00000000-0000-0000-0000-000000000000", False), ("FFFFFFFF-FFFF-FFFF-FFFF-FFFFFFFFFFFF", False), ("ffffffff", False), ("${IDA}", False), ("%%RIDA%%", False), ("##RIDA##", False), ("<IDA>", False), ("[IFA]", False), ("N/A", False), ("-", False), ("a", True)],
)
def test_ad_ids(spark, value, ok):
    assert evaluate(spark, [(value, "")], a=x.usable_ad_id(F.col("v"))) == [(ok,)]


@pytest.mark.parametrize(("value", "limits"), [("1", True), ("YES", True), ("0", False), ("no", False), ("", False), ("[LMT]", True), ("maybe", True)])
def test_tracking_limits(spark, value, limits):
    assert evaluate(spark, [(value, "")], a=x.limits_tracking(F.col("v"), F.lit(False)), b=x.limits_tracking(F.col("v"), F.lit(True))) == [(limits, True)]


def test_parameters(spark):
    q = "a=1&b=x+y%21&a=2&c=%zz%21&d=[[[DEVICE_IP]]]&e=%20t%20&f=a+b%2B&dma501&camp%5Fid=k%3D1&&x"
    got = evaluate(spark, [(q, "")], a=x.param(F.col("v"), "a"), b=x.param(F.col("v"), "b"), c=x.param(F.col("v"), "c"), d=x.param(F.col("v"), "d"), e=x.param(F.col("v"), "e"), f=x.raw_param(F.col("v"), "f"), g=x.raw_param(F.col("v"), "c"), h=x.param(F.col("v"), "none"), i=x.market_area(x.plain_keys(F.col("v"))), j=x.param(F.col("v"), "camp_id"), k=x.param(F.col("v"), "x"))
    assert got == [("1", "x y!", "%zz!", "[[[DEVICE_IP]]]", "t", "a+b+", "", "", "501", "k=1", "")]


def test_parameters_equal_to_those_taken_apart_one_by_one(spark):
    from urllib.parse import unquote_plus

    r, names = random.Random(9), ["a", "b_c", "dma", "dm"]
    pieces = ["a", "b_c", "b%5Fc", "b_c%", "%61", "dma", "dma501", "dma%35", "dm", "+a", "a+", "", "a%3Db", "%26a", "A"]
    rows = ["&".join(r.choice(pieces) + r.choice(["", "=", "=1", "=x%20y", "==", "=é", "=%41+b"]) for _ in range(r.randrange(7))) for _ in range(800)]

    def first(q, name):
        pairs = [(unquote_plus(k), unquote_plus(v).strip()) for k, _, v in (p.partition("=") for p in q.split("&") if p)]
        return next((v for k, v in pairs if k == name), "")

    got = evaluate(spark, [(q, "") for q in rows], **{n: x.plain_param(x.plain_keys(F.col("v")), n) for n in names})
    assert got == [tuple(first(q, n) for n in names) for q in rows]


NUMBERS = [
    ("1767225600", 1767225600.0, "1767225600"), ("01767225600.0", 1767225600.0, "1767225600"), ("1767225600d", None, None), ("1767225600f", None, None), ("1767225600L", None, None),
    ("1767225600.5", 1767225600.5, "1767225600.5"), ("1767225600.", 1767225600.0, "1767225600"), ("1.7672256e9", 1767225600.0, "1767225600"), ("+1767225600", 1767225600.0, "1767225600"),
    (" 1767225600\t", 1767225600.0, "1767225600"), ("1_767_225_600", None, None), ("1,5", None, None), ("Infinity", None, None), ("-Infinity", None, None), ("NaN", None, None), ("1e400", None, None),
    ("0x69554200", 1767195136.0, "1767195136"), ("0X69554200", 1767195136.0, "1767195136"), ("-0x1", None, None), ("0x", None, None), ("0xg", None, None), ("0b101", 5.0, "5"), ("0o17", 15.0, "15"), ("0o8", None, None),
    (".5", 0.5, "0.5"), ("5.", 5.0, "5"), (".", None, None), ("e5", None, None), ("-3.25", -3.25, "-3.25"), ("123456789012345678901", 123456789012345680000.0, "123456789012345680000"), ("1e21", 1e21, "1e+21"), ("1.5e300", 1.5e300, "1.5e+300"),
    ("12345678901234567890123", 1.2345678901234568e22, "1.2345678901234568e+22"), ("1e20", 1e20, "100000000000000000000"), ("0.1", 0.1, "0.1"), ("soon", None, None),
]


def test_numbers_as_text(spark):
    got = evaluate(spark, [(v, "") for v, _, _ in NUMBERS], n=x.number(F.col("v")), t=x.number_text(x.number(F.col("v"))))
    assert got == [(n, t) for _, n, t in NUMBERS]


@pytest.mark.parametrize("key", ["k", "a much longer key than one block of sixty-four bytes, which is therefore hashed first"])
def test_keyed_digest(spark, key):
    got = evaluate(spark, [("adv|camp|cre|1", "é")], a=x.hmac_sha256(key, F.col("v")), b=x.hmac_sha256(key, F.col("w")))
    assert got == [(hmac.new(key.encode(), b"adv|camp|cre|1", "sha256").hexdigest(), hmac.new(key.encode(), "é".encode(), "sha256").hexdigest())]


def test_tag_verdicts(spark):
    sig = lambda exp: hmac.new(b"secret", f"a|c|r|{exp}".encode(), "sha256").hexdigest()
    verdict = lambda key: x.tag_verdict(key, F.lit("a"), F.lit("c"), F.lit("r"), F.col("v"), F.col("w"), F.lit(1000))
    rows = [("2000", sig(2000)), ("2000", sig(2000).upper()), ("02000", sig(2000)), ("2000", sig(2001)), ("2000", ""), ("999", sig(999)), ("999", "bad"), ("soon", sig("soon")), ("", sig(0)), ("nan", sig(2000)), ("Infinity", sig(2000))]
    assert [r[0] for r in evaluate(spark, rows, a=verdict("secret"))] == [None, None, None, "bad_signature", "bad_signature", "expired", "expired", *["expired"] * 4]
    assert evaluate(spark, rows[:1], a=verdict("1" * 64)) == [("not_configured",)]


def test_signed_tags_pass_verification(spark):
    tag = x.signed_tag("secret", F.lit("a"), F.lit("c"), F.lit("r"), F.lit(2000), "roku")
    q = spark.range(1).select(tag.alias("q"))
    got = q.select("q", x.tag_verdict("secret", *[x.param(F.col("q"), n) for n in ("advertiser_id", "campaign_id", "creative_id", "exp", "sig")], F.lit(1000)).alias("v"), x.param(F.col("q"), "device_ip").alias("ip")).first()
    assert got.v is None and got.ip == "[[[DEVICE_IP]]]" and got.q.endswith("dma=[[[METRO_CODE]]]")


def test_boundaries(spark):
    rows = [("2026-10-01", ""), ("2026-12-31T10:00:00Z", ""), ("soon", "")]
    assert evaluate(spark, rows, a=x.boundary(F.col("v"), False), b=x.boundary(F.col("v"), True)) == [(1790812800, 1790899199), (1798711200, 1798711200), (None, None)]


def test_seconds_do_not_depend_on_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        d = spark.range(1).select(F.lit("2024-07-01 12:34:56").cast("timestamp_ntz").alias("ts"), F.lit("2024-07-01").alias("v"))
        got = d.select(x.second_of(F.col("ts")), x.at_second(x.second_of(F.col("ts"))) == F.col("ts"), x.boundary(F.col("v"), True), x.boundary(F.lit("2024-07-01T00:00:00+02:00"), True)).first()
        assert tuple(got) == (1719837296, True, 1719878399, 1719784800)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_four_places_follow_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    r = random.Random(1)
    values = [0.95975, 0.6, 0.60005, 1.0, 0.04, *(0.5 / r.choice([1, 1.5, 2, 3]) + 0.3 * r.randrange(3601) / 3600 + 0.2 * r.choice([0.2, 0.5, 0.8, 1]) for _ in range(3000))]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert [q[0] for q in df.select(x.four_places("s")).collect()] == [float(Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in values]


def test_scores_and_gates(spark):
    d = spark.range(1)
    row = d.select(
        x.scarcity(F.lit(1)), x.scarcity(F.lit(3)), x.recency(F.lit(10_000), F.lit(9_940), 3600), x.recency(F.lit(10_000), F.lit(10_050), 3600), x.recency(F.lit(10_000), F.lit(6_399), 3600),
        x.nearness(F.lit("TEXAS"), F.lit("Texas")), x.nearness(F.lit("Texas"), F.lit("")), x.nearness(F.lit("Texas"), F.lit("Ohio")),
        x.gate(F.lit(0), F.lit(0.9), 10, 0.6), x.gate(F.lit(10), F.lit(0.6), 10, 0.6), x.gate(F.lit(11), F.lit(0.6), 10, 0.6), x.gate(F.lit(1), F.lit(0.59), 10, 0.6),
    ).first()
    assert tuple(row)[:8] == pytest.approx((1.0, 0.5, 1 - 60 / 3600, 1.0, 0.0, 0.8, 0.5, 0.2))
    assert tuple(row)[8:] == ("no_match", "ok", "too_many_candidates", "low_confidence")


CALL = '{"callId": "c1", "dnis": "+18005550100", "ani": "4155550142", "startTime": 1000, "durationSeconds": 75'


@pytest.mark.parametrize(
    ("body", "reason"),
    [
        (CALL + "}", None), ("{", "bad_json"), ("5", "bad_json"), ("null", "bad_json"), ("[]", "missing_fields"), ('{"callId": "x"}', "missing_fields"), (CALL.replace('"c1"', "7") + "}", "missing_fields"),
        (CALL.replace("c1", "c" * 129) + "}", "bad_fields"), (CALL.replace("75", '"75"') + "}", "bad_fields"), (CALL.replace("75", "-1") + "}", "bad_fields"), (CALL.replace("1000", "1301") + "}", "bad_fields"),
        (CALL.replace("1000", "-86000") + "}", "bad_fields"), (CALL + ', "saleValue": "9"}', "bad_fields"), (CALL + ', "saleValue": 9.5}', None), (CALL.replace("4155550142", "415") + "}", "bad_fields"), (CALL.replace("75", "75.5") + "}", None),
    ],
)
def test_call_reasons(spark, body, reason):
    assert evaluate(spark, [(body, "")], a=attribution.call_reason(F.col("v"), F.lit(1000))) == [(reason,)]


def test_number_mappings(spark):
    rows = [("1", '{"creativeId": "a"}'), ("2", '{"creativeId": 12, "qualifySeconds": 0}'), ("3", '{"creativeId": "a", "qualifySeconds": "5"}'), ("4", '{"creativeId": "a b"}'), ("5", '{"creativeId": "a", "platform": "tv"}'), ("6", '{"creativeId": "a", "qualifySeconds": 86401}'), ("7", "{")]
    got = {r.m_dnis: r.valid for r in attribution.mappings(spark.createDataFrame(rows, "dnis string, value string")).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": False, "6": False, "7": False}


def test_arguments():
    assert config.report_days(float("nan")) == 7 and config.report_days(0) == 7 and config.report_days(200) == 90 and config.report_hours(2.9) == 2 and config.report_days(-3) == 1
    assert config.config_int(" ", 5) == 5 and config.config_int("x", 5) == 5 and config.config_int("7.9", 5) == 7 and config.config_int("-1", 5) == 5
    assert config.config_float("2", 0.5, 0, 1) == 1 and config.config_float("", 0.5, 0, 1) == 0.5
    assert config.is_placeholder("  ") and config.is_placeholder("0" * 64) and not config.is_placeholder("s3cret")
    assert config.checked_literal("camp-1") == "camp-1" and config.checked_literal(2.7) == 2
    for bad in (lambda: config.checked_literal("a'; --"), lambda: config.checked_literal(float("inf")), lambda: config.checked_id("a b"), lambda: config.checked_date("2024-02-01", "2024-01-31"), lambda: config.checked_date("x", "2024")):
        with pytest.raises(ValueError):
            bad()
    assert config.checked_date("2024-01-31", "2024-01-31") == ("2024-01-31", True)
