"""Parsing, validating, hashing, phone and scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.config import is_placeholder

ID = r"\A[A-Za-z0-9_-]{1,64}\z"
APP_ID = r"\A[A-Za-z0-9_.-]{1,128}\z"
TOKEN = r"\A[A-Za-z0-9_-]{1,16}\z"
COUNTRY = r"\A[A-Z]{2}\z"
DMA = r"\A[0-9]{1,5}\z"
HEX = r"\A[0-9a-f]{64}\z"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\A{OCTET}(?:\.{OCTET}){{3}}\z"
#: What stands where a macro was not filled in, and the spellings of yes and no.
NO_VALUES = ("undefined", "null", "nil", "n/a", "na", "nan", "none", "unknown", "false", "-")
#: What counts as white space.
SPACE = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
YES, NO = ("1", "true", "yes", "y"), ("0", "false", "no", "n")


def text(x) -> Column:
    return F.coalesce(x, F.lit(""))


def trimmed(x) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text(x), F.lit(SPACE))


def decoded(x) -> Column:
    """Percent-decoded with ``+`` as a space; a percent sign that leads no two hexadecimal digits stays as it is."""
    whole = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(x.contains("%") | x.contains("+"), F.coalesce(F.try_url_decode(whole), x)).otherwise(x)


def plain_keys(query) -> Column:
    """A query string in which every value is found by ``&key=``: each part starts with ``&`` and has a value. Encoded keys
    are decoded, and one that then holds other characters than those of names is no key; only query strings with an
    encoded key are taken apart."""
    q = text(query)
    key = lambda p: decoded(F.substring_index(p, "=", 1))
    known = lambda p: F.when(key(p).rlike(r"\A[A-Za-z0-9_]*\z"), key(p)).otherwise("-")
    rest = lambda p: F.when(p.contains("="), F.substring(p, F.instr(p, "="), F.length(p))).otherwise("")
    taken_apart = F.concat_ws("&", F.transform(F.split(q, "&"), lambda p: F.concat(known(p), rest(p))))
    whole = F.concat(F.lit("&"), F.when(q.rlike(r"(?:\A|&)[^=&]*[%+]"), taken_apart).otherwise(q))
    return F.regexp_replace(whole, r"&([^=&]*)(?=&|\z)", r"&$1=")


def param(query, name: str) -> Column:
    """One value alone; where many are read, make the keys plain once."""
    return plain_param(plain_keys(query), name)


def plain_param(plain, name: str) -> Column:
    """First value of a key of a query string made by ``plain_keys``, decoded and trimmed; empty if absent. Unfilled macros
    come through as they are."""
    return read(written(plain, name))


def written(plain, name: str) -> Column:
    """A value as it is written. As a column of its own it is looked for once, however often ``read`` names it."""
    return F.regexp_extract(plain, rf"&{name}=([^&]*)", 1)


def read(value) -> Column:
    return trimmed(decoded(value))


def raw_param(query, name: str) -> Column:
    """The first value of a key that is written plainly, with ``+`` kept; empty if it cannot be decoded."""
    x = F.regexp_extract(text(query), rf"(?:\A|&){name}=([^&]*)", 1)
    return trimmed(F.try_url_decode(F.when(~x.rlike("%(?![0-9A-Fa-f]{2})"), F.replace(x, F.lit("+"), F.lit("%2B")))))


def market_area(plain) -> Column:
    """``dma=501``, or the damaged form ``dma501`` as a key."""
    value = plain_param(plain, "dma")
    damaged = F.regexp_extract(plain, r"&dma([0-9]{1,5})=", 1)
    found = F.when(value != "", value).otherwise(damaged)
    return F.when(found.rlike(DMA), found).otherwise("")


def valid_or(x, pattern: str, other: str = "") -> Column:
    return F.when(x.rlike(pattern), x).otherwise(other)


def usable_ipv4(x) -> Column:
    return text(x).rlike(IPV4) & (x != "0.0.0.0")


def usable_ad_id(x) -> Column:
    bare = F.regexp_replace(text(x), "[-: ]", "")
    repeat = bare.rlike(r"\A(.)\1+\z")
    return (text(x) != "") & ~x.rlike(r"[\[\]{}%#<>$]") & ~repeat & ~bare.rlike(r"\A[0-]+\z") & ~F.lower(x).isin(*NO_VALUES)


def limits_tracking(x, child_directed) -> Column:
    """Child directed limits; yes limits; no and absence do not; anything else does."""
    v = F.lower(trimmed(x))
    return F.when(child_directed, True).when(v.isin(*YES), True).when(v.isin(*NO) | (v == ""), False).otherwise(True)


def hashed(salt: str, x) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}|"), x).cast("binary"), 256)


def hmac_sha256(key: str, message) -> Column:
    """Keyed digest in lower-case hexadecimal, from the two padded keys and ``sha2`` alone."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


#: The forms of a number as text, with nothing before or behind.
DECIMAL = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
PREFIXED = r"\A0(?:[xX][0-9A-Fa-f]{1,16}|[oO][0-7]{1,21}|[bB][01]{1,64})\z"


def once(value, then) -> Column:
    """What ``then`` makes of a value, which is worked out once however often that names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def number(x) -> Column:
    """A text as a finite number, or null: decimal with a fraction and exponent, or hexadecimal, octal or binary with its
    prefix, up to 64 bits. White space around it is left out; suffixes and separators make it no number."""

    def of(v) -> Column:
        mark = F.lower(F.substring(v, 2, 1))
        base = F.when(mark == "x", 16).when(mark == "o", 8).otherwise(2)
        return F.when(v.rlike(DECIMAL), v.try_cast("double")).when(v.rlike(PREFIXED), F.call_function("conv", F.substring(v, 3, 64), base, F.lit(10)).cast("double"))

    return once(once(trimmed(x), of), lambda n: F.when(F.abs(n) < float("inf"), n))


def tag_number(x) -> Column:
    """A tag's expiry as a number: empty counts as 0; null if it is no finite number."""
    return F.when(trimmed(x) == "", F.lit(0.0)).otherwise(number(x))


def number_text(number_column) -> Column:
    """A number printed with the fewest digits that tell it from others, without an exponent below 1e21."""

    def of(n) -> Column:
        printed = n.cast("string")
        fraction = F.regexp_replace(printed.try_cast("decimal(38,18)").cast("string"), r"\.?0*\z", "")
        return (
            F.when((n == F.floor(n)) & (F.abs(n) < 1e18), F.floor(n).cast("string"))
            .when(F.abs(n) < 1e20, fraction)
            .when(F.abs(n) < 1e21, printed.try_cast("decimal(38,0)").cast("string"))
            .otherwise(F.regexp_replace(printed, r"(?:\.0)?E", "e+"))
        )

    return once(number_column, of)


def tag_verdict(key: str | None, advertiser, campaign, creative, exp, sig, now) -> Column:
    """Null if the tag's signature holds, else the reason: not_configured, bad_signature or expired.

    An expiry that is missing, unreadable or past is ``expired``, whatever the signature.
    """
    if is_placeholder(key):
        return F.lit("not_configured")

    def of(n) -> Column:
        digest = hmac_sha256(key, F.concat_ws("|", advertiser, campaign, creative, number_text(n)))
        return F.when(sig == "", "bad_signature").when(n.isNull() | (n < now), "expired").when(F.lower(sig) != digest, "bad_signature")

    return once(tag_number(exp), of)


#: The parameters of a tag that the platform fills in when it serves an impression.
MACROS = {
    "roku": {"device_ip": "[[[DEVICE_IP]]]", "dma": "[[[METRO_CODE]]]"},
    "ua": {"ifa": "[IFA]", "lmt": "[LMT]"},
}


def signed_tag(key: str, advertiser, campaign, creative, exp, platform: str) -> Column:
    """The query string of a signed tag, with the platform's macros at its end."""
    sig = hmac_sha256(key, F.concat_ws("|", advertiser, campaign, creative, exp.cast("string")))
    ids = {"advertiser_id": advertiser, "campaign_id": campaign, "creative_id": creative, "exp": exp.cast("string"), "sig": sig}
    parts = [F.concat(F.lit(f"{k}="), v) for k, v in ids.items()]
    return F.concat_ws("&", *parts, F.lit("&".join([f"pf={platform}", *(f"{k}={v}" for k, v in MACROS[platform].items())])))


EPOCH = "1970-01-01 00:00:00"


def at_second(t) -> Column:
    """The time of a second since 1970, without a zone."""
    return F.timestamp_add("SECOND", t, F.lit(EPOCH).cast("timestamp_ntz"))


def second_of(ts) -> Column:
    """The second since 1970 of a time without a zone."""
    return F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def boundary(x, end: bool) -> Column:
    """Seconds of an ISO date or time, in UTC if it names no zone; a bare end date is its last second; null (no bound) if unreadable."""
    bare = x.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    zoned = x.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})\z") & ~bare
    at = F.when(zoned, F.unix_seconds(x.try_cast("timestamp"))).otherwise(second_of(x.try_cast("timestamp_ntz")))
    return F.when(bare, at + (86_399 if end else 0)).otherwise(at)


def digits(x) -> Column:
    return F.regexp_replace(text(x), r"[^0-9]", "")


def phone_digits(x) -> Column:
    return F.regexp_replace(digits(x), r"\A0+", "")


def e164(x) -> Column:
    d = phone_digits(x)
    return F.when(d == "", "").when(F.length(d) == 10, F.concat(F.lit("+1"), d)).otherwise(F.concat(F.lit("+"), d))


def phone_hash(x) -> Column:
    return F.sha2(e164(x).cast("binary"), 256)


def area_code(x) -> Column:
    """The first three digits, after a leading 1 of eleven; empty if there are not three."""
    d = phone_digits(x)
    d = F.when((F.length(d) == 11) & d.startswith("1"), d.substr(2, 10)).otherwise(d)
    return F.when(F.length(d) >= 3, d.substr(1, 3)).otherwise("")


def scarcity(n) -> Column:
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.lit(1.0) / F.log2(n + 1))


def recency(call_ts, ts, window_seconds: int) -> Column:
    age = F.greatest(F.lit(0), call_ts - ts).cast("double")
    return F.when(age > window_seconds, F.lit(0.0)).otherwise(F.lit(1.0) - age / F.lit(float(window_seconds)))


def nearness(region, caller_state, postal=None, caller_postal=None) -> Column:
    postal, caller_postal = (F.lit("") if p is None else text(p) for p in (postal, caller_postal))
    return (
        F.when((caller_postal != "") & (caller_postal == postal), F.lit(1.0))
        .when((text(caller_state) != "") & (F.lower(region) == F.lower(caller_state)), F.lit(0.8))
        .when((text(caller_state) == "") & (caller_postal == ""), F.lit(0.5))
        .otherwise(F.lit(0.2))
    )


def score(s, t, g, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    a, b, c = map(F.lit, weights)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a * s + b * t + c * g))


def four_places(name: str) -> Column:
    """Column ``name`` to four decimal places by its exact binary value, halves up; exact for 2**-7 and above."""
    scaled = f"cast(cast({name} * 1152921504606846976D AS bigint) AS decimal(20,0)) * 20000 + 1152921504606846976"
    return F.expr(f"cast(({scaled}) div 2305843009213693952 AS double) / 10000D")


def gate(n, confidence, max_candidates: int, min_confidence: float) -> Column:
    return F.when(n == 0, "no_match").when(n > max_candidates, "too_many_candidates").when(confidence < min_confidence, "low_confidence").otherwise("ok")
