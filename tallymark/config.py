"""Settings and the checks of arguments that come from people."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

#: Documented placeholders that count as no secret.
PLACEHOLDERS = frozenset(
    [
        "0000000000000000000000000000000000000000000000000000000000000000",
        "1111111111111111111111111111111111111111111111111111111111111111",
        "2222222222222222222222222222222222222222222222222222222222222222",
        "3333333333333333333333333333333333333333333333333333333333333333",
        "your-analytics-read-token",
        "your-cloudflare-account-id",
        "REPLACE_WITH_EVENT_GROUP_ID",
    ]
)
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
ID = re.compile(r"[A-Za-z0-9_-]{1,64}")
LITERAL = re.compile(r"[A-Za-z0-9_.:@ -]*")


def is_placeholder(secret: str | None) -> bool:
    return secret is None or not secret.strip() or secret.strip() in PLACEHOLDERS


def config_int(value: str | None, fallback: int, least: int = 0) -> int:
    """A whole number from a setting; blank, unreadable or too small ones give the fallback."""
    try:
        n = float(value) if value and value.strip() else math.nan
    except ValueError:
        n = math.nan
    return math.floor(n) if math.isfinite(n) and n >= least else fallback


def config_float(value: str | None, fallback: float, low: float, high: float) -> float:
    try:
        n = float(value) if value and value.strip() else math.nan
    except ValueError:
        n = math.nan
    return min(high, max(low, n)) if math.isfinite(n) else fallback


def clamped(value: float | None, default: int, low: int, high: int) -> int:
    """A report's argument: 0 and what is no number give the default."""
    if not value or math.isnan(value):
        return default
    return min(high, max(low, math.floor(value)))


def report_days(value: float | None, default: int = 7) -> int:
    return clamped(value, default, 1, 90)


def report_hours(value: float | None, default: int = 24) -> int:
    return clamped(value, default, 1, 2160)


def checked_id(value: str) -> str:
    if not ID.fullmatch(value):
        raise ValueError(f"not an id: {value!r}")
    return value


def checked_date(value: str, today: str) -> tuple[str, bool]:
    """The date, and whether its day is not over; later days are refused."""
    if not DATE.fullmatch(value):
        raise ValueError(f"not a date: {value!r}")
    if value > today:
        raise ValueError(f"in the future: {value}")
    return value, value == today


def checked_literal(value: str | float) -> str | int:
    """A value that a report may be asked for; other characters and numbers without end are refused."""
    if isinstance(value, str):
        if not LITERAL.fullmatch(value):
            raise ValueError(f"characters that a report's argument cannot have: {value!r}")
        return value
    if not math.isfinite(value):
        raise ValueError("a report's argument must be finite")
    return math.floor(value)


def export_date(now: datetime) -> str:
    """The day that a nightly run exports: the one before ``now``, in UTC."""
    return (now - timedelta(days=1)).date().isoformat()


@dataclass(frozen=True)
class Settings:
    """What the operators need to know besides the data."""

    enabled: bool = True
    signature_required: bool = False
    signing_key: str | None = None
    hash_salt: str | None = "salt"
    previous_salt: str | None = None
    ip_salt: str | None = None
    call_key: str | None = None
    call_skew_seconds: int = 300
    licensed_markets: tuple[str, ...] = ("US",)
    reject_unknown_market: bool = False
    cap_unattributable: bool = True
    rate_limit: int = 120
    call_rate_limit: int = 60
    dedup_ttl: int = 86_400
    call_ttl: int = 172_800
    match_window_minutes: int = 60
    max_candidates: int = 10
    min_confidence: float = 0.6
    candidate_ceiling: int = 500
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    qualify_seconds: int = 60
    event_name: str = "LEAD"
    event_group_id: str | None = None
    live: bool = False
    send_key: str | None = None
    max_reject_ratio: float = 0.5
    max_alert_ratio: float = 0.01
    max_call_error_ratio: float = 0.5
    max_call_reject_ratio: float = 0.5
    extra: dict = field(default_factory=dict, hash=False, compare=False)
