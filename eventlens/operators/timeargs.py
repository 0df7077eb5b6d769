"""Time arguments, resolved on the driver: absolute, date, time, now, today, yesterday, tomorrow, relative, anchored."""

from __future__ import annotations

import re
from datetime import UTC, datetime, time, timedelta
from zoneinfo import ZoneInfo

_UNITS = {"ms": 1e-3, "s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}


def seconds(text: str) -> float:
    """Seconds of 1h30m, 90s, 2 days."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*(ms|weeks?|w|days?|d|hours?|h|min(?:utes?)?|m|sec(?:onds?)?|s)", text.strip())
    if not parts or re.sub(r"(\d+(?:\.\d+)?)\s*(ms|weeks?|w|days?|d|hours?|h|min(?:utes?)?|m|sec(?:onds?)?|s)", "", text).strip():
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * _UNITS[u if u in _UNITS else u.rstrip("s") if u.rstrip("s") in _UNITS else u[0]] for n, u in parts)


def resolve(text: str, now: datetime, tz: str = "UTC", since: datetime | None = None, until: datetime | None = None) -> datetime:
    """The instant a time argument names. Unsigned relative times are in the past; anchors are since, until and now."""
    s, zone = text.strip(), ZoneInfo(tz)
    low = s.lower()
    if m := re.fullmatch(r"(since|until|now)([+-])(.+)", low):
        anchor = {"since": since, "until": until, "now": now}[m[1]]
        if anchor is None:
            raise ValueError(f"{m[1]} has no time to be an anchor")
        delta = timedelta(seconds=seconds(m[3]))
        return anchor + delta if m[2] == "+" else anchor - delta
    today = datetime.combine(now.astimezone(zone).date(), time(), zone)
    names = {"now": now, "today": today, "yesterday": today - timedelta(days=1), "tomorrow": today + timedelta(days=1)}
    if low in names:
        return names[low].astimezone(UTC)
    if m := re.fullmatch(r"([+-]?)\s*(\d.*?[a-z])(?:\s+ago)?", low):
        try:
            delta = timedelta(seconds=seconds(m[2]))
            return now + delta if m[1] == "+" else now - delta
        except ValueError:
            pass
    if re.fullmatch(r"\d{1,2}:\d{2}(:\d{2})?", s):
        return datetime.combine(today.date(), time.fromisoformat(s.zfill(8 if s.count(":") == 2 else 5)), zone).astimezone(UTC)
    if re.fullmatch(r"\d{10,19}", s):
        return datetime.fromtimestamp(int(s) / 10 ** (len(s) - 10), UTC)
    at = datetime.fromisoformat(s.replace("Z", "+00:00"))
    return (at if at.tzinfo else at.replace(tzinfo=zone)).astimezone(UTC)


def resolve_range(since: str | None, until: str | None, now: datetime, tz: str = "UTC") -> tuple[datetime | None, datetime | None]:
    """Both ends; one may be anchored to the other."""
    if since and until and re.match(r"(?i)since[+-]", until.strip()):
        a = resolve(since, now, tz)
        return a, resolve(until, now, tz, since=a)
    b = resolve(until, now, tz) if until else None
    return (resolve(since, now, tz, until=b) if since else None), b
