"""Read one written timestamp in any of the forms people and programs use."""

from __future__ import annotations

import re
from calendar import monthrange
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError
from datetime import datetime, timedelta, timezone

# Month names in English, German, French and Spanish, in calendar order; a prefix of three letters or more is enough where it is unambiguous.
MONTHS = [
    "january januar janvier enero jänner", "february februar février fevrier febrero", "march märz mars marzo maerz mrz", "april avril abril", "may mai mayo", "june juni juin junio",
    "july juli juillet julio", "august août aout agosto", "september septembre septiembre setiembre", "october oktober octobre octubre", "november novembre noviembre", "december dezember décembre decembre diciembre",
]
# Offsets in minutes of abbreviations that mail headers use when the zone of the source doesn't know them.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "CET": 60, "CEST": 120, "BST": 60, "IST": 330, "AEST": 600, "AEDT": 660}

_BY_PREFIX: dict[str, int | None] = {}
for _n, _names in enumerate(MONTHS, 1):
    for _name in _names.split():
        for _k in range(3, len(_name) + 1):
            _BY_PREFIX[_name[:_k]] = _n if _BY_PREFIX.get(_name[:_k], _n) == _n else None

_ZONE = r"(?P<zone>Z|UTC|GMT|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?(?::?\d{2})?)?"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?: ?(?P<ap>[AaPp])\.? ?[Mm]\.?(?![a-z]))?(?: ?(?:Uhr|h|hrs))?"
_TAIL = rf"(?:(?:,? ?(?:-|at|à|um|a las)? ?|T|t){_TIME} ?{_ZONE})? ?(?:\[(?P<iana>[A-Za-z0-9_+/-]+)\])?"
_FORMS = [
    re.compile(rf"(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}}){_TAIL}"),
    re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[T ]?(?P<h>\d{{2}}):?(?P<mi>\d{{2}})(?::?(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)? ?{_ZONE})? ?(?:\[(?P<iana>[A-Za-z0-9_+/-]+)\])?"),
    re.compile(rf"(?P<d>\d{{1,2}})[-/.](?P<m>\d{{1,2}})[-/.](?P<y>\d{{4}}|\d{{2}}){_TAIL}"),
    re.compile(rf"(?:[^\W\d]+\.?,? )?(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er)?(?: |-)(?:de )?(?P<mon>[^\W\d]{{3,}})\.?,?(?: |-)(?:de )?(?P<y>\d{{4}}|\d{{2}}){_TAIL}"),
    re.compile(rf"(?:[^\W\d]+\.?,? )?(?P<mon>[^\W\d]{{3,}})\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y>\d{{4}}){_TAIL}"),
    re.compile(rf"(?:[^\W\d]+\.?,? )?(?P<mon>[^\W\d]{{3,}}) +(?P<d>\d{{1,2}}) {_TIME} {_ZONE} ?(?P<y>\d{{4}})"),
]
_EPOCH = re.compile(r"-?\d{9,19}")
_SPACES = re.compile(r"[\s   ]+")
#: Digits of a number of seconds, milliseconds, microseconds or nanoseconds since 1970, and what one is in microseconds.
_UNITS = ((10, 1_000_000, 1), (13, 1_000, 1), (16, 1, 1), (19, 1, 1_000))
_MIDNIGHT = datetime(1970, 1, 1)


@lru_cache(256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


@lru_cache(4096)
def _abbreviated(name: str, zone: str, year: int) -> timedelta | None:
    """The offset that an abbreviation stands for in a zone, in the year or else in general."""
    z = _zone(zone)
    for month in range(1, 13) if z else ():
        at = datetime(year, month, 15, tzinfo=z)
        if at.tzname() == name:
            return at.utcoffset()
    return timedelta(minutes=ABBREVIATIONS[name]) if name in ABBREVIATIONS else None


def read_instant(raw: str | None, zone: str | None = None) -> int | None:
    """Microseconds since 1970-01-01 UTC, or None where raw is no readable stamp.

    Day precedes month where both are numbers and the year is not first. A stamp without zone is
    local to `zone` (UTC where that is missing or unknown). A local time that occurs twice is the
    earlier instant; one that never occurs is read with the offset in force just before the change.
    """
    if raw is None:
        return None
    text = _SPACES.sub(" ", raw).strip().replace("−", "-")
    if not text:
        return None
    if _EPOCH.fullmatch(text):
        digits = len(text.lstrip("-"))
        for most, times, per in _UNITS:
            if digits in (most - 1, most):
                return int(text) * times // per
    for form in _FORMS:
        m = form.fullmatch(text)
        if m:
            try:
                return _instant(m.groupdict(), zone or "UTC")
            except (ValueError, OverflowError):
                return None
    return None


def _instant(g: dict, zone: str) -> int | None:
    year = int(g["y"])
    if len(g["y"]) == 2:
        year += 1900 if year >= 69 else 2000
    month = int(g["m"]) if g.get("m") else _BY_PREFIX.get(g["mon"].lower())
    day = int(g["d"])
    if not month or not 1 <= month <= 12 or year < 1 or not 1 <= day <= monthrange(year, month)[1]:
        return None
    hour, minute, second = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["ap"] in "pP")
    if hour > 23 or minute > 59 or second > 59:
        return None
    local = datetime(year, month, day, hour, minute, second)
    if not (offset := _offset(local, g.get("zone"), g.get("iana"), zone, year)) and offset is None:
        return None
    return (local - offset - _MIDNIGHT) // timedelta(microseconds=1) + int(((g.get("f") or "") + "000000")[:6])


def _offset(local: datetime, written: str | None, iana: str | None, zone: str, year: int) -> timedelta | None:
    if written:
        digits = re.search(r"([+-])(\d{1,2}):?(\d{2})?:?(\d{2})?", written)
        if digits:
            sign, h, m, s = digits.groups()
            if int(h) > 18 or int(m or 0) > 59:
                return None
            return (1 if sign == "+" else -1) * timedelta(hours=int(h), minutes=int(m or 0), seconds=int(s or 0))
        name, z = written.upper(), _zone(iana or zone)
        for fold in (0, 1) if z else ():
            at = local.replace(tzinfo=z, fold=fold)
            if at.tzname() == name:
                return at.utcoffset()
        return _abbreviated(name, iana or zone, year)
    z = _zone(iana or zone) or timezone.utc
    return local.replace(tzinfo=z).utcoffset()
