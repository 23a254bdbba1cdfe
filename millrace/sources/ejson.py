"""JSON lines that keep Python's types: values JSON doesn't know are tagged."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re
from typing import Any

#: The tags: fixed parts of the format.
TAGS = {"decimal": "type{decimal}", "time": "type{time}", "datetime": "type{datetime}", "date": "type{date}", "duration": "type{duration}", "set": "type{set}"}


def _encode(v: Any) -> Any:
    if isinstance(v, decimal.Decimal):
        return {TAGS["decimal"]: str(v)}
    if isinstance(v, dt.datetime):
        offset = v.utcoffset()
        return {TAGS["datetime"]: [v.replace(tzinfo=None).isoformat(), None if offset is None else offset.seconds, v.tzname()]}
    if isinstance(v, dt.date):
        return {TAGS["date"]: v.isoformat()}
    if isinstance(v, dt.time):
        return {TAGS["time"]: v.isoformat()}
    if isinstance(v, dt.timedelta):
        return {TAGS["duration"]: duration_text(v)}
    if isinstance(v, (set, frozenset)):
        return {TAGS["set"]: sorted(v, key=str)}
    raise TypeError(f"{type(v).__name__} has no JSON form")


def _datetime(text: str, offset: int | None, zone: str | None) -> dt.datetime:
    """A datetime from its local time, its zone's offset in seconds (counted up to a day) and the zone's name."""
    found = dt.datetime.fromisoformat(text)
    if zone is None or offset is None:
        return found
    shift = dt.timedelta(seconds=offset if offset <= 50_400 else offset - 86_400)  # no zone is more than 14 hours ahead
    return found.replace(tzinfo=dt.timezone(shift, zone))


def duration_text(v: dt.timedelta) -> str:
    """A duration by ISO 8601, in days and seconds."""
    sign, v = ("-", -v) if v < dt.timedelta(0) else ("", v)
    hours, rest = divmod(v.seconds, 3600)
    minutes, seconds = divmod(rest, 60)
    part = f"{seconds}.{v.microseconds:06}".rstrip("0") if v.microseconds else str(seconds)
    clock = "".join(f"{n}{x}" for n, x in ((hours, "H"), (minutes, "M"), (part, "S")) if n not in (0, "0"))
    days = f"{v.days}D" if v.days else ""
    return f"{sign}P{days}{'T' + clock if clock else ''}" if days or clock else "P0D"


def duration(text: str) -> dt.timedelta:
    """The duration that an ISO 8601 text names; one of months or years has no length and is an error."""
    m = re.fullmatch(r"([+-]?)P(?:([\d.]+)W)?(?:([\d.]+)D)?(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)?", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    weeks, days, hours, minutes, seconds = (float(x or 0) for x in m.groups()[1:])
    found = dt.timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=seconds)
    return -found if m[1] == "-" else found


_DECODERS = {
    TAGS["decimal"]: decimal.Decimal,
    TAGS["datetime"]: lambda v: _datetime(*v),
    TAGS["date"]: dt.date.fromisoformat,
    TAGS["time"]: dt.time.fromisoformat,
    TAGS["duration"]: lambda s: duration(s),
    TAGS["set"]: set,
}


def _decode(d: dict) -> Any:
    if len(d) == 1:
        tag, value = next(iter(d.items()))
        if tag in _DECODERS:
            try:
                return _DECODERS[tag](value)
            except (ValueError, TypeError, ArithmeticError):  # not ours: the object as it is
                return d
    return d


def dumps(value: Any, **options: Any) -> str:
    return json.dumps(value, default=_encode, ensure_ascii=False, **options)


def loads(text: str) -> Any:
    return json.loads(text, object_hook=_decode)
