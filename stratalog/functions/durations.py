"""Durations such as "5m" or "30 seconds"."""

from __future__ import annotations

import re

_UNITS = {
    "second": ("s", "sec", "secs", "second", "seconds"),
    "minute": ("m", "min", "mins", "minute", "minutes"),
    "hour": ("h", "hour", "hours"),
    "day": ("d", "day", "days"),
}
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_FACTOR = {name: _SECONDS[unit] for unit, names in _UNITS.items() for name in names}


def parse_duration(text: str) -> int:
    """Seconds of one or more number-unit pairs; anything else, trailing text too, is an error."""
    parts = re.findall(r"(\d+)\s*([A-Za-z]+)\s*", text)
    if not parts or "".join(f"{n}{u}" for n, u in parts) != re.sub(r"\s+", "", text):
        raise ValueError(f"Invalid duration: {text!r}")
    try:
        return sum(int(n) * _FACTOR[u.lower()] for n, u in parts)
    except KeyError as e:
        raise ValueError(f"Unknown time unit {e.args[0]!r} in {text!r}") from None


def positive_duration(text: str, name: str) -> int:
    seconds = parse_duration(text)
    if seconds <= 0:
        raise ValueError(f"{name} must be positive, got {text!r}")
    return seconds
