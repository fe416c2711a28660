"""Times in strptime formats, parsed by column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_FULL_MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
)
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_FIELDS = {
    "Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "H": r"(\d{1,2})", "I": r"(\d{1,2})",
    "M": r"(\d{1,2})", "S": r"(\d{1,2})", "f": r"(\d{1,6})", "p": "(am|pm)", "b": f"({'|'.join(_MONTHS)})",
    "B": f"({'|'.join(_FULL_MONTHS)})",
}
_IGNORED = {"a": f"(?:{'|'.join(d[:3] for d in _DAYS)})", "A": f"(?:{'|'.join(_DAYS)})", "%": "%"}


#: Formats that are tried, in this order, for texts that are not ISO 8601 where none is set.
INFERRED = tuple(f"{d}{t}" for d in ("%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y") for t in ("", " %H:%M:%S", " %H:%M:%S.%f"))


def _layout(fmt: str) -> tuple[str, dict[str, int]]:
    """Java pattern of a format, and the group of each field."""
    pattern, groups, at = "", {}, 0
    for m in re.finditer(r"%(.?)|\s+|.", fmt):
        d = m[1]
        if d is None:
            pattern += r"\s+" if m[0].isspace() else re.escape(m[0])
        elif d in _FIELDS:
            at += 1
            groups[d] = at
            pattern += _FIELDS[d]
        elif d in _IGNORED:
            pattern += _IGNORED[d]
        else:
            raise ValueError(f"Unsupported directive %{d} in {fmt!r}")
    return rf"(?i)\A{pattern}\z", groups


def parse_time(text: Column, fmt: str | None) -> Column:
    """text as TIMESTAMP_NTZ; null where it does not fit fmt, in which a year that is missing
    is 1900. "UNIX" takes seconds since the epoch, in UTC; None takes ISO 8601 and INFERRED."""
    if fmt is None:
        return F.coalesce(text.try_cast("timestamp_ntz"), *(parse_time(text, f) for f in INFERRED))
    if fmt.upper() == "UNIX":
        micros = (text.try_cast("double") * 1_000_000).cast("long")
        return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))
    pattern, groups = _layout(fmt)
    if {"Y", "m", "d"} <= set(groups) <= set("YmdHMSf"):
        # numbers only: one rewrite to ISO order, where a cast checks the ranges
        at = lambda k: f"${groups[k]}" if k in groups else "0"
        iso = " ".join(("-".join(map(at, "Ymd")), ":".join(map(at, "HMS")))) + (f".{at('f')}" if "f" in groups else "")
        return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, iso).try_cast("timestamp_ntz"))
    part = lambda k: F.regexp_extract(text, pattern, groups[k])
    number = lambda k, default: part(k).try_cast("int") if k in groups else F.lit(default)
    if "Y" in groups:
        year = number("Y", None)
    elif "y" in groups:
        year = number("y", None) + F.when(number("y", None) < 69, 2000).otherwise(1900)
    else:
        year = F.lit(1900)
    if "b" in groups or "B" in groups:
        first = F.substring(F.lower(part("b" if "b" in groups else "B")), 1, 3)
        month = F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), first), F.lit(0)).cast("int")
    else:
        month = number("m", 1)
    hour = number("H", 0)
    if "I" in groups and "p" in groups:
        hour = number("I", 0) % 12 + F.when(F.lower(part("p")) == "pm", 12).otherwise(0)
    second = number("S", 0).cast("decimal(8,6)")
    if "f" in groups:
        second = second + (F.rpad(part("f"), 6, "0").try_cast("int").cast("decimal(16,6)") / 1_000_000).cast("decimal(8,6)")
    made = F.try_make_timestamp_ntz(year, month, number("d", 1), hour, number("M", 0), second.cast("decimal(16,6)"))
    return F.when(text.rlike(pattern), made)
