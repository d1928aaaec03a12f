"""Intervals in words as Spark SQL literals."""

from __future__ import annotations

import re

UNITS = {"year": "YEAR", "yr": "YEAR", "y": "YEAR", "month": "MONTH", "mon": "MONTH", "week": "WEEK", "w": "WEEK", "day": "DAY", "d": "DAY", "hour": "HOUR", "hr": "HOUR", "h": "HOUR", "minute": "MINUTE", "min": "MINUTE", "m": "MINUTE", "second": "SECOND", "sec": "SECOND", "s": "SECOND"}


def interval(text: str) -> str:
    """`1 year 2 months`, `1-2`, `3 4:05:06`, `2 hours ago` -> make_interval(...)."""
    total = dict.fromkeys(("YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND"), 0.0)
    rest = text.strip().lower()
    sign = -1 if rest.endswith("ago") else 1
    rest = rest.removesuffix("ago")
    found = False
    for m in re.finditer(r"([+-]?\d+)-(\d+)(?=\s|$)|([+-]?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?|([+-]?\d+(?:\.\d+)?)\s*([a-z]*)", rest):
        found = True
        if m[1]:
            total["YEAR"] += int(m[1])
            total["MONTH"] += int(m[2]) * (-1 if m[1][0] == "-" else 1)
        elif m[4]:
            way = -1 if m[3] == "-" else 1
            total["HOUR"] += way * int(m[4])
            total["MINUTE"] += way * int(m[5])
            total["SECOND"] += way * float(m[6] or 0)
        else:
            unit = m[8] or "d"
            unit = UNITS.get(unit) or UNITS.get(unit.removesuffix("s"))
            if not unit:
                raise ValueError(f"unknown unit in interval {text!r}")
            total[unit] += float(m[7])
    if not found:
        raise ValueError(f"no interval: {text!r}")
    whole = [str(int(sign * total[u])) for u in ("YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE")]
    return f"make_interval({', '.join(whole)}, {sign * total['SECOND']})"
