"""Dates in queries, read on the driver; `as_of` is always given."""

from __future__ import annotations

import calendar
import datetime as dt
import re

MONTHS = {name.lower(): i for i, name in enumerate(calendar.month_name) if name}
MONTHS |= {name.lower(): i for i, name in enumerate(calendar.month_abbr) if name}


def months_ago(day: dt.date, n: int) -> dt.date:
    """The same day n months earlier, or the month's last."""
    index = day.year * 12 + day.month - 1 - n
    year, month = divmod(index, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def month_range(year: int, month: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])


def _ago(n: int, unit: str, as_of: dt.date) -> dt.date:
    if unit.startswith("m"):
        return months_ago(as_of, n)
    if unit.startswith("y"):
        return months_ago(as_of, 12 * n)
    return as_of - dt.timedelta(days=n * (7 if unit.startswith("w") else 1))


def date_filters(query: str, as_of: dt.date) -> tuple[str, dt.date | None, dt.date | None]:
    """The query without its first date phrase, by a fixed priority of phrases, and the bounds that it means."""
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    monday = as_of - dt.timedelta(days=as_of.weekday())
    rules = [
        (rf"\b({names})\s+(\d{{4}})\b", lambda m: month_range(int(m[2]), MONTHS[m[1].lower()])),
        (r"\b(\d{4})-(0[1-9]|1[0-2])\b(?!-)", lambda m: month_range(int(m[1]), int(m[2]))),
        (r"\byesterday\b", lambda m: (as_of - dt.timedelta(days=1),) * 2),
        (r"\btoday\b", lambda m: (as_of, as_of)),
        (r"\blast\s+week\b", lambda m: (monday - dt.timedelta(days=7), monday - dt.timedelta(days=1))),
        (r"\blast\s+(\d+)\s+(days?|weeks?|months?|years?)\b", lambda m: (_ago(int(m[1]), m[2].lower(), as_of), as_of)),
        (r"\bpast\s+(\d+)\s+(days?|weeks?|months?|years?)\b", lambda m: (_ago(int(m[1]), m[2].lower(), as_of), as_of)),
        (r"\bthis\s+year\b", lambda m: (dt.date(as_of.year, 1, 1), as_of)),
        (r"\bthis\s+month\b", lambda m: (as_of.replace(day=1), as_of)),
    ]
    for pattern, bounds in rules:
        if m := re.search(pattern, query, re.IGNORECASE):
            first, last = bounds(m)
            return " ".join((query[: m.start()] + " " + query[m.end() :]).split()), first, last
    return query, None, None


def since(value: str, as_of: dt.date) -> dt.date:
    """An ISO date, or an age such as 7d, 2w or 3m."""
    if m := re.fullmatch(r"(\d+)([dwm])", value.strip().lower()):
        return _ago(int(m[1]), m[2], as_of)
    return dt.date.fromisoformat(value.strip())
