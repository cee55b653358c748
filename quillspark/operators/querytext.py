"""Query text for the remote source: per condition, and per time chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the source's query language.
CRITERIA = ('"journal article"[Publication Type]', "english[Language]", "humans[MeSH Terms]", "hasabstract[text]")
DATE, TIME = "Date - Publication", "PDAT"


def condition_search(name: str, mapped: str) -> Column:
    """The mapped query, else the name as it is and simplified."""
    clean = F.replace(F.replace(F.lower(name), F.lit(" and "), F.lit(" ")), F.lit("/"), F.lit(" "))
    fallback = F.concat(F.lit('"'), F.col(name), F.lit('"[Title/Abstract] OR "'), clean, F.lit('"[Title/Abstract]'))
    return F.coalesce(F.col(mapped), fallback)


def _span(field: str, start: str, end: str | None = None) -> str:
    return " : ".join(f'"{x}"[{field}]' for x in (start, end) if x)


def date_constraint(year=None, month=None, day=None, hours=None, minutes=None, date_range=None, first=1975, last=2024) -> str:
    """The first that is given of: range, minutes, hours, day, month, year; else all years.

    Minutes and hours need a whole date; minutes without hours lie in hour 0.
    """
    if date_range:
        return _span(DATE, *date_range)
    parts = [f"{year}", *(f"{x:02}" for x in (month, day) if x)] if year else []
    if len(parts) == 3 and (hours or minutes):
        first_hour, last_hour = hours or (0, 0)
        first_minute, last_minute = minutes or (0, 59)
        date = "/".join(parts)
        return _span(TIME, f"{date} {first_hour:02}:{first_minute:02}", f"{date} {last_hour:02}:{last_minute:02}")
    if month:
        return _span(DATE, "/".join(parts))
    return _span(DATE, parts[0]) if parts else _span(DATE, str(first), str(last))


def search_text(condition_query: str, **when) -> str:
    return " AND ".join([*CRITERIA, f"({condition_query})", date_constraint(**when)])
