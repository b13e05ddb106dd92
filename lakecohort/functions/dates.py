"""Dates in three layouts: ISO, month first and, for named variables, day first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\s*$"
SLASH = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})(?:\s+\d{1,2}:\d{2}(?::\d{2})?(\s*[AaPp][Mm])?)?\s*$"
#: Ends of lines that a pattern leaves out and a cast doesn't trim.
ENDS = "\u0085\u2028\u2029"
#: Two-digit years below this are of the 2000s.
PIVOT = 50


def year(c: Column) -> Column:
    y = c.try_cast("int")
    return F.when(F.length(c) == 2, F.when(y < PIVOT, y + 2000).otherwise(y + 1900)).otherwise(y)


def parse(c: Column | str, day_first: bool = False) -> Column:
    """A date, or null where the text isn't one; the time of day is left out."""
    c = F.col(c) if isinstance(c, str) else c
    d, m = (1, 2) if day_first else (2, 1)
    slash = F.concat_ws("-", F.lpad(year(F.regexp_extract(c, SLASH, 3)).cast("string"), 4, "0"), F.regexp_extract(c, SLASH, m), F.regexp_extract(c, SLASH, d))
    return F.when(c.rlike(ISO), F.rtrim(c, F.lit(ENDS)).try_cast("date")).when(c.rlike(SLASH), slash.try_cast("date"))


def looks_like_date(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(ISO) | c.rlike(SLASH), F.lit(False))


def shift(c: Column | str, days: Column, day_first: bool = False) -> Column:
    """A date text moved by days in the layout that it has: ISO padded, the others without padding and with four-digit years.

    Text that is no date becomes null: a date that can't be moved must not pass.
    """
    c = F.col(c) if isinstance(c, str) else c
    return shift_parsed(c, F.date_add(parse(c, day_first), days.cast("int")), day_first)


def shift_parsed(c: Column, moved: Column, day_first: bool = False) -> Column:
    """As shift, where the moved date is known; best a column of its own, as it is used in more than one place."""
    half = F.trim(F.regexp_extract(c, SLASH, 4))
    slash = F.concat(F.date_format(moved, "d/M/yyyy" if day_first else "M/d/yyyy"), F.when(half != "", F.concat(F.lit(" "), half)).otherwise(""))
    return F.when(c.rlike(ISO), F.date_format(moved, "yyyy-MM-dd")).when(c.rlike(SLASH), slash)


def as_stored(c: Column) -> Column:
    """A timestamp as text: the date alone at midnight, else with its time."""
    midnight = (F.hour(c) == 0) & (F.minute(c) == 0) & (F.second(c) == 0)
    return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))


def bucket(ts: Column, now: Column, pinned: Column | None = None) -> Column:
    """pinned, today, yesterday, last7, last30 or older, by days before now at midnight; null is older."""
    days = F.datediff(now.cast("date"), ts.cast("date"))
    aged = F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "last7").when(days <= 30, "last30").otherwise("older")
    return aged if pinned is None else F.when(pinned, "pinned").otherwise(aged)
