"""Lenient wall-clock parsing of mixed date and time notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?\s*(?:Z|[+-]\d{2}(?::?\d{2})?)?\s*$"
#: The notations as one pattern, and the order in which its groups give year|month|day|hour|minute|second (groups of other notations are empty; the zeros keep a
#: missing time of day a number, since the cast of an empty text raises and catches an error for each row).
NOTATIONS = r"^\s*(?:(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})|(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})|(\d{4})(\d{2})(\d{2}))" + _CLOCK
ORDER = "$1$6$7|$2$5$8|$3$4$9|0$10|0$11|0$12"


def wall_seconds(text: Column) -> Column:
    """Seconds since 1970-01-01T00:00 of the wall clock that ``text`` shows, or null.

    Year first or day first (year last), with or without time of day, seconds or offset; an offset is
    dropped; no time of day means 00:00; impossible dates and times give null. Independent of the session zone.
    """
    text = F.regexp_replace(text, NOTATIONS, ORDER)

    def seconds(parts: Column) -> Column:
        part = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("int")
        clock = lambda i: F.coalesce(part(i), F.lit(0))
        day = F.try_make_timestamp_ntz(part(0), part(1), part(2), F.lit(0), F.lit(0), F.lit(0))
        days = F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        ok = (F.size(parts) == 6) & (clock(3) < 24) & (clock(4) < 60) & (clock(5) < 60)
        return F.when(ok, days * 86400 + clock(3) * 3600 + clock(4) * 60 + clock(5))

    # A lambda's argument is evaluated once, however often the result's expression names it.
    return F.transform(F.array(F.split(text, r"\|")), seconds)[0]


def each_known(value: Column) -> Column:
    """``value`` as a generator: no row where it is null, and evaluated once (a filter would evaluate it again)."""
    return F.explode(F.array_compact(F.array(value)))


def wall_text(seconds: Column, minutes: bool = True) -> Column:
    """``yyyy-MM-dd`` or ``yyyy-MM-ddTHH:mm`` of wall-clock seconds."""
    day = F.floor(seconds / 86400).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")
    if not minutes:
        return date
    rest = F.pmod(seconds, F.lit(86400)).cast("int")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(date, F.lit("T"), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60))


def clean_number(col: Column, *missing: float) -> Column:
    """``col`` as double, with NaN, infinities and the ``missing`` codes as null."""
    value = col.cast("double")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~(bad | value.isin(*missing)) if missing else ~bad, value)


def clean_key(col: Column) -> Column:
    """Outer spaces off, capitals; empty becomes null."""
    key = F.upper(F.trim(col))
    return F.when(key != "", key)
