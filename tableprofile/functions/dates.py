"""Free-format date parsing and calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A text is tried against the formats of the first shape it fits, in order.
CLOCK_SHAPE, CLOCK_FORMAT = r"(?i)^\d{4}-\d{1,2}-\d{1,2}[T ]\d.* [ap]m$", "yyyy-M-d[ ]['T']h:mm[:ss] a"
ISO_SHAPE = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d.*)?)?)?$"
WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +(?=.*\d)"
TEXT_FORMATS = [
    (r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d.* [ap]m$", ["M/d/yyyy h:mm[:ss] a", "d/M/yyyy h:mm[:ss] a"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}( \d.*)?$", ["M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]"]),
    (r"(?i)^\d{1,2}/\d{1,2}/\d{2} \d.* [ap]m$", ["M/d/yy h:mm[:ss] a", "d/M/yy h:mm[:ss] a"]),
    (r"^\d{1,2}/\d{1,2}/\d{2}( \d.*)?$", ["M/d/yy[ H:mm[:ss]]", "d/M/yy[ H:mm[:ss]]"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}( \d.*)?$", ["M-d-yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]"]),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}( \d.*)?$", ["yyyy.M.d[ H:mm[:ss]]"]),
    (r"(?i)^[a-z]{3,9} \d{1,2},? \d{4},? \d.* [ap]m$", ["MMM d[,] yyyy[,] h:mm[:ss] a", "MMMM d[,] yyyy[,] h:mm[:ss] a"]),
    (r"^[A-Za-z]{3,9} \d{1,2},? \d{4}(,? \d.*)?$", ["MMM d[,] yyyy[[,] H:mm[:ss]]", "MMMM d[,] yyyy[[,] H:mm[:ss]]"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}( \d.*)?$", ["yyyy/M/d[ H:mm[:ss]]"]),
    (r"^\d{8}$", ["yyyyMMdd"]),
    (r"(?i)^\d{1,2} [a-z]{3,9},? \d{4},? \d.* [ap]m$", ["d MMM[,] yyyy[,] h:mm[:ss] a", "d MMMM[,] yyyy[,] h:mm[:ss] a"]),
    (r"^\d{1,2} [A-Za-z]{3,9},? \d{4}(,? \d.*)?$", ["d MMM[,] yyyy[[,] H:mm[:ss]]", "d MMMM[,] yyyy[[,] H:mm[:ss]]"]),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", ["d-MMM-yy"]),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ["d-MMM-yyyy"]),
]
BEGINNING = r"(?i)^\s*(\d|mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
LONGEST = 64
DATE_HINT = r"(?i)[-/]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def parse_date(value: Column) -> Column:
    """Timestamp of a date text, else null. Text without a date part (12:30) is no date.

    A failing parser is far dearer than a failing regex, so each format runs only on text
    of its shape, and shapes are tried only on text of the length and beginning of a date. A weekday
    before the date is dropped. Years of two digits lie within fifty years of today.
    """
    # the lambda makes the cleaned text once, not once a shape
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(value), WEEKDAY, ""), r"(?i)\bsept\b", "Sep")
    return F.when(may_be_date(value), F.transform(F.array(cleaned), _by_shape)[0])


def may_be_date(value: Column) -> Column:
    """A cheap test that every date text passes."""
    return F.length(F.trim(value)).between(4, LONGEST) & value.rlike(r"\d") & value.rlike(BEGINNING)


def _by_shape(v: Column) -> Column:
    parsed = F.when(v.rlike(CLOCK_SHAPE), _parsed(v, CLOCK_FORMAT)).when(v.rlike(ISO_SHAPE), F.try_to_timestamp(v))
    for shape, formats in TEXT_FORMATS:
        parsed = parsed.when(v.rlike(shape), F.coalesce(*[_parsed(v, f) for f in formats]))
    return F.when(v.rlike(BEGINNING), parsed)


def _parsed(v: Column, pattern: str) -> Column:
    found = F.try_to_timestamp(v, F.lit(pattern))
    if "yyyy" in pattern:
        return found
    return F.when(F.year(found) - F.year(F.current_date()) >= 50, found - F.expr("INTERVAL 100 YEAR")).otherwise(found)


def has_date_hint(value: Column) -> Column:
    return value.rlike(DATE_HINT)


PERIODS = ("day", "week", "month", "quarter", "year")


def period_start(day: Column, period: str) -> Column:
    return day if period == "day" else F.trunc(day, period).cast("date")


def shift_period(start: Column, period: str, by: int) -> Column:
    if period in ("day", "week"):
        return F.date_add(start, by * (7 if period == "week" else 1))
    return F.add_months(start, by * {"month": 1, "quarter": 3, "year": 12}[period])


def period_step(period: str) -> Column:
    n, unit = {"day": (1, "DAY"), "week": (7, "DAY"), "month": (1, "MONTH"),
               "quarter": (3, "MONTH"), "year": (1, "YEAR")}[period]
    return F.expr(f"INTERVAL {n} {unit}")


def period_label(start: Column, period: str) -> Column:
    """The day itself, else the last day of the period; weeks close on Sunday."""
    return start if period == "day" else F.date_sub(shift_period(start, period, 1), 1)
