"""Dates: parsing, truncation and formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .text import as_col, strip_ws

_TIME = r"(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?$"
_DAY_MONTH = r"^(\d{1,2})[./-](\d{1,2})[./-]"

# How a date cell may be written, and its readings as ISO text in order of preference.
_SPELLINGS = [
    (_DAY_MONTH + r"(\d{4})" + _TIME, ["$3-$2-$1 $4", "$3-$1-$2 $4"]),
    (r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})" + _TIME, ["$1-$2-$3 $4"]),
    (_DAY_MONTH + r"([0-5]\d|6[0-8])" + _TIME, ["20$3-$2-$1 $4", "20$3-$1-$2 $4"]),
    (_DAY_MONTH + r"(69|[7-9]\d)" + _TIME, ["19$3-$2-$1 $4", "19$3-$1-$2 $4"]),
    (r"^(\d{4})(\d{2})(\d{2})$", ["$1-$2-$3"]),
]
# Month names, before or after the day, with or without a time.
_CLOCK = r"( \d{1,2}:\d{2}(:\d{2})?)?$"
_DAY_FIRST = r"^\d{1,2} [A-Za-z]{3,9} \d{4}" + _CLOCK
_MONTH_FIRST = r"^[A-Za-z]{3,9} \d{1,2} \d{4}" + _CLOCK
_CLOCKS = ("", " H:mm", " H:mm:ss")
_ZULU = r"^(\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)Z$"


def parse_dt(column: Column | str, formats: Sequence[str] = ()) -> Column:
    """Timestamp of a text in one of the formats (ISO when none is given), bad ones missing."""
    value = as_col(column)
    if not formats:
        return value.try_cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in formats])


def parse_as_of(cell: Column | str) -> Column:
    """Timestamp of a date cell's text, day before month.

    ISO text is read as ISO. Where the second number cannot be a month, the first one is.
    """
    text = F.regexp_replace(strip_ws(cell), _ZULU, "$1")
    words = F.regexp_replace(F.replace(text, F.lit(","), F.lit(" ")), " +", " ")
    parsed = F
    for pattern, readings in _SPELLINGS:
        stamps = [F.regexp_replace(text, pattern, r).try_cast("timestamp_ntz") for r in readings]
        parsed = parsed.when(text.rlike(pattern), F.coalesce(*stamps))
    for pattern, dates in ((_DAY_FIRST, ("d MMMM yyyy", "d MMM yyyy")), (_MONTH_FIRST, ("MMMM d yyyy", "MMM d yyyy"))):
        formats = [f"{date}{clock}" for date in dates for clock in _CLOCKS]
        parsed = parsed.when(words.rlike(pattern), parse_dt(words, formats))
    return parsed


def resolve_as_of(cell: Column | str, file_ts: Column | str) -> Column:
    """As-of time of a file: its date cell, else the time of the file itself."""
    return F.coalesce(parse_as_of(cell), as_col(file_ts).cast("timestamp_ntz"))


def as_of_source(cell: Column | str) -> Column:
    """Where the as-of time came from: ``cell``, or ``file`` for a missing or unreadable cell."""
    return F.when(parse_as_of(cell).isNotNull(), "cell").otherwise("file")


def day(column: Column | str) -> Column:
    """Timestamp cut to midnight."""
    return as_col(column).cast("date").cast("timestamp_ntz")


def with_year_month(df: DataFrame, dt: str = "dt") -> DataFrame:
    return df.withColumns({"year": F.year(dt), "month": F.month(dt)})


def month_start(year: Column | str, month: Column | str) -> Column:
    """First day of a month."""
    return F.make_date(as_col(year), as_col(month), F.lit(1))


def fmt_date(column: Column | str) -> Column:
    return F.date_format(as_col(column), "dd/MM/yyyy")
