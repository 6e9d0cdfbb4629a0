"""Scalar functions on dates: Column -> Column. The session's time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col
from .strings import strip

_SHORT, _LONG, _ISO = r"^(\d{1,2})/(\d{1,2})/(\d{2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^\d{4}-\d{1,2}-\d{1,2}$"


def to_date(x: Column | str) -> Column:
    """ISO, then day/month/year with four, then with two digits (2000 to 2099); else NULL.

    One chain, in which x stands once: what stands several times in an expression is worked out several times.
    """
    text = F.regexp_replace(F.regexp_replace(strip(col(x).cast("string")), _SHORT, "20$3-$2-$1"), _LONG, "$3-$2-$1")
    return F.regexp_extract(text, _ISO, 0).try_cast("date")


def days_between(a: Column | str, b: Column | str) -> Column:
    """Days from a to b; NULL if either is bad."""
    return F.datediff(to_date(b), to_date(a))


def work_dates(x: Column | str) -> tuple[Column, Column]:
    """C20: start and end out of `dd/mm/yyyy - dd/mm/yyyy`; either may be NULL."""
    parts = F.split(col(x), r"\s+-\s+")
    return to_date(F.try_element_at(parts, F.lit(1))), to_date(F.try_element_at(parts, F.lit(2)))


def completion(start: Column | str, end: Column | str, on: Column | str) -> Column:
    """Share of the time from start to end that has passed; below 0 or above 1 outside of it, NULL for no time."""
    start, end, on = (col(x).cast("date") for x in (start, end, on))
    return F.try_divide(F.datediff(on, start).cast("double"), F.nullif(F.datediff(end, start), F.lit(0)).cast("double"))


def epoch_date(x: Column | str) -> Column:
    """The date of a number of seconds since 1970."""
    return F.to_date(F.timestamp_seconds(col(x).try_cast("bigint")))


def full_year(x: Column | str) -> Column:
    """`yy-...` becomes `20yy-...` in a text of eight or more characters."""
    return F.when(F.char_length(col(x)) >= 8, F.regexp_replace(col(x), r"^(\d\d)-", "20$1-")).otherwise(col(x))


def date_parts(d: Column | str) -> dict[str, Column]:
    """C24"""
    d = col(d)
    return {"year": F.year(d).cast("short"), "month_number": F.month(d).cast("short"), "month_name": F.lower(F.date_format(d, "MMMM")), "day_of_month": F.dayofmonth(d).cast("short")}


def last_word_date(x: Column | str) -> Column:
    """The date in a text's last word, as in `Aggiornato il 05/03/24`."""
    return to_date(F.element_at(F.split(strip(x), r"\s+"), -1))
