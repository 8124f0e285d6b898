"""Dates of feeds and pages, as column expressions; all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in the genitive, as pages write dates.
MONTHS = ("січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня")


def rfc822(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|Z)$", "+0000")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))


def iso(c: Column) -> Column:
    return c.try_cast("timestamp")


def month_name(c: Column) -> Column:
    """A date such as "5 квітня 2026"."""
    pattern = rf"(?iu)(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})"
    names = F.array(*map(F.lit, MONTHS))
    month = F.array_position(names, F.lower(F.regexp_extract(c, pattern, 2)))
    text = F.concat_ws("-", F.regexp_extract(c, pattern, 3), month.cast("string"), F.regexp_extract(c, pattern, 1))
    return F.when(month > 0, F.try_to_timestamp(text, F.lit("yyyy-M-d")))


def english_day(c: Column) -> Column:
    """A date such as "April 5, 2026"."""
    return F.try_to_timestamp(F.trim(c), F.lit("MMMM d, yyyy"))
