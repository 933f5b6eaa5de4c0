"""Free-text dates of resumes as Columns: ranges, months, keys for sorting, years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions import vocabulary as V
from talentgrid.functions.text import iso_date


def is_present(c: Column, words: tuple[str, ...] = V.PRESENT_WORDS) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*words), F.lit(False))


def month_number(c: Column) -> Column:
    """01 to 12 of a month's name or its first three letters, else null."""
    place = F.array_position(F.array(*map(F.lit, V.MONTHS)), F.substring(F.lower(c), 1, 3))
    return F.when(place > 0, F.lpad(place.cast("string"), 2, "0"))


def date_range(c: Column, today: Column) -> Column:
    """struct(start_date, end_date) of two dates with a hyphen between them. The text is split at every hyphen and the first two
    parts count, so ISO dates are cut (as the reference does); a missing end, or one that means the present, is null."""
    parts = F.split(c, "-")
    start, end = F.trim(F.get(parts, 0)), F.coalesce(F.trim(F.get(parts, 1)), F.lit("present"))
    kept = F.when(F.coalesce(c, F.lit("")) != "", F.struct(iso_date(start, today).alias("start_date"), F.when(~is_present(end), iso_date(end, today)).alias("end_date")))
    return F.coalesce(kept, F.struct(F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date")))


def resume_date(c: Column, today: Column, open_end: bool = False) -> Column:
    """A date of a resume; with ``open_end`` the present is null."""
    return F.when(~is_present(c), iso_date(c, today)) if open_end else iso_date(c, today)


def education_month(c: Column) -> Column:
    """YYYY-MM of a year, a range of years, MM/YYYY or a month and year, else null. Two numbers with one hyphen are a range, so
    2018-05 is January of 2018 (as the reference reads it)."""
    text = F.trim(c)
    halves = F.transform(F.split(text, "-"), lambda s: F.trim(s))
    two = F.size(halves) == 2
    start = F.concat(F.get(halves, 0), F.lit("-01"))
    numeric = lambda s: F.coalesce(s.rlike(r"^\d+$"), F.lit(False))
    named = F.regexp_extract(text, r"^(\w+)\s+(\d{4})", 1)
    other = (
        F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01")))
        .when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])"), F.substring(text, 1, 7))
        .when(text.rlike(r"^(0[1-9]|1[0-2])/\d{4}"), F.concat(F.substring(text, 4, 4), F.lit("-"), F.substring(text, 1, 2)))
        .when(named != "", F.concat(F.regexp_extract(text, r"^(\w+)\s+(\d{4})", 2), F.lit("-"), F.coalesce(month_number(named), F.lit("01"))))
    )
    return F.when(text == "", None).when(two, F.when(numeric(F.get(halves, 0)) & numeric(F.get(halves, 1)), start)).otherwise(other)


def education_months(start: Column, end: Column, today: Column) -> Column:
    """struct(start, end) of education_month; an end that means the present is the month of ``today``."""
    now = is_present(end, ("present", "current", "now"))
    return F.struct(education_month(start).alias("start"), F.when(now, F.date_format(today, "yyyy-MM")).otherwise(education_month(end)).alias("end"))


def sort_key(c: Column) -> Column:
    """YYYY-MM for ordering: 9999-99 for the present, 0000-00 without a year, month 00 where none is named."""
    low = F.lower(c)
    year = F.regexp_extract(c, r"\b(\d{4})\b", 1)
    named = month_number(F.regexp_extract(low, r"\b(" + "|".join(V.MONTHS) + ")", 1))
    numbered = F.nullif(F.regexp_extract(c, r"^\s*(\d{1,2})[/-]\d{4}", 1), F.lit(""))
    month = F.coalesce(named, F.lpad(numbered, 2, "0"), F.lit("00"))
    present = F.coalesce(low.isin(*V.PRESENT_WORDS, "ongoing"), F.lit(False))
    return F.when(present, "9999-99").when(F.coalesce(year, F.lit("")) == "", "0000-00").otherwise(F.concat(year, F.lit("-"), month))


def service_date(c: Column) -> Column:
    """Present, the first four digits in a row, or the text itself in lower case; null for nothing."""
    low = F.lower(F.trim(c))
    year = F.regexp_extract(low, r"(\d{4})", 1)
    return F.when(c == "", None).when(low.isin("present", "current", "now"), "Present").otherwise(F.coalesce(F.nullif(year, F.lit("")), low))


def year_of(c: Column) -> Column:
    """The first year of the 20th or 21st century in a text, Present for words of the present, else null; as text."""
    year = F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    return F.coalesce(year, F.when(F.lower(c).rlike("present|current"), "Present"))
