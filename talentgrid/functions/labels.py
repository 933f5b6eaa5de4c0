"""Small projections: labels, names, states and guards. All are Columns; null behaves as documented per function."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions import vocabulary as V


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of a key in a fixed table, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def source_key(c: Column) -> Column:
    """A stored source: known values stay, legacy ones are mapped, blank is the default channel, the rest is other."""
    key = blank_to_null(F.lower(c))
    return F.when(key.isNull(), V.DEFAULT_SOURCE).when(key.isin(*V.SOURCE_LABELS), key).otherwise(F.coalesce(lookup(key, V.LEGACY_SOURCES), F.lit("other")))


def source_label(c: Column) -> Column:
    key = blank_to_null(F.lower(c))
    return F.when(key.isNull() | (key == "unknown"), V.UNKNOWN_SOURCE).otherwise(F.coalesce(lookup(key, V.SOURCE_LABELS), F.lit(V.SOURCE_LABELS["other"])))


def person(first: Column, last: Column) -> Column:
    """First and last name without empty parts."""
    joined = F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("Unnamed candidate"))


def job_title(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled job"))


def stage_name(key: Column, name: Column, one_job: bool) -> Column:
    """A job's own name when one job is shown, else the default name of a known stage."""
    return name if one_job else F.coalesce(lookup(key, {k: n for k, n, _ in V.DEFAULT_STAGES}), name)


def event_kind(kind: Column, key: Column, status: Column) -> Column:
    """What a finished stage row means in the feed; null for no event."""
    outcome = F.when(status == "passed", F.coalesce(lookup(key, {"hired": "hired", "offer_declined": "declined", "withdrawn": "withdrew"}), F.lit("passed")))
    return F.when(kind == "outcome", outcome).otherwise(lookup(status, {"passed": "passed", "failed": "rejected", "skipped": "skipped"}))


def interview_state(submitted: Column, stage_status: Column) -> Column:
    return F.when(submitted, "submitted").when(stage_status == "in_progress", "waiting").when(stage_status == "skipped", "skipped").when(stage_status.isin("passed", "failed"), "waiting").otherwise("upcoming")


def humanized(c: Column) -> Column:
    return F.initcap(F.lower(F.regexp_replace(c, "[_-]+", " ")))


def fit_tone(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 70, "strong").when(score >= 50, "moderate").otherwise("weak")


def salary_text(low: Column, high: Column) -> Column:
    """A range, a bound or nothing; zero counts as missing."""
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    has = lambda c: c.isNotNull() & (c != 0)
    return F.when(has(low) & has(high), F.concat(money(low), F.lit(" - "), money(high))).when(has(low), F.concat(F.lit("From "), money(low))).when(has(high), F.concat(F.lit("Up to "), money(high))).otherwise("Not disclosed")


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def skills_list(c: Column) -> Column:
    """A comma list as an array of trimmed, non-empty entries."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), F.trim), lambda s: s != "")


def days_between(start: Column, end: Column) -> Column:
    """Days with a fraction, whatever the kind of timestamp."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(86_400_000_000.0)


def whole_days(start: Column, end: Column) -> Column:
    return F.floor(days_between(start, end)).cast("long")


def like_pattern(text: str) -> str:
    """The text as a pattern that matches it literally anywhere; for ``ilike`` with a backslash escape."""
    return "%" + reduce(lambda s, c: s.replace(c, "\\" + c), "\\%_", text) + "%"


#: Patterns of every place that is known by name; places that mean everywhere have none.
PLACES = (
    dict.fromkeys(V.ANYWHERE, ())
    | {name: tuple(f"%, {state}%" for state in states) for name, states in V.REGION_STATES.items()}
    | {name: tuple(f"%{city}%" for city in cities) for name, cities in V.REGION_CITIES.items()}
)
FILLER = re.compile("|".join(map(re.escape, V.PLACE_PREFIXES)))


def place_patterns(place: str) -> list[str]:
    """Patterns for a place as people name it: those of a known name, else one for the name itself."""
    asked = place.strip()
    plain = asked.lower().rstrip(".!?")
    filler = FILLER.match(plain)
    name = plain[filler.end() :] if filler else plain
    return list(PLACES.get(name, (like_pattern(name if filler else asked),)))


def like_any(c: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; no patterns mean no filter."""
    return reduce(lambda a, b: a | b, (c.ilike(p) for p in patterns)) if patterns else F.lit(True)
