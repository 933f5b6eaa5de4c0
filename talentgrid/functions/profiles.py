"""Small rules over profiles, jobs and bullet points, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions import labels as L
from talentgrid.functions import text as T
from talentgrid.functions import vocabulary as V


def filled(own: Column, parsed: Column) -> Column:
    """The candidate's own value, else the parsed one; empty counts as missing."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(parsed, F.lit("")))


def headline(summary: Column) -> Column:
    """The first line of a summary, cut at 100 characters, with dots where something was cut."""
    line = F.substring(F.substring_index(summary, "\n", 1), 1, 100)
    return F.when(summary != "", F.concat(line, F.when(F.length(line) < F.length(summary), "...").otherwise("")))


def shown_experience(entries: Column) -> Column:
    """The entry (title, company, start_date, end_date) that fills a profile: Present first, then the earliest end, entries
    without an end last; of equal ones the first."""
    keyed = F.transform(entries, lambda e, k: F.struct((F.coalesce(e["end_date"], F.lit("")) != "Present").alias("past"), F.coalesce(F.nullif(e["end_date"], F.lit("")), F.lit("9999")).alias("end"), k.alias("k"), e.alias("e")))
    return F.array_min(keyed)["e"]


def latest_experience(entries: Column) -> Column:
    """The current entry (no end date), else the one with the latest end; of equal ones the first."""
    keyed = F.transform(entries, lambda e, k: F.struct(e["end_date"].isNull().alias("current"), e["end_date"].alias("end"), (-k).alias("k"), e.alias("e")))
    return F.array_max(keyed)["e"]


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def valid_email(c: Column) -> Column:
    return F.when(c.rlike(r"^[^@]+@[^@]+\.[^@]+"), c)


def valid_phone(c: Column) -> Column:
    """The number as it is if it has seven digits or more."""
    return F.when(F.length(T.digits(c)) >= 7, c)


def is_ai_role(title: Column) -> Column:
    return F.coalesce(title.rlike(r"(?i)\b(" + "|".join(V.AI_WORDS) + r")\b"), F.lit(False))


def job_skills(c: Column) -> Column:
    """The skills of a comma list; null where there are none."""
    skills = L.skills_list(c)
    return F.when(F.size(skills) > 0, skills)


def description_text(title: Column, department: Column, location: Column, kind: Column, overview: Column) -> Column:
    """Labelled lines of a job for embedding; empty ones but the title are left out."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))
    first = F.concat(F.lit("Job Title: "), F.coalesce(title, F.lit("")))
    return F.trim(F.concat_ws("\n", first, line("Department", department), line("Location", location), line("Job Type", kind), line("Overview", overview)))


def profile_text(position: Column, company: Column, headline_: Column, skills: Column) -> Column:
    return F.concat_ws(" ", position, company, headline_, F.array_join(skills, " "))


def described(bullets: Column) -> Column:
    """Bullets as lines that begin with a dash."""
    return F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), F.trim(b))), "\n")


def ended(bullet: Column) -> Column:
    """A bullet with a mark at its end."""
    b = stripped(bullet)
    return F.when((b == "") | b.rlike(r"[.!?]$"), b).otherwise(F.concat(b, F.lit(".")))


def looks_cut(text: Column) -> Column:
    """Whether a text ends on dots or on a word of one or two characters."""
    c = stripped(F.coalesce(text, F.lit("")))
    last = F.element_at(F.split(c, r"\s+"), -1)
    return (c != "") & (c.endswith("...") | (F.length(last) <= 2))


def completed(text: Column) -> Column:
    """A text that looks cut without its last short word, ended by a period; a single word is dropped."""
    words = F.split(stripped(text), r"\s+")
    last = F.element_at(words, -1)
    short = (F.length(last) <= 2) | last.endswith("-")
    kept = F.when(short, F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    cut = F.concat(F.regexp_replace(F.array_join(kept, " "), r"[ ,;:]+$", ""), F.lit("."))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(~looks_cut(text), text).when(F.size(words) <= 1, "").otherwise(cut)


def points(items: Column) -> Column:
    """At most five points without list marks and empty entries."""
    plain = F.transform(items, lambda s: F.trim(F.regexp_replace(F.trim(T.plain_dashes(s)), r"^[-*• ]+", "")))
    return F.slice(F.filter(plain, lambda s: s != ""), 1, V.MOST_POINTS)


def same_skills(a: Column, b: Column) -> Column:
    """struct(matching, missing): what two lists share and what the second lacks, sorted."""
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("matching"), F.array_sort(F.array_except(a, b)).alias("missing"))


def tags(c: Column) -> Column:
    """Normal forms of tags in order, once each."""
    return F.array_distinct(F.filter(F.transform(c, T.tag), lambda t: t.isNotNull()))


def distinct_education(entries: Column) -> Column:
    """Entries (institution, degree, ...) once for each institution and degree, in any case; the first one stays."""
    key = lambda e: F.struct(F.lower(F.coalesce(e["institution"], F.lit(""))), F.lower(F.coalesce(e["degree"], F.lit(""))))
    return F.filter(entries, lambda e, k: F.array_position(F.transform(entries, key), key(e)) == k + 1)


def duplicate_key(digest: Column, size: Column) -> Column:
    return F.concat_ws(":", F.lit("duplicate"), digest, size.cast("string"))


def standard_month(c: Column) -> Column:
    """A date as month name and year."""
    return F.date_format(c, "MMM yyyy")
