"""What a job requires beyond its skills, as Columns: reading, checking, rules, the cap on a score and its explanation.

Requirements are a JSON document: must_have_skills and nice_to_have_skills (lists, or comma-separated text), min_years,
max_years, min_education. A document that breaks a rule counts as no requirements, and so does one that sets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions import text as T
from talentgrid.functions import vocabulary as V

def no_skills() -> Column:
    return F.array().cast("array<string>")


def cleaned_skills(raw: Column) -> Column:
    """A JSON list or comma-separated text as an array: single spaces, no empty entries, of equal ones (in any case) the first."""
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, ","))
    skills = F.filter(F.transform(F.coalesce(listed, no_skills()), T.spaced), lambda s: s != "")
    return F.filter(skills, lambda s, k: F.array_position(F.transform(skills, F.lower), F.lower(s)) == k + 1)


def parsed(raw: Column) -> Column:
    """struct(must, nice, min_years, max_years, min_education) of a valid document that sets something, else null."""
    field = lambda name: F.get_json_object(raw, f"$.{name}")
    whole = lambda c: F.when(c.rlike(r"^\s*-?\d+(\.0*)?\s*$"), c.try_cast("double").try_cast("int"))
    must, nice = cleaned_skills(field("must_have_skills")), cleaned_skills(field("nice_to_have_skills"))
    low, high, education = whole(field("min_years")), whole(field("max_years")), field("min_education")
    read = lambda text, value: text.isNull() | (value.isNotNull() & value.between(0, V.MOST_YEARS))
    short = lambda skills: (F.size(skills) <= V.MOST_SKILLS) & ~F.exists(skills, lambda s: F.length(s) > V.LONGEST_SKILL)
    valid = (
        read(field("min_years"), low) & read(field("max_years"), high) & F.coalesce(low <= high, F.lit(True)) & short(must) & short(nice)
        & (education.isNull() | education.isin(*V.EDUCATION_LEVELS)) & ~F.arrays_overlap(F.transform(must, F.lower), F.transform(nice, F.lower))
    )
    sets = (F.size(must) > 0) | (F.size(nice) > 0) | low.isNotNull() | high.isNotNull() | F.coalesce(education != "none", F.lit(False))
    return F.when(valid & sets, F.struct(must.alias("must"), nice.alias("nice"), low.alias("min_years"), high.alias("max_years"), education.alias("min_education")))


def with_must_haves(wanted: Column, must: Column) -> Column:
    """The wanted skills and the must-haves that they don't list."""
    listed = F.transform(wanted, lambda s: F.trim(F.lower(s)))
    return F.concat(wanted, F.filter(F.coalesce(must, no_skills()), lambda s: ~F.array_contains(listed, F.lower(s))))


def highest_education(degrees: Column) -> Column:
    """The highest level among degrees that are known, else null."""
    ranks = F.transform(F.coalesce(degrees, no_skills()), lambda d: T.education_rank(T.degree_level(d)))
    best = F.array_max(ranks)
    return F.when(best >= 0, F.element_at(F.array(*map(F.lit, V.EDUCATION_LEVELS)), (best + 1).cast("int")))


def education_met(least: Column, level: Column) -> Column:
    """Whether a level reaches the least one asked for; null where nothing is asked for or the level isn't known."""
    return F.when(least.isNotNull() & (least != "none") & level.isNotNull(), T.education_rank(level) >= T.education_rank(least))


def years_short(low: Column, years: Column) -> Column:
    return F.greatest(F.coalesce(low - years, F.lit(0.0)), F.lit(0.0))


def years_over(low: Column, high: Column, years: Column) -> Column:
    """Years above the range; none where years are missing to its lower end."""
    return F.when(years_short(low, years) > 0, 0.0).otherwise(F.greatest(F.coalesce(years - high, F.lit(0.0)), F.lit(0.0)))


def years_penalty(short: Column, over: Column) -> Column:
    """Points off the seniority score."""
    return F.when(short > 0, F.least(short * V.YEARS_SHORT, F.lit(V.YEARS_SHORT_MOST))).otherwise(F.least(over * V.YEARS_OVER, F.lit(V.YEARS_OVER_MOST)))


def label(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in V.EDUCATION_LABELS.items() for x in pair]), level)


def missing(must_missing: Column, min_years: Column, short: Column, min_education: Column, met: Column) -> Column:
    """What is missing, in words: must-have skills, years, a degree."""
    entry = lambda condition, words: F.when(condition, F.array(words)).otherwise(no_skills())
    return F.concat(
        F.transform(must_missing, lambda s: F.concat(F.lit("must-have skill "), s)),
        entry(short >= V.YEARS_MISSING, F.format_string("at least %s years of experience", min_years.cast("string"))),
        entry(F.coalesce(~met, F.lit(False)), F.concat(F.lit("a "), label(min_education))),
    )


def cap(count: Column) -> Column:
    """The limit of a score with so many requirements missing; null for none."""
    out = F.when(F.lit(False), 0.0)
    for least, limit in V.CAPS:
        out = out.when(count >= least, limit)
    return out


def general(number: Column) -> Column:
    """A number with up to six digits, without a fraction of zeros."""
    return F.regexp_replace(F.regexp_replace(F.round(number, 4).cast("decimal(18,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def explanation(r: dict[str, Column]) -> Column:
    """Sentences on requirements. ``r``: must, must_missing, nice, nice_hits, min_years, max_years, years, short, over, min_education,
    education, met, reasons, limit, before."""
    years = general(r["years"])
    no_degree = F.concat(F.lit("No degree recorded, and the job asks for a "), label(r["min_education"]))
    lower = F.concat(F.lit("Highest recorded degree is a "), label(r["education"]), F.lit(", below the "), label(r["min_education"]), F.lit(" asked for"))
    count = F.size(r["reasons"])
    what = F.when(count == 1, "one requirement is").otherwise(F.concat(count.cast("string"), F.lit(" requirements are")))
    has_years = r["years"].isNotNull()
    recorded = F.concat(F.lit("About "), years, F.lit(" years of recorded experience"))
    return F.concat_ws(
        ". ",
        F.when(F.size(r["must"]) > 0, F.when(F.size(r["must_missing"]) > 0, F.concat(F.lit("Missing must-have skills: "), F.array_join(r["must_missing"], ", "))).otherwise(F.concat(F.lit("Has all "), F.size(r["must"]).cast("string"), F.lit(" must-have skills")))),
        F.when(F.size(r["nice"]) > 0, F.concat(F.lit("Has "), r["nice_hits"].cast("string"), F.lit(" of "), F.size(r["nice"]).cast("string"), F.lit(" nice-to-have skills"))),
        F.when(has_years & (r["short"] > 0), F.concat(recorded, F.lit(" against a minimum of "), r["min_years"].cast("string"))).when(has_years & (r["over"] > 0), F.concat(recorded, F.lit(", above the range of up to "), r["max_years"].cast("string"))),
        F.when(~r["met"], F.when(r["education"] == "none", no_degree).otherwise(lower)),
        F.when(r["before"] > r["limit"], F.concat(F.lit("Score capped at "), general(r["limit"]), F.lit(" because "), what, F.lit(" missing"))),
    )
