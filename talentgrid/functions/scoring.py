"""Job and candidate scoring as Columns. Every step keeps its inputs and results, so a score can be explained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions import vocabulary as V
from talentgrid.functions.sections import let


def any_in(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def at_most(c: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """The value of the first step whose bound isn't below c."""
    out = F.when(F.lit(False), 0.0)
    for bound, value in steps:
        out = out.when(c <= bound, float(value))
    return out.otherwise(float(beyond))


def years_in(low: Column) -> Column:
    """The years of experience that a lower-case text states, by the first pattern that gives a number; else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(low, p, g).try_cast("int"), F.lit(0)) for p, g in V.YEAR_PATTERNS))


def level_of(low: Column, years: Column) -> Column:
    """The level by the highest word of a lower-case text, else by the years, else mid."""
    words = F.lit(None).cast("string")
    for level, own in V.LEVEL_WORDS.items():
        words = F.when(any_in(low, own), level).otherwise(words)
    by_years = F.when(years < 2, "entry").when(years < 5, "mid").when(years < 8, "senior").when(years < 12, "lead").when(years >= 12, "principal")
    return F.coalesce(words, by_years, F.lit("mid"))


def usual_years(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in V.LEVEL_YEARS.items() for x in kv]), level)


def seniority(text: Column) -> Column:
    """struct(level, years): years from the first pattern that gives a number; the level from the highest word, else from the
    years; the years from the level where the text has none. A text with neither is mid level."""
    low = F.lower(F.coalesce(text, F.lit("")))
    years = years_in(low)
    level = level_of(low, years)
    return F.struct(level.alias("level"), F.coalesce(years, usual_years(level)).alias("years"))


def experience_score(job_level: Column, job_years: Column, level: Column, years: Column) -> Column:
    """How well level and years fit a job's, from 0 to 100."""
    return experience_match(F.struct(job_level.alias("level"), job_years.alias("years")), F.struct(level.alias("level"), years.alias("years")))["score"]


def experience_match(job: Column, candidate: Column) -> Column:
    """struct(level_diff, level_match, years_diff, years_match, adjustment, score) of two seniorities."""
    order = F.array(*map(F.lit, V.LEVELS))
    place = lambda c: F.array_position(order, c["level"]).cast("int")
    gap, years = place(candidate) - place(job), candidate["years"] - job["years"]
    level_match = at_most(gap, [(-3, 20), (-2, 40), (-1, 70), (0, 100), (1, 90), (2, 80)], 60)
    years_match = at_most(years, [(-4, 30), (-2, 60), (1, 100), (3, 90), (5, 80)], 70)
    too_high = job["level"].isin("entry", "junior") & candidate["level"].isin("senior", "lead", "principal")
    too_low = job["level"].isin("principal", "executive") & candidate["level"].isin("entry", "junior")
    adjustment = F.when(too_high, -20.0).when(too_low, -25.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), level_match * 0.7 + years_match * 0.3 + adjustment))
    return F.struct(gap.alias("level_diff"), level_match.alias("level_match"), years.alias("years_diff"), years_match.alias("years_match"), adjustment.alias("adjustment"), score.alias("score"))


def skill_match(job: Column, candidate: Column) -> Column:
    """struct(score, exact, partial, missing, coverage_bonus, no_data). A wanted skill counts full if the candidate has it, half
    if one contains the other and their lengths differ by three at most; repeated and empty wanted skills count in the total."""
    key = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda s: F.trim(F.lower(s)))
    sides = F.struct(key(job).alias("want"), key(candidate).alias("have"))

    def divided(x: Column) -> Column:
        held = lambda s: F.array_contains(x["have"], s)
        return F.struct(x["want"].alias("want"), x["have"].alias("have"), F.filter(x["want"], lambda s: (s != "") & held(s)).alias("exact"), F.filter(x["want"], lambda s: (s != "") & ~held(s)).alias("rest"))

    def nearly(x: Column) -> Column:
        near = lambda s: F.exists(x["have"], lambda h: (F.abs(F.length(s) - F.length(h)) <= 3) & (h.contains(s) | s.contains(h)))
        return F.struct(F.size(x["want"]).alias("total"), F.size(x["have"]).alias("own"), x["want"].alias("want"), x["exact"].alias("exact"), x["rest"].alias("rest"), F.filter(x["rest"], near).alias("partial"))

    def result(x: Column) -> Column:
        hits = F.size(x["exact"]) + F.size(x["partial"])
        bonus = hits >= x["total"] * F.lit(0.8)
        raw = (F.size(x["exact"]) * 100.0 + F.size(x["partial"]) * 50.0) / F.nullif(x["total"], F.lit(0))
        empty = (x["total"] == 0) | (x["own"] == 0)
        score = F.when(empty, V.NO_SIGNAL).otherwise(F.least(F.lit(100.0), raw * F.when(bonus, 1.1).otherwise(1.0)))
        none = F.array().cast("array<string>")
        missing = F.filter(x["rest"], lambda s: ~F.array_contains(x["partial"], s))
        return F.struct(
            score.alias("score"), F.when(empty, none).otherwise(x["exact"]).alias("exact"), F.when(empty, none).otherwise(x["partial"]).alias("partial"),
            F.when(empty, F.filter(x["want"], lambda s: s != "")).otherwise(missing).alias("missing"), (~empty & bonus).alias("coverage_bonus"), empty.alias("no_data"),
        )

    return let(let(let(sides, divided), nearly), result)


def plain_title(c: Column) -> Column:
    """A title without one leading rank and one trailing grade; the first of each list that fits is taken."""
    c = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    lead = F.regexp_replace(c, "^(?:" + "|".join(V.TITLE_PREFIXES) + r") \s*", "")
    return F.regexp_replace(lead, r"\s* (?:" + "|".join(V.TITLE_SUFFIXES) + ")$", "")


def role_category(plain: Column, for_role: bool) -> Column:
    """The first category with a word in a plain title, else null."""
    out = F.when(F.lit(False), "")
    for name, words in V.ROLE_CATEGORIES.items():
        out = out.when(any_in(plain, words + (V.ROLE_ONLY_WORDS.get(name, ()) if for_role else ())), name)
    return out


def is_pair(a: Column, b: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(reduce(lambda x, y: x | y, ((a == p) & (b == q) | (a == q) & (b == p) for p, q in pairs)), F.lit(False))


def skill_penalty(score: Column, job: Column, own: Column) -> Column:
    """The skill score, cut to three tenths between categories whose skills don't carry over."""
    return F.when(is_pair(job, own, V.NEAR_PAIRS), score * 0.3).otherwise(score)


def relationship(job_title: Column, position: Column, job: Column, own: Column) -> Column:
    """How the categories of two titles stand to each other; a blank title is missing."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(blank(job_title) | blank(position), "missing").when(is_pair(job, own, V.FAR_PAIRS), "highly_incompatible").when(is_pair(job, own, V.NEAR_PAIRS), "moderately_incompatible")
        .when(job == own, "same_category").when(job.isNotNull() & own.isNotNull(), "unrelated").otherwise("uncategorized")
    )


def role_score(base: Column, kind: Column) -> Column:
    """The role score, from 0 to 100, of a base score and a relationship."""
    score = F.when(kind == "highly_incompatible", F.least(base * 0.15, F.lit(12.0))).when(kind == "moderately_incompatible", F.least(base * 0.2, F.lit(20.0)))
    score = score.when(kind == "same_category", F.least(base * 1.3, F.lit(100.0))).otherwise(base)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def role_match(job_title: Column, position: Column, similarity: Column, job: Column, own: Column) -> Column:
    """struct(score, base, relationship) of two titles with their categories. ``similarity`` is the cosine of the titles'
    embeddings, null where there is none."""
    kind = relationship(job_title, position, job, own)
    base = F.when(kind == "missing", V.NO_SIGNAL).otherwise(F.coalesce(similarity * 100.0, F.lit(V.NO_SIGNAL)))
    return F.struct(role_score(base, kind).alias("score"), base.alias("base"), kind.alias("relationship"))


def tier_name(role: Column) -> Column:
    severe, moderate, standard = V.TIERS
    return F.when(role < severe[1], severe[0]).when(role < moderate[1], moderate[0]).otherwise(standard[0])


def blended(name: Column, skill: Column, role: Column, experience: Column) -> Column:
    """The weighted score of a tier."""
    out = F.when(F.lit(False), 0.0)
    for own, _, a, b, c, factor in V.TIERS:
        out = out.when(name == own, (skill * a + role * b + experience * c) * factor)
    return out


def tier(role_score: Column) -> Column:
    """struct(name, skill, role, experience, multiplier): how the parts weigh at a role score."""
    shape = lambda t: F.struct(F.lit(t[0]).alias("name"), *(F.lit(v).alias(k) for k, v in zip(("skill", "role", "experience", "multiplier"), t[2:])))
    severe, moderate, standard = V.TIERS
    return F.when(role_score < severe[1], shape(severe)).when(role_score < moderate[1], shape(moderate)).otherwise(shape(standard))


def explanation(matching: Column, role: Column, skill: Column, experience: Column) -> Column:
    """Three sentences on role, skills and seniority."""
    grade = lambda c: F.when(c >= 90, "Excellent").when(c >= 70, "Good").when(c >= 50, "Fair").otherwise("Limited")
    return F.concat_ws(". ", F.concat(grade(role), F.lit(" role alignment")), F.concat(grade(skill), F.lit(" skill coverage: "), F.size(matching).cast("string"), F.lit(" matching")), F.concat(grade(experience), F.lit(" seniority fit")))


def job_similarity(title_a: Column, title_b: Column, skills_a: Column, skills_b: Column, place_a: Column, place_b: Column) -> Column:
    """Similarity of two jobs from 0 to 100: titles by shared words, skills by Jaccard, places by equality."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    title = F.size(F.array_intersect(words(title_a), words(title_b))) / F.greatest(F.size(words(title_a)), F.size(words(title_b)))
    return 100 * (0.35 * title + 0.40 * jaccard(skills_a, skills_b) + 0.10 * F.when(place_a == place_b, 1.0).otherwise(0.3) + 0.15 * 0.3)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))
