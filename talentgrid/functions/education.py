"""Degrees and schools of a text as an array of structs, by Columns over its lines.

The lines are those after the first heading of an education section, up to the next line in capitals; without such a heading
all lines count. A line that names both a degree and a school is an entry; else a degree and a school on two lines that follow
one another, in either order, are one. An entry that repeats school and degree in any case stays once, the first one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a heading, a degree, a school and a place behind a school look like.
HEADING = r"(?:education|academic background|degrees?|qualifications?|academics?)[\s\-:]+"
NEXT_HEADING = r"^[A-Z][A-Z\s&/-]{3,}$"
DEGREE = r"\b(?:B\.?[AS]\.?|Bachelor(?:'s)?|M\.?[AS]\.?|Master(?:'s)?|MBA|Ph\.?D\.?|Doctorate|Associate|Diploma|Certificate)\b"
SCHOOL = r"\b(?:(?:[A-Z][A-Za-z.&'() -]{0,40}? )?(?:University|College|Institute|School|Academy|Uni)\b[A-Za-z.&'() -]*|MIT|UCLA|NYU|NYIT|Caltech|CalTech)\b"
PLACE = r"\s*[-,|]\s*[A-Z][A-Za-z\s]{2,}$"


def section(text: Column) -> Column:
    """What follows the first heading, up to the next line in capitals; the whole text without a heading."""
    rest = F.regexp_replace(text, r"(?isU)\A.*?" + HEADING, "")
    inside = F.regexp_replace(rest, r"(?msU)" + NEXT_HEADING + r".*", "")
    return F.when(text.rlike("(?iU)" + HEADING), F.trim(inside)).otherwise(text)


def school(line: Column) -> Column:
    """The school that a line names, without a place behind it; empty without one."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_extract(line, "(?iU)" + SCHOOL, 0)), PLACE, ""))


def entries(text: Column) -> Column:
    """array<struct<institution, degree>> of a text; empty for null and blank texts."""
    lines = F.transform(F.split(section(F.coalesce(text, F.lit(""))), r"\r\n|[\n\r]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    read = F.transform(lines, lambda s: F.struct(school(s).alias("institution"), F.trim(F.regexp_extract(s, "(?iU)" + DEGREE, 0)).alias("degree"), s.rlike("(?iU)" + SCHOOL).alias("at")))
    following = F.concat(F.slice(read, 2, F.greatest(F.size(read) - 1, F.lit(0))), F.array(F.struct(F.lit("").alias("institution"), F.lit("").alias("degree"), F.lit(False).alias("at"))))

    def pair(one: Column, after: Column) -> Column:
        here = F.struct(one["institution"].alias("institution"), one["degree"].alias("degree"))
        school_below = F.struct(after["institution"].alias("institution"), one["degree"].alias("degree"))
        degree_below = F.struct(one["institution"].alias("institution"), after["degree"].alias("degree"))
        has = lambda x: x["degree"] != ""
        return F.when(has(one) & one["at"], here).when(has(one) & after["at"], school_below).when(one["at"] & has(after), degree_below)

    found = F.filter(F.zip_with(read, following, pair), lambda e: e["institution"] != "")
    key = lambda e: F.struct(F.lower(e["institution"]), F.lower(e["degree"]))
    return F.aggregate(
        found, F.array().cast("array<struct<institution:string,degree:string>>"),
        lambda had, e: F.when(F.exists(had, lambda h: key(h) == key(e)), had).otherwise(F.concat(had, F.array(e))),
    )
