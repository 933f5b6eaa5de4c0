"""Operators on texts bound to documents and pages, with their SQL.

A document becomes a resume by one sentence a line and by headings in place of short lines that begin with certain letters (``HEADED``), in Spark and SQL alike.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from talentgrid.bindings import QUERIES, query  # noqa: F401  the tests take the queries from here
from talentgrid.functions import cleaning as C
from talentgrid.functions import sections as S
from talentgrid.functions import service
from talentgrid.sources import pages as P
from talentgrid.sources.structs import JOB, Field, structs
from talentgrid.sources.tables import spread, table

#: First letters of lines of at most 90 characters, and the headings that take the lines' place.
HEADED = (
    ("EÉÈ", "EXPERIENCE"), ("I", "Education:"), ("T", "## SKILLS"), ("L", "Summary"), ("AÄ", "Skills and more"), ("D", "Military service of"), ("O", "Languages --"), ("H", "PROJECTS"),
)
LINE = "[^\\n]{0,89}$"


def resumes(spark, d):
    text = F.replace("text", F.lit(". "), F.lit(".\n"))
    for words, heading in HEADED:
        text = F.regexp_replace(text, rf"(?m)^[{words}]{LINE}", heading)
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


def resumes_sql() -> str:
    text = "replace(text, '. ', '.' || chr(10))"
    for words, heading in HEADED:
        text = f"regexp_replace({text}, '(?m)^[{words}]{LINE}', '{heading}', 'g')"
    return f"(SELECT doc_id, {text} AS text FROM documents)"


# ---------------------------------------------------------------- sections
@query("document_sections")
def document_sections(spark, d):
    return S.section_rows(resumes(spark, d), "doc_id", S.sections(F.col("text")))


_TYPES_SQL = " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in S.BLOCK_HEADINGS.items())


@query("document_blocks", rf"""
    WITH cut AS (SELECT doc_id, string_split_regex(regexp_replace(text, '\n\z', ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS lines FROM {resumes_sql()}),
    numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM cut),
    typed AS (SELECT *, CASE {_TYPES_SQL} END AS type FROM numbered),
    runs AS (SELECT *, last_value(type IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM typed)
    SELECT doc_id, section, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE type IS NULL), '') AS content FROM runs WHERE section IS NOT NULL GROUP BY 1, 2""")
def document_blocks(spark, d):
    return S.section_rows(resumes(spark, d), "doc_id", S.blocks(F.col("text")))


@query("page_sections")
def page_sections(spark, d):
    texts = P.page_texts(table(spark, d, "pages"))
    return S.section_rows(texts, "page_id", S.sections(F.col("text"))).where("section <> 'full_text'")


# ---------------------------------------------------------------- deep cleaning
#: What takes the place of common words, so that every step finds work.
SPOILED = (
    (" the ", " 39.9Minrevenueimpactthroughstrategichires "), (" and ", " teamLead12Reduced Talentacquisition,ledABCcorp "), (" of ", " generating3.5Mrevenue $4 M GoogleIncfullcycle "),
    (" le ", "executedenterprise Developandexecuteenterprise\t spendfromapproximately "), (" die ", " machinelearning 2019Present20182020 • endtoend "),
    (" el ", " jo . doe @ example . com www . house . org xskillsy  "), (". ", "."), (", ", ",Realtime "),
)


def spoiled(spark, d):
    text = F.col("text")
    for a, b in SPOILED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text.alias("text"))


def _clean_sql() -> str:
    text = "text"
    for a, b in SPOILED:
        text = f"replace({text}, '{a}', '{b}')"
    steps = [f"s0 AS (SELECT doc_id, {text} AS original, {text} AS x FROM documents)"]
    for i, (_, rules, words) in enumerate(C.STEPS, 1):
        x = "x"
        for pattern, replacement in [*rules, *((rf"(?i)\b{a}\b", b) for a, b in sorted((words or {}).items(), key=lambda w: -len(w[0])))]:
            put = re.sub(r"\$(\d)", r"\\\1", replacement.replace(r"\$", "\0")).replace("\0", "$")
            x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')" if put != "\n" and put != "\n\n" else f"regexp_replace({x}, '{pattern}', repeat(chr(10), {len(put)}), 'g')"
        steps.append(f"s{i} AS (SELECT doc_id, original, {x} AS x FROM s{i - 1})")
    return ", ".join(steps)


@query("clean_deep", f"WITH {_clean_sql()} SELECT doc_id, x AS cleaned, length(original) - length(x) AS char_reduction FROM s{len(C.STEPS)}")
def clean_deep(spark, d):
    found = C.cleaned(spoiled(spark, d), counts=False)
    return found.select("doc_id", "cleaned", C.quality(F.col("original"), F.col("cleaned"))["char_reduction"].cast("long").alias("char_reduction"))


@query("clean_report")
def clean_report(spark, d):
    """Changes of every step and the measures of success for each document."""
    return C.cleaned(spoiled(spark, d)).select("doc_id", "changes.*", C.quality(F.col("original"), F.col("cleaned")).alias("q")).select("*", "q.*").drop("q")


# ---------------------------------------------------------------- structs of pages
#: The fields of a job page, with what the given pages have behind the usual selectors.
PAGE_FIELDS = tuple(
    Field(f.name, f.selectors + more, f.default, f.many)
    for f, more in zip(JOB, (("article h1", "h1"), ("nav li a",), ("footer",), ("article p",), ("article p b", "nav ul li"), (".ad", "div.ad")))
)


@query("page_structs")
def page_structs(spark, d):
    found = structs(table(spark, d, "pages"), PAGE_FIELDS)
    return found.withColumn("requirements", F.array_join("requirements", "|"))


# ---------------------------------------------------------------- service entries
#: What takes the place of common words, so that documents tell of service.
SERVED = (
    (" the ", "\n\nMILITARY SERVICE\nSergeant, U.S. Army, 2003 - 2007\n- led a team of nine\n- kept the stores\n"), (" of ", " 82nd Airborne Division, Fort Bragg; Top Secret, bronze star\n\n"),
    (" and ", " deployed to Kuwait in the spring. cpt 11B\n"), (" le ", "\nSUMMARY OF WORK\n\nNavy petty officer 01/1999 - present, Norfolk\n\n"), (" die ", " Space Force colonel 2020 to now\n"), (" el ", "\n\nColumbus, OH 1999 - 2003\n* one task\n\n"),
)


def served(spark, d):
    text = F.col("text")
    for a, b in SERVED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text.alias("text"))


@query("service_entries")
def service_entries(spark, d):
    # an inner posexplode would have Spark infer a filter on the entries and push it below all steps, which are then run once more for each of its uses
    e = service.service_entries(served(spark, d)).select("doc_id", F.posexplode_outer("entries").alias("place", "e")).where("place IS NOT NULL")
    lists = [F.array_join(f"e.{c}", "|").alias(c) for c in ("responsibilities", "deployments", "awards", "clearances", "training")]
    return e.select("doc_id", "place", "e.branch", "e.rank", "e.unit", "e.start_date", "e.end_date", "e.location", *lists, "e.confidence")
