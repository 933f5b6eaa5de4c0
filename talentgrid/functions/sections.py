"""Sections of a text: a classifier of heading lines and running groups of lines, as a map from section to content.

Everything is one Column per text: lines, the type of each line, the places of headings, and slices of lines between them. Work
grows with the lines of a text and no line leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
#: Section of a heading by the first list that has a word of it; headings without any are general.
SECTION_WORDS = {
    "experience": ("experience", "work", "employment", "career"),
    "education": ("education", "academic", "degree"),
    "skills": ("skill", "competenc", "expertise", "qualification"),
    "summary": ("summary", "profile", "objective", "about", "overview"),
    "projects": ("project",),
    "certifications": ("certification", "certificate", "license", "credential"),
    "languages": ("language",),
    "military": ("military", "service"),
}
GENERAL = "general"
#: Headings that stand alone on a line.
PLAIN_HEADINGS = (
    "experience", "work experience", "professional experience", "employment", "career history", "education", "academic background", "degrees", "skills", "core competencies",
    "expertise", "qualifications", "projects", "project experience", "personal projects", "certifications", "certificates", "licenses", "credentials", "languages",
    "language proficiency", "military", "military experience", "military service", "summary", "profile", "objective", "about", "overview", "contact", "contact information",
)
#: Headings marked with ##, by section.
MARKED_HEADINGS = {
    "summary": r"(?:PROFESSIONAL\s+)?(?:CAREER\s+)?SUMMARY|(?:PROFESSIONAL\s+)?PROFILE|OBJECTIVE|ABOUT(?:\s+ME)?|OVERVIEW",
    "experience": r"(?:WORK\s+)?EXPERIENCE|PROFESSIONAL\s+EXPERIENCE|EMPLOYMENT|WORK\s+HISTORY|CAREER\s+HISTORY",
    "education": r"EDUCATION|EDUCATIONAL\s+BACKGROUND|ACADEMIC\s+BACKGROUND|DEGREES?",
    "skills": r"(?:TECHNICAL\s+)?SKILLS|CORE\s+(?:COMPETENCIES|SKILLS)|EXPERTISE|QUALIFICATIONS|KEY\s+SKILLS",
    "projects": r"PROJECTS|PROJECT\s+EXPERIENCE|PERSONAL\s+PROJECTS|KEY\s+PROJECTS",
    "certifications": r"CERTIFICATIONS|CERTIFICATES|LICENSES|CREDENTIALS",
    "languages": r"LANGUAGES|LANGUAGE\s+PROFICIENCY",
    "military": r"MILITARY(?:\s+EXPERIENCE)?|MILITARY\s+SERVICE",
}
#: Capital words that are headings where they are a whole line.
CAPITAL_HEADINGS = "CONTACT|PROFILE|EXPERIENCE|EDUCATION|SKILLS|PROJECTS|CERTIFICATIONS|LANGUAGES|MILITARY|SUMMARY|OBJECTIVE"
#: Words that make a short line a heading where a text has no clear ones.
LOOSE_WORDS = ("experience", "education", "skills", "summary", "profile", "objective", "projects", "certifications", "languages")
#: Signs of contact data; two of them make a summary a contact block.
CONTACT_SIGNS = (r"\d{3}[-.]?\d{3}[-.]?\d{4}", r"@\w+\.\w+", r"linkedin\.com", r"github\.com", r"\b[A-Z]{2}\s+\d{5}")
#: What a summary looks like in a text whose summary section is contact data, in order; over 50 characters count.
SUMMARY_LIKE = (
    r"(?is)(?:^|\n)\s*##\s*PROFILE\s*(.*?)(?=\n\s*##|\n\s*[A-Z\s]{3,}\s*$|$)",
    r"(?is)(?:^|\n)(Strategic\s+\w+.*?(?:years?|experience).*?)(?=\n\s*##|\n\s*[A-Z\s]{3,}\s*$)",
    r"(?is)(?:^|\n)(Experienced\s+\w+.*?(?:years?|experience).*?)(?=\n\s*##|\n\s*[A-Z\s]{3,}\s*$)",
)
SUMMARY_LENGTH = 50
#: Beginnings of lines that open a block, for the plain splitter.
BLOCK_HEADINGS = {
    "education": r"(?i)^\s*(?:education|academic background)\b",
    "experience": r"(?i)^\s*(?:work experience|professional experience|experience|employment)\b",
    "skills": r"(?i)^\s*skills?\b",
    "military": r"(?i)^\s*(?:military experience|military service|armed forces|defense experience|service history|military background|military career)\b",
}


# ---------------------------------------------------------------- lines and headings
def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def heading_type(c: Column) -> Column:
    """The section that a heading opens."""
    low, out = F.lower(c), None
    for name, words in SECTION_WORDS.items():
        hit = F.rlike(low, F.lit("|".join(words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(GENERAL)


def looks_like_heading(line: Column) -> Column:
    """All capitals of 3 to 50 characters, or at most 50 with a word of a section."""
    short = F.length(line) <= 50
    capitals = (line == F.upper(line)) & (line != F.lower(line)) & (F.length(line) >= 3)
    return short & (capitals | F.rlike(F.lower(line), F.lit("|".join(LOOSE_WORDS))))


def is_contact(text: Column) -> Column:
    signs = sum((F.rlike(text, F.lit(p)).cast("int") for p in CONTACT_SIGNS), F.lit(0))
    return signs >= 2


def clear_type(line: Column) -> Column:
    """The section that a clear heading line opens, null for other lines: a heading alone, or one marked with ##."""
    marked = F.lit(None).cast("string")
    for name, pattern in reversed(MARKED_HEADINGS.items()):
        marked = F.when(F.rlike(line, F.lit(rf"(?i)^\s*##\s*(?:{pattern})(?:\s*:|\s*$)")), name).otherwise(marked)
    word = F.regexp_extract(line, r"(?i)^\s*(" + "|".join(sorted(PLAIN_HEADINGS, key=len, reverse=True)) + r")\s*[:\-–—]*\s*$", 1)
    return F.when(word != "", heading_type(word)).otherwise(marked)


def after_mark(line: Column) -> Column:
    """What follows the colon of a marked heading on its line."""
    every = "|".join(MARKED_HEADINGS.values())
    return F.regexp_extract(line, rf"(?i)^\s*##\s*(?:{every})\s*:(.*)$", 1)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) where value is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def segments(lines: Column, types: Column) -> Column:
    """The runs of lines from one heading to the next, as (type, lines) in order; the first run has no heading and a null type."""
    places = F.filter(F.transform(types, lambda t, i: F.when(t.isNotNull(), i + 1)), lambda p: p.isNotNull())
    starts = F.concat(F.array(F.lit(0)), places)
    ends = F.concat(places, F.array(F.size(lines) + 1))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.struct(F.when(s["a"] > 0, F.get(types, s["a"] - 1)).alias("type"), F.slice(lines, s["a"] + 1, s["b"] - s["a"] - 1).alias("lines")))


# ---------------------------------------------------------------- sections
def _prepared(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit(" ")), r"\r\n|\r", "\n"), " {2,}", " ")
    return F.regexp_replace(text, rf"(?m)^({CAPITAL_HEADINGS})\s*$", "## $1")


def _clear(lines: Column) -> Column:
    """(section, content) from the first heading of each section to the next of these; empty ones are left out."""
    names = [*SECTION_WORDS, GENERAL]

    def cut(types: Column) -> Column:
        found = F.array_sort(F.filter(F.array(*[F.struct(F.array_position(types, n).alias("at"), F.lit(n).alias("section")) for n in names]), lambda x: x["at"] > 0))
        stops = lambda i: F.when(i + 1 < F.size(found), F.get(found, i + 1)["at"]).otherwise(F.size(lines) + 1)
        content = lambda x, i: F.concat_ws("\n", after_mark(F.get(lines, (x["at"] - 1).cast("int"))), F.array_join(F.slice(lines, (x["at"] + 1).cast("int"), (stops(i) - x["at"] - 1).cast("int")), "\n"))
        return F.transform(found, lambda x, i: F.struct(x["section"], stripped(content(x, i))))

    entries = let(F.transform(lines, lambda x: clear_type(x)), cut)
    return F.filter(entries, lambda e: e["col2"] != "")


def _loose(lines: Column) -> Column:
    """(section, content) by loose headings; where a section comes again, its last content stays."""
    kept = F.filter(F.transform(lines, lambda x: stripped(x)), lambda x: x != "")

    def cut(own: Column) -> Column:
        types = F.transform(own, lambda x: F.when(looks_like_heading(x), heading_type(x)))
        runs = F.filter(F.transform(segments(own, types), lambda s: F.struct(F.coalesce(s["type"], F.lit(GENERAL)).alias("type"), s["lines"].alias("lines"))), lambda s: F.size(s["lines"]) > 0)
        last = lambda name, found: F.struct(F.lit(name).alias("section"), F.array_join(F.try_element_at(F.filter(found, lambda s: s["type"] == name), F.lit(-1))["lines"], "\n").alias("content"))
        return let(runs, lambda found: F.filter(F.array(*[last(n, found) for n in (*SECTION_WORDS, GENERAL)]), lambda e: e["content"].isNotNull()))

    return let(kept, cut)


def sections(text: Column) -> Column:
    """A map from section to content, with the text itself as ``full_text``. Null and empty texts are an empty general section.

    Clear headings decide; a text without any is cut at loose ones. A summary that is contact data becomes ``contact``, and the
    summary is searched for in the text."""
    entry = "array<struct<section: string, content: string>>"

    def of(lines: Column) -> Column:
        clear = lambda own: F.when(F.size(own) > 0, own).otherwise(_loose(lines).cast(entry))
        return let(_clear(lines).cast(entry), clear)

    found = let(F.split(_prepared(text), "\n"), lambda lines: F.map_from_entries(of(lines)))
    like = [stripped(F.regexp_extract(text, p, 1)) for p in SUMMARY_LIKE]
    actual = F.coalesce(*[F.when(F.length(x) > SUMMARY_LENGTH, x) for x in like])

    def settled(own: Column) -> Column:
        contact = F.create_map(F.lit("contact"), F.try_element_at(own, F.lit("summary")))
        rest = F.map_concat(F.map_filter(own, lambda k, _: k != "summary"), contact)
        summary = let(actual, lambda s: F.when(s.isNotNull(), F.map_concat(rest, F.create_map(F.lit("summary"), s))).otherwise(rest))
        return F.when(F.coalesce(is_contact(F.try_element_at(own, F.lit("summary"))), F.lit(False)), summary).otherwise(own)

    full = F.map_concat(let(found, settled), F.create_map(F.lit("full_text"), text))
    return F.when(F.coalesce(text, F.lit("")) == "", F.create_map(F.lit(GENERAL), F.lit(""))).otherwise(full)


def blocks(text: Column) -> Column:
    """A map from section to the lines below its headings; lines before the first heading belong to none, a repeated heading
    adds to its section. Null and empty texts give an empty map."""
    lines = F.split(F.regexp_replace(text, r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ])\z", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")

    def opened(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(BLOCK_HEADINGS.items()):
            out = F.when(F.rlike(line, F.lit(pattern)), name).otherwise(out)
        return out

    def gathered(runs: Column) -> Column:
        of = lambda name: F.filter(runs, lambda s: s["type"] == name)
        entry = lambda name: F.when(F.size(of(name)) > 0, F.struct(F.lit(name).alias("section"), F.array_join(F.flatten(F.transform(of(name), lambda s: s["lines"])), "\n").alias("content")))
        return F.map_from_entries(F.filter(F.array(*[entry(n) for n in BLOCK_HEADINGS]), lambda e: e.isNotNull()))

    found = let(lines, lambda own: let(segments(own, F.transform(own, lambda x: opened(x))), gathered))
    return F.when(F.coalesce(text, F.lit("")) == "", F.create_map().cast("map<string, string>")).otherwise(found)


def section_rows(df: DataFrame, key: str, found: Column) -> DataFrame:
    """(key, section, content): a row for each section of each text."""
    return df.select(F.col(key), F.explode(found).alias("section", "content"))
