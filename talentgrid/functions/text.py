"""Text work as Columns: de-identification, cleaning, normal forms, terms and evidence, hashes, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from talentgrid.functions import vocabulary as V


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# ---------------------------------------------------------------- de-identification
def scrubbed(c: Column, name_parts: tuple[str, ...] = ()) -> Column:
    """Names (whole words, any case), then addresses, links and phone numbers replaced, in that order."""
    for part in name_parts:
        c = F.regexp_replace(c, rf"(?i)\b{re.escape(part)}\b", V.NAME_GONE)
    for pattern, mark in ((V.EMAIL, V.EMAIL_GONE), (V.LINK, V.LINK_GONE), (V.PHONE, V.PHONE_GONE)):
        c = F.regexp_replace(c, pattern, mark)
    return c


def name_parts(c: Column) -> Column:
    """The full name and its parts of two characters or more."""
    parts = F.filter(F.transform(F.split(F.trim(c), r"[\s,.]+"), lambda p: F.regexp_replace(p, r"^[()'\"]+|[()'\"]+$", "")), lambda p: F.length(p) >= 2)
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.trim(c)), parts))


# ---------------------------------------------------------------- normal forms
#: Latin letters and what is left of them without marks (fixed values).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tag(c: Column) -> Column:
    """lower-kebab-case of at most 50 characters; null where nothing is left."""
    ascii_only = F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), r"[^\x00-\x7F]", "")
    words = F.replace(F.replace(ascii_only, F.lit("+"), F.lit("plus")), F.lit("#"), F.lit("sharp"))
    kebab = F.regexp_replace(F.regexp_replace(words, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.nullif(F.regexp_replace(F.substring(kebab, 1, 50), "-+$", ""), F.lit(""))


def skill_key(c: Column) -> Column:
    return spaced(F.regexp_replace(F.lower(c), r"[^a-z0-9+#.\-_/ ]", " "))


def skill_token(c: Column) -> Column:
    """A skill of a job for counting: lower case, without characters that names of skills don't have."""
    return spaced(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9+#.\-_/ ]+", ""))


def answer_key(c: Column) -> Column:
    """The normal form that extraction scoring compares."""
    return spaced(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9@+]+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def plain_dashes(c: Column) -> Column:
    return F.translate(c, "–—―", "---")


def storable(c: Column) -> Column:
    """Text a database takes: no control characters, no runs of blank lines or spaces."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def stage_text(c: Column) -> Column:
    """How people name a stage, without article, separators and the word stage, round or step."""
    plain = F.trim(F.regexp_replace(F.lower(c), r"[\s_\-]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"^the ", ""), r" (stage|round|step)$", ""))


def degree_level(c: Column) -> Column:
    """phd, master, bachelor or none; null where the degree isn't known."""
    text = F.replace(spaced(F.regexp_replace(F.lower(c), r"[.']", "")), F.lit("high school"), F.lit("highschool"))
    tokens = F.regexp_extract_all(text, F.lit("([a-z]+)"), F.lit(1))
    out = F.when(text.contains("doctor of philosophy"), "phd")
    for level, words in V.DEGREE_WORDS:
        out = out.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), level)
    return out


def education_rank(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, V.EDUCATION_LEVELS)), level), F.lit(0)) - 1


# ---------------------------------------------------------------- terms and evidence
def query_terms(c: Column) -> Column:
    """The specific words of a search in order: no stopwords, no role words, no other words under three characters."""
    tokens = F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9][a-z0-9+#.\-]*)"), F.lit(1)), lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""))
    idle = F.array(*map(F.lit, sorted(V.STOPWORDS | V.ROLE_WORDS | {""})))
    short = F.array(*map(F.lit, sorted(V.SHORT_TERMS)))
    return F.array_distinct(F.filter(tokens, lambda t: ~F.array_contains(idle, t) & ((F.length(t) >= 3) | F.array_contains(short, t))))


def terms_of(query: str) -> list[str]:
    """``query_terms`` of one text, for plans that need the words while they are built."""
    return SparkSession.active().range(1).select(query_terms(F.lit(query))).first()[0]


#: Endings that a word may lose and what stands there instead (fixed values). Of the endings of a number, and of those of a
#: verb, the first that fits counts.
NUMBER_ENDINGS = ((r"(.{3,})ies", r"\1y"), (r"(.{3,}[^s])s", r"\1"))
VERB_ENDINGS = ((r"(.{4,})ing", r"\1"), (r"(.{4,})ed", r"\1"))
SILENT_ENDINGS = ((r"(.{5,})e", r"\1"),)


def shortened(word: str, endings: tuple[tuple[str, str], ...]) -> list[str]:
    """The word with the first of these endings that fits replaced, if any does."""
    fits = [(m, to) for pattern, to in endings if (m := re.fullmatch(pattern, word))]
    return [m.expand(to) for m, to in fits[:1]]


def stems(term: str) -> list[str]:
    """The term and the beginnings of words of four characters or more that it also stands for."""
    plain = [term, *shortened(term, NUMBER_ENDINGS), *shortened(term, VERB_ENDINGS)]
    bare = [s for word in plain for s in shortened(word, SILENT_ENDINGS)]
    return [term, *(s for s in dict.fromkeys(plain[1:] + bare) if len(s) >= 4)]


def term_pattern(term: str) -> str:
    """One pattern for a term: itself (as a whole word if short), its stems as beginnings of words, its aliases."""
    word = lambda s, whole: re.escape(s) + (r"(?![a-z0-9])" if whole else "")
    short = len(term) <= 3
    ways = [word(term, short)] + ([] if short else [word(s, False) for s in stems(term)[1:]]) + [word(a, len(a) <= 3) for a in V.ALIASES.get(term, ())]
    return r"(?<![a-z0-9])(?:" + "|".join(ways) + ")"


def has_term(c: Column, term: str) -> Column:
    """Whether a text shows a term, with hyphens as they are, left out, or as spaces."""
    low, pattern = F.lower(F.coalesce(c, F.lit(""))), term_pattern(term)
    return low.rlike(pattern) | F.replace(low, F.lit("-"), F.lit("")).rlike(pattern) | F.replace(low, F.lit("-"), F.lit(" ")).rlike(pattern)


def evidence(c: Column, terms: list[str]) -> Column:
    """The terms that a text shows, in the order of the query."""
    shown = [F.when(has_term(c, t), F.lit(t)) for t in terms]
    return F.filter(F.array(*shown), lambda t: t.isNotNull()) if shown else F.array().cast("array<string>")


def evidence_holds(matched: Column, terms: list[str]) -> Column:
    """Enough for a partial match: two words, the query's only word, or one that means one thing only."""
    odd = F.array(*map(F.lit, sorted(V.AMBIGUOUS)))
    return (F.size(matched) >= 2) | (F.size(matched) >= 1) & (F.lit(len(terms) <= 1) | F.exists(matched, lambda t: ~F.array_contains(odd, t)))


def band(similarity: Column, matched: Column, terms: list[str], floor: float = 0.0) -> Column:
    return F.when(similarity < floor, "weak").when(similarity >= V.STRONG, "strong").when((similarity >= V.MODERATE) & evidence_holds(matched, terms), "moderate").otherwise("weak")


def match_kind(in_position: Column, matched: Column) -> Column:
    return F.when(F.size(in_position) > 0, "role").when(F.size(matched) > 0, "context").otherwise("semantic")


# ---------------------------------------------------------------- hashes, templates, bullets, dates
def cache_key(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.sha2(c, 256))


def short_id(c: Column) -> Column:
    """A number under a million from the first eight hex digits of a content hash."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % 1_000_000


def is_uuid(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def placeholders(c: Column) -> Column:
    """Names between double braces, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\{\s*([a-z_]+)\s*\}\}"), F.lit(1)))


def rendered(c: Column, values: dict[str, Column]) -> Column:
    """A template with its known placeholders filled; the others stay."""
    for name, value in values.items():
        # a value is put in literally: what regular expressions know as references is escaped
        literal = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"([\\$])", r"\\$1")
        c = F.regexp_replace(c, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), literal)
    return c


def bullets(c: Column) -> Column:
    """Lines, or marked items, or sentences of more than 15 characters, trimmed."""
    lines = F.split(c, r"\n|•|(?<=[.!?])\s+")
    return F.filter(F.transform(lines, lambda s: F.regexp_replace(s, r"^[\s\-*•·]+|\s+$", "")), lambda s: F.length(s) > 15)


#: Date formats tried in order (fixed values); what names no month or day starts the year or month.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy", "MM/yyyy", "yyyy-MM", "yyyy")


def iso_date(c: Column, today: Column) -> Column:
    """A free-text date; words for the present are today, what isn't a date is null."""
    text = F.trim(c)
    tried = [F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS]
    return F.when(F.lower(text).isin("present", "current", "now", "ongoing", "today"), today).otherwise(F.coalesce(*tried))
