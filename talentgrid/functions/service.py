"""Service entries of a text: blocks read into structs, scored by weighted signals, accepted from a score on, and named once each.

A cascade decides which blocks are read: those below a heading of a service section, else all of them; if no entry is accepted,
single lines that name a branch and a rank; if there is still none, the text as one block.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.sections import let
from talentgrid.functions.sections import stripped as stripped_always

# ---------------------------------------------------------------- fixed values
BRANCHES = {
    "Army": r"u\.?s\.?\s*army|\barmy\b|\busa\b|\barng\b",
    "Navy": r"u\.?s\.?\s*navy|\bnavy\b|\busn\b",
    "Air Force": r"air\s*force|\busaf\b",
    "Marines": r"u\.?s\.?\s*marines|marine\s+corps|\bmarines\b|\busmc\b",
    "Coast Guard": r"u\.?s\.?\s*coast\s*guard|\bcoast\s*guard\b|\buscg\b",
    "Space Force": r"space\s*force|\bussf\b",
    "National Guard": r"\bguard\b",
}
RANKS = {
    "Second Lieutenant": r"2nd\s+lieutenant|second\s+lieutenant|2LT",
    "First Lieutenant": r"1st\s+lieutenant|first\s+lieutenant|1LT",
    "Captain": r"captain|cpt",
    "Major": r"major",
    "Lieutenant Colonel": r"lieutenant\s+colonel|ltc",
    "Colonel": r"col",
    "General": r"general",
    "Sergeant": r"sergeant|sgt",
    "Staff Sergeant": r"ssg",
    "Master Sergeant": r"msg",
    "First Sergeant": r"1sg",
}
BASES = (
    "Fort Bragg", "Fort Liberty", "Fort Campbell", "Fort Benning", "Fort Moore", "Camp Pendleton", "Camp Lejeune", "Joint Base Lewis-McChord", "Norfolk", "San Diego", "Fort Hood",
    "Fort Cavazos", "Fort Bliss", "Fort Carson", "Fort Drum", "Fort Stewart", "Fort Riley", "Fort Sill", "Fort Eustis", "Fort Jackson",
)
CLEARANCES = (r"top\s*secret", r"secret", r"ts/sci", r"sci", r"public\s*trust")
AWARDS = (r"bronze\s+star", r"army\s+commendation\s+medal", r"purple\s+heart", r"medal", r"ribbon", r"commendation")
TRAINING = (r"ranger\s+school", r"airborne", r"air\s*assault", r"sere", r"leadership\s+course", r"mos")
_DATE = r"\b\w{3,9}\s+\d{4}|\d{2}/\d{4}|\d{4}-\d{2}|\d{4}"
_NOW = "present|current|now"
DATES = (rf"({_DATE})\s*[–—-]\s*({_DATE}|{_NOW})", rf"(\d{{4}})\s+to\s+(\d{{4}}|{_NOW})")
UNIT = r"\b(\d{1,3}(?:st|nd|rd|th)?\s+[A-Z][A-Za-z()\s]+?\b(?:Division|Brigade|Regiment|Battalion|Company|Group|Squadron|Wing|SFG\(A\)))"
HEADING = (
    r"\b(?:military\s+(?:experience|service|background|career|record|assignment|training)|armed\s+forces|armed\s+services|national\s+guard|reserve|active\s+duty|mos"
    r"|military\s+occupational\s+specialty|service|background|career|record|assignment|training)\b:?"
)
DEPLOYED = r"\b(?:deployed\s+to|deployment\s*:?|operation\s+)[^.;\n]{3,60}"
#: What each signal adds to an entry's score, and the score from which an entry is accepted.
WEIGHTS = {"branch": 0.4, "rank": 0.2, "dates": 0.2, "responsibilities": 0.1, "unit": 0.1, "clearances": 0.05, "awards": 0.05}
ACCEPTED = 0.4
SHORTEST_BLOCK = 10


#: Words of headings and of units, one of which their patterns need.
HEADED = ("military", "armed", "national", "reserve", "active", "mos", "service", "background", "career", "record", "assignment", "training")
UNITS = ("Division", "Brigade", "Regiment", "Battalion", "Company", "Group", "Squadron", "Wing", "SFG(A)")
#: What may stand at an end of a string that ``stripped`` changes.
EDGES = " \t\n\x0b\f\r\x85\u2028\u2029"


# ---------------------------------------------------------------- what a pattern needs
# A pattern is only searched for where a string that it needs is in the text: finding a string takes a small part of the time.
def lowered(c: Column) -> Column:
    """Lower case, with a plain letter for each character that (?iU) takes for one."""
    return F.lower(F.when(_any(c, ("\u017f", "\u212a", "\u0131", "\u0130")), F.translate(c, "\u017f\u212a\u0131\u0130", "skii")).otherwise(c))


def needed(pattern: str) -> tuple[str, ...]:
    """Strings in lower case of which a match of a pattern has one: the longest of each alternative. The pattern has no groups, and
    only escapes are repeated or left out."""
    runs = (re.findall(r"[A-Za-z0-9/ ]+", re.sub(r"\\.[*+?]?", "\0", part)) for part in pattern.split("|"))
    return tuple(dict.fromkeys(max(own, key=len).lower() for own in runs))


def _any(c: Column, strings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in reversed(strings):
        out = F.contains(c, F.lit(x)) | out
    return out


def stripped(c: Column) -> Column:
    """The same as ``sections.stripped``, which only runs where an end has something for it."""
    edge = lambda x: F.contains(F.lit(EDGES), x)
    return let(c, lambda x: F.when(edge(F.substring(x, 1, 1)) | edge(F.substring(x, -1, 1)), stripped_always(x)).otherwise(x))


# ---------------------------------------------------------------- one block
def _first(c: Column, low: Column, table: dict[str, str]) -> Column:
    """The first name of a table whose pattern a text has."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(table.items()):
        out = F.when(_any(low, needed(pattern)) & F.rlike(c, F.lit(f"(?iU){pattern}")), name).otherwise(out)
    return out


def _firsts(xs: Column, name: Column) -> Column:
    """Those of a list whose names equal no earlier one's, in order; names sorted, so the time grows little faster than the list."""
    named = F.array_sort(F.zip_with(name, F.sequence(F.lit(1), F.size(xs)), lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
    own = let(named, lambda ns: F.filter(ns, lambda x, k: (k == 0) | (F.get(ns, k - 1)["n"] != x["n"])))
    places = F.array_sort(F.transform(own, lambda x: x["i"]))
    return F.when(F.size(xs) < 2, xs).otherwise(F.transform(places, lambda i: F.get(xs, i - 1)))


def _distinct(c: Column) -> Column:
    """A list trimmed, without empty entries and without those that differ from an earlier one in case only."""
    kept = F.filter(F.transform(c, lambda x: stripped(x)), lambda x: x != "")
    return let(kept, lambda xs: _firsts(xs, F.transform(xs, lambda x: F.lower(x))))


def _matches(b: Column, low: Column, patterns: tuple[str, ...]) -> Column:
    """The first match of each pattern."""
    return F.filter(F.array(*[F.when(_any(low, needed(p)), F.regexp_extract(b, f"(?iU)({p})", 1)).otherwise("") for p in patterns]), lambda x: x != "")


def _year(c: Column) -> Column:
    def year(x: Column) -> Column:
        low, digits = F.lower(stripped(x)), F.regexp_extract(x, r"(\d{4})", 1)
        return F.when(low.isin(*_NOW.split("|")), "Present").when(digits != "", digits).when(low != "", low)

    return let(c, year)


def _dates(b: Column, low: Column) -> Column:
    """The struct (start, end) of the first range of dates. The block is searched once; the groups are those of the short match."""

    def groups(pattern: str, found: Column, otherwise: Column) -> Column:
        return F.when(found != "", F.struct(*[_year(F.regexp_extract(found, f"(?iU){pattern}", g)).alias(n) for g, n in ((1, "start_date"), (2, "end_date"))])).otherwise(otherwise)

    none = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("start_date", "end_date")])
    search = lambda pattern, may: F.when(may, F.regexp_extract(b, f"(?iU){pattern}", 0)).otherwise("")
    dashed = _any(b, ("-", "–", "—")) & F.rlike(b, F.lit(r"(?U)\d{2}\s*[–—-]\s*\w"))  # digits stand before the dash of every range
    return let(search(DATES[0], dashed), lambda x: groups(DATES[0], x, let(search(DATES[1], _any(low, ("to",))), lambda y: groups(DATES[1], y, none))))


def _place(b: Column, low: Column) -> Column:
    city = F.regexp_extract(b, r"\b([A-Z][a-z]+,\s*[A-Z]{2})\b", 1)
    town = F.regexp_extract(b, r"\b([A-Z][a-z]+\s+[A-Z]{2})\b", 1)
    return F.coalesce(_first(b, low, {n: rf"\b{n}\b" for n in BASES}), F.nullif(city, F.lit("")), F.nullif(town, F.lit("")))


def _unit(b: Column) -> Column:
    return F.when(_any(b, UNITS), F.nullif(stripped(F.regexp_extract(b, UNIT, 1)), F.lit("")))


def _tasks(b: Column) -> Column:
    found = F.transform(F.regexp_extract_all(b, F.lit(r"(?m)^(?:[-•*]\s+|\d+\.\s+)(.+)$"), F.lit(1)), lambda x: stripped(x))
    return _distinct(F.filter(found, lambda x: F.length(x) > 3))


def marked(b: Column) -> Column:
    """A block with what decides on most blocks: branch, rank and dates."""
    own = lambda low: let(_dates(b, low), lambda d: F.struct(b.alias("b"), low.alias("low"), _first(b, low, BRANCHES).alias("branch"), _first(b, low, RANKS).alias("rank"), d["start_date"].alias("start_date"), d["end_date"].alias("end_date")))
    return let(lowered(b), own)


def entry_of(m: Column) -> Column:
    """What a marked block says, with its score."""
    b, low = m["b"], m["low"]
    clear = F.transform(_matches(b, low, CLEARANCES), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)ts\s*/\s*sci", "TS/SCI"), r"(?i)top\s*secret", "Top Secret"), r"(?i)public\s*trust", "Public Trust"))
    deployed = F.when(_any(low, ("deployed", "deployment", "operation")), F.regexp_extract_all(b, F.lit(f"(?iU){DEPLOYED}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    fields = F.struct(
        m["branch"].alias("branch"), m["rank"].alias("rank"), _unit(b).alias("unit"), m["start_date"].alias("start_date"), m["end_date"].alias("end_date"), _place(b, low).alias("location"),
        _tasks(b).alias("responsibilities"), _distinct(deployed).alias("deployments"), _distinct(_matches(b, low, AWARDS)).alias("awards"), _distinct(clear).alias("clearances"),
        _distinct(F.concat(F.regexp_extract_all(b, F.lit(r"\b(\d{2}[A-Z]{1,2})\b"), F.lit(1)), _matches(b, low, TRAINING))).alias("training"),
    )
    return let(fields, lambda e: F.struct(*[e[n].alias(n) for n in FIELDS], score(e).alias("confidence")))


FIELDS = ("branch", "rank", "unit", "start_date", "end_date", "location", "responsibilities", "deployments", "awards", "clearances", "training")


def _points(has: dict[str, Column]) -> Column:
    return sum((F.when(has[name], round(100 * WEIGHTS[name])).otherwise(0) for name in has), F.lit(0))


def _marks(e: Column) -> dict[str, Column]:
    return {"branch": e["branch"].isNotNull(), "rank": e["rank"].isNotNull(), "dates": e["start_date"].isNotNull() | e["end_date"].isNotNull()}


def score(e: Column) -> Column:
    """The weights of the signals that an entry has, 1 at most, in hundredths."""
    has = {
        **_marks(e), "responsibilities": F.size(e["responsibilities"]) > 1,
        "unit": e["unit"].isNotNull(), "clearances": F.size(e["clearances"]) > 0, "awards": F.size(e["awards"]) > 0,
    }
    return F.least(_points(has), F.lit(100)) / 100


def accepted(m: Column) -> Column:
    """Whether a marked block's score is high enough; the signals besides its marks are only read where they can decide it."""
    some = lambda patterns: F.size(_matches(m["b"], m["low"], patterns)) > 0
    others = {"responsibilities": F.size(_tasks(m["b"])) > 1, "unit": _unit(m["b"]).isNotNull(), "clearances": some(CLEARANCES), "awards": some(AWARDS)}
    least, rest = round(100 * ACCEPTED), sum(round(100 * WEIGHTS[n]) for n in others)
    return let(_points(_marks(m)), lambda p: F.when(p >= least, True).when(p + rest < least, False).otherwise(p + _points(others) >= least))


# ---------------------------------------------------------------- all blocks of a text
def _blocks(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: stripped(b)), lambda b: F.length(b) > SHORTEST_BLOCK)


def _section_blocks(text: Column) -> Column:
    """The blocks from a heading on to the next line of capitals; of a block with a heading what follows the heading."""
    heading, capitals = f"(?iU){HEADING}", r"(?m)^\s*[A-Z][A-Z\s&]{3,}$"
    listed = r"^[A-Z\s]{3,40}\s*\d{1,3}$"  # a line of a table of contents
    opens = lambda b: let(lowered(b), lambda low: _any(low, HEADED)) & F.rlike(b, F.lit(heading)) & ~F.rlike(b, F.lit(listed))
    kind = lambda b: F.when(opens(b), 1).when(F.rlike(b, F.lit(capitals)), 2).otherwise(0)
    own = lambda b: stripped(F.regexp_replace(b, rf"(?isU)^.*?{HEADING}", ""))

    def inside(parts: Column, kinds: Column) -> Column:
        """The runs of blocks from one that opens a section to before the next that opens or closes one."""
        starts = F.filter(F.transform(kinds, lambda k, i: F.when(k > 0, i + 1)), lambda at: at.isNotNull())
        end = lambda at, i: F.coalesce(F.get(at, i + 1), F.size(parts) + 1)
        run = lambda at, a, i: F.when(F.get(kinds, a - 1) == 1, F.concat(F.array(own(F.get(parts, a - 1))), F.slice(parts, a + 1, end(at, i) - a - 1))).otherwise(F.array().cast("array<string>"))
        return F.flatten(let(starts, lambda at: F.transform(at, lambda a, i: run(at, a, i))))

    parts = F.transform(F.split(text, r"\n\s*\n"), lambda b: stripped(b))
    kept = let(parts, lambda ps: let(F.transform(ps, kind), lambda ks: inside(ps, ks)))
    return F.filter(kept, lambda b: F.length(b) > SHORTEST_BLOCK)


def _accepted(blocks: Column) -> Column:
    """The accepted blocks with their marks; equal ones, which say the same, once."""
    return F.filter(F.transform(F.array_distinct(blocks), lambda b: marked(b)), lambda m: accepted(m))


def service_entries(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, entries) of every text: accepted entries in order, one for each branch, unit and dates in any case. Null and empty texts
    have none. The cascade runs column by column, and a later step reads only texts that have no entry yet."""
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_blocks", let(_section_blocks(F.col("_text")), lambda own: F.when(F.size(own) > 0, own).otherwise(_blocks(F.col("_text")))))
    rows = rows.select("_key", "_text", _accepted(F.col("_blocks")).alias("_found"))
    both = lambda x: let(lowered(x), lambda low: _first(x, low, BRANCHES).isNotNull() & _first(x, low, RANKS).isNotNull())
    lines = F.filter(F.transform(F.split("_text", r"\r\n|[\n\r]"), lambda x: stripped(x)), both)
    rows = rows.withColumn("_lines", F.when(F.size("_found") == 0, lines).otherwise(F.array().cast("array<string>")))
    rows = rows.select("_key", "_text", F.when(F.size("_lines") > 0, _accepted(F.col("_lines"))).otherwise(F.col("_found")).alias("_found"))
    whole = F.when((F.size("_found") == 0) & (F.col("_text") != ""), F.array("_text")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_whole", whole)
    rows = rows.select("_key", F.when(F.size("_whole") > 0, _accepted(F.col("_whole"))).otherwise(F.col("_found")).alias("_found"))
    # entries are named before the rest of their block is read
    part = lambda c: F.coalesce(c, F.lit(""))
    name = lambda m: F.lower(F.concat_ws("\0", part(m["branch"]), part(_unit(m["b"])), part(m["start_date"]), part(m["end_date"])))
    once = let(F.transform("_found", name), lambda names: _firsts(F.col("_found"), names))
    return rows.select(F.col("_key").alias(key), F.transform(once, lambda m: entry_of(m)).alias("entries"))
