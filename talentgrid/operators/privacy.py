"""De-identification of nested rows: every string of a structure is rewritten, whatever its depth, with the names of its own row.

The schema drives the walk, so structs, arrays and maps keep their shape and the work stays in Columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from talentgrid.functions import text as T
from talentgrid.functions import vocabulary as V
from talentgrid.functions.sections import let

# ---------------------------------------------------------------- fixed values
#: Personal fields that are dropped, and top-level fields; of the personal ones the summary alone stays.
IDENTIFYING = ("name", "email", "phone", "address", "location", "linkedin", "github", "website")
DROPPED = ("raw_text", "file_name")
KEPT_PERSONAL = "summary"


# ---------------------------------------------------------------- walking a type
def rewritten(c: Column, kind: Ty.DataType, f: Callable[[Column], Column]) -> Column:
    """The value with f applied to all its strings; keys of maps stay, nulls stay null."""
    if isinstance(kind, Ty.StringType):
        return f(c)
    if isinstance(kind, Ty.ArrayType):
        return F.transform(c, lambda x: rewritten(x, kind.elementType, f))
    if isinstance(kind, Ty.MapType):
        return F.transform_values(c, lambda _, v: rewritten(v, kind.valueType, f))
    if isinstance(kind, Ty.StructType) and kind.fields:
        return F.when(c.isNotNull(), F.struct(*[rewritten(c[x.name], x.dataType, f).alias(x.name) for x in kind.fields]))
    return c


def strings_of(c: Column, kind: Ty.DataType, leaf: str = "string") -> Column:
    """All strings of a value, as one array; keys of maps are none of them. ``leaf`` is the type of what stands where kind has strings."""
    none = F.array().cast(f"array<{leaf}>")
    if isinstance(kind, Ty.StringType):
        out = F.array(c)
    elif isinstance(kind, Ty.ArrayType):
        out = F.flatten(F.transform(c, lambda x: strings_of(x, kind.elementType, leaf)))
    elif isinstance(kind, Ty.MapType):
        out = F.flatten(F.transform(F.map_values(c), lambda x: strings_of(x, kind.valueType, leaf)))
    elif isinstance(kind, Ty.StructType) and kind.fields:
        out = F.concat(*[strings_of(c[x.name], x.dataType, leaf) for x in kind.fields])
    else:
        return none
    return F.coalesce(F.filter(out, lambda s: s.isNotNull()), none)


# ---------------------------------------------------------------- names
def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#-])", r"\\$1")


def names_pattern(names: Column) -> Column:
    """One pattern for all names as whole words in upper or lower case, longer ones first; null where there are none."""
    longest = F.array_sort(F.filter(names, lambda n: n != ""), lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(longest) > 0, F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(F.transform(longest, escaped), "|"), F.lit(r")\b")))


def exchanged(c: Column, pattern: Column, to: Column) -> Column:
    """Every match of the pattern by what ``to`` (a map with lower-case keys) has for it, all at once: nothing that was put in is
    matched again. A null pattern changes nothing."""
    gaps, found = F.split(c, pattern, -1), F.regexp_extract_all(c, pattern, F.lit(0))
    put = F.zip_with(gaps, found, lambda gap, n: F.concat(gap, F.coalesce(F.try_element_at(to, F.lower(n)), n, F.lit(""))))
    return F.when(pattern.isNotNull(), F.array_join(put, "")).otherwise(c)


def people_exchanged(c: Column, people: Column) -> Column:
    """A text with every name, and every part of one, by its person's replacement. people: array of (name, replacement); where
    two have a part in common, the first of them counts."""
    entries = F.flatten(F.transform(people, lambda p: F.transform(T.name_parts(p["name"]), lambda n: F.struct(F.lower(n).alias("key"), p["replacement"].alias("value")))))
    first = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, F.lit(1), i), lambda x: x["key"] == e["key"]))
    return let(entries, lambda es: let(F.map_from_entries(first(es)), lambda to: exchanged(c, names_pattern(F.map_keys(to)), to)))


# ---------------------------------------------------------------- one string
#: What ``scrub`` gives for a string.
SCRUBBED = "struct<text: string, names: int, emails: int, links: int, phones: int>"


def scrub(s: Column, pattern: Column) -> Column:
    """The string without the names of a pattern, addresses, links and phone numbers, and how many of each there were; null for null.
    Each search runs once, only where the string holds what a match needs, and counts where it changed something."""
    replaced = lambda c, held, what, mark: F.when(held, F.regexp_replace(c, what, mark)).otherwise(c)
    marks = lambda after, mark: ((F.length(after) - F.length(F.replace(after, F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    # no mark overlaps itself, so where there was none before, those that are there now are the places that changed
    places = lambda c, after, what, mark: F.when(F.contains(c, F.lit(mark)), F.regexp_count(c, what)).when(after == c, 0).otherwise(marks(after, mark))
    names = lambda y: F.when(pattern.isNull(), 0).otherwise(places(s, y, pattern, V.NAME_GONE))
    found = let(F.when(pattern.isNull(), s).otherwise(F.regexp_replace(s, pattern, F.lit(V.NAME_GONE))), lambda y: let(
        replaced(y, F.contains(y, F.lit("@")), V.EMAIL, V.EMAIL_GONE), lambda e: let(
            replaced(e, F.contains(e, F.lit(".")) | F.contains(e, F.lit("/")), V.LINK, V.LINK_GONE), lambda n: let(
                replaced(n, F.rlike(n, F.lit(r"\d{4}")), V.PHONE, V.PHONE_GONE), lambda p: F.struct(
                    p.alias("text"), names(y).alias("names"), places(y, e, F.lit(V.EMAIL), V.EMAIL_GONE).alias("emails"), places(e, n, F.lit(V.LINK), V.LINK_GONE).alias("links"), places(n, p, F.lit(V.PHONE), V.PHONE_GONE).alias("phones"))))))
    return F.when(s.isNotNull(), found)


# ---------------------------------------------------------------- whole rows
def anonymized(df: DataFrame, key: str, personal: str = "personal_info") -> DataFrame:
    """(key, safe, report): the row's other columns as one struct without identifying fields, every string scrubbed of the
    person's name, addresses, links and phone numbers; and a report of what was removed.

    ``personal`` is a struct with a name; of its fields only the summary stays. Rows without a name are scrubbed of all else."""
    schema = df.schema
    own = schema[personal].dataType
    fields = [x.name for x in own.fields]
    kept = F.struct(*[F.col(personal)[KEPT_PERSONAL].alias(KEPT_PERSONAL)]) if KEPT_PERSONAL in fields else None
    rest = [x.name for x in schema.fields if x.name not in (key, personal, *DROPPED)]
    safe = F.struct(*[F.col(c).alias(c) for c in rest], *([kept.alias(personal)] if kept is not None else []))
    kind = Ty.StructType([schema[c] for c in rest] + ([Ty.StructField(personal, Ty.StructType([own[KEPT_PERSONAL]]))] if kept is not None else []))
    name = F.col(personal)["name"] if "name" in fields else F.lit(None).cast("string")
    pattern = names_pattern(F.array_distinct(T.name_parts(name)))
    rows = df.select(F.col(key), safe.alias("_safe"), pattern.alias("_pattern"), F.col(personal).alias("_personal"))

    removed = F.filter(F.array(*[F.when(F.coalesce(F.col("_personal")[f], F.lit("")) != "", F.lit(f)) for f in IDENTIFYING if f in fields]), lambda f: f.isNotNull())
    total = lambda xs, n: F.aggregate(xs, F.lit(0), lambda a, s: a + s[n])

    def counted(marked: Column) -> Column:
        return let(strings_of(marked, kind, SCRUBBED), lambda xs: F.struct(
            removed.alias("identifying_fields_removed"), total(xs, "names").alias("name_mentions_scrubbed"), total(xs, "emails").alias("emails_scrubbed"),
            total(xs, "phones").alias("phones_scrubbed"), total(xs, "links").alias("links_scrubbed")))

    # every string is searched once: what stands in its place holds both its text and its counts
    both = lambda marked: F.struct(rewritten(marked, kind, lambda s: s["text"]).alias("safe"), counted(marked).alias("report"))
    done = let(rewritten(F.col("_safe"), kind, lambda s: scrub(s, F.col("_pattern"))), both)
    return rows.select(key, done.alias("_done")).select(key, "_done.safe", "_done.report")
