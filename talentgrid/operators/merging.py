"""Confirmed data put into stored documents, section by section.

Documents are JSON objects; their sections are VARIANT values, so that whatever a section holds is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sections that a confirmation may replace, and those of them that are lists (fixed values).
SECTIONS = ("personal_info", "education", "experience", "skills", "military")
LISTS = ("military",)
MAP = "map<string, variant>"


def document(c: Column) -> Column:
    """The sections of a JSON object; null and what is no object has none."""
    text = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit("")).startswith("OBJECT"), c)
    return F.coalesce(F.from_json(text, MAP), F.create_map().cast(MAP))


def as_list(c: Column) -> Column:
    """A section that is a list: null is an empty one, any value that is no list a list of it."""
    kind = F.schema_of_variant(c)
    empty = c.isNull() | F.is_variant_null(c)
    one = F.try_parse_json(F.concat(F.lit("["), F.to_json(c), F.lit("]")))
    return F.when(empty, F.parse_json(F.lit("[]"))).when(kind.startswith("ARRAY"), c).otherwise(one)


def merged_documents(stored: DataFrame, confirmed: DataFrame, key: str, sections: tuple[str, ...] = SECTIONS, lists: tuple[str, ...] = LISTS) -> DataFrame:
    """(key, document, replaced): each stored document with the sections that its confirmation has, in place of its own, and their
    names. A section that is confirmed as null becomes null (lists: empty); others, and all other keys, stay.

    stored, confirmed: key, document; one confirmation a key counts (of several the largest text). Rows without one keep their
    document; stored documents that are null or no object count as empty ones. Keys come out in order."""
    news = confirmed.select(F.col(key), F.col("document").alias("_new")).groupBy(key).agg(F.max("_new").alias("_new"))
    both = stored.select(key, "document").join(news, key, "left").select(key, document(F.col("document")).alias("old"), document(F.col("_new")).alias("new"))
    given = F.map_filter("new", lambda k, _: k.isin(*sections))
    given = F.transform_values(given, lambda k, v: F.when(k.isin(*lists), as_list(v)).otherwise(v))
    rows = both.select(key, F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(given), k)).alias("old"), given.alias("given"))
    every = F.map_concat("old", "given")
    return rows.select(key, F.to_json(F.to_variant_object(every)).alias("document"), F.array_sort(F.map_keys("given")).alias("replaced"))
