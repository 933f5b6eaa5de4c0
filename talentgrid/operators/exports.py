"""Everything held about people, for requests of access: a section for each table, the columns left out and why, the names
that ids stand for, and lines a person can read.

All people of the first section are exported at once; one person's export is a filter on ``candidate_id``. Records stay
rows and are never gathered by person, so somebody with very many of them makes no long task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from talentgrid.sources.tables import spread

#: Why columns of a type are left out, and which columns name a member of the staff (fixed values).
VECTOR = "search vector derived from the profile"
BINARY = "binary data"
STAFF = ("author_id", "interviewer_id", "user_id", "sent_by", "changed_by")
LABELS = {"id": "Record id", "job_id": "Job", "stage_id": "Stage"}
NOTHING = "None held."
_OWNER = "_candidate"


@dataclass(frozen=True)
class Section:
    """A table of rows with an ``id``. ``owner`` names the parent's id; the parent is the first section (the people) unless another
    one before it is named. ``hidden`` columns are left out for the reason given."""

    name: str
    label: str
    rows: DataFrame
    owner: str = "candidate_id"
    parent: str | None = None
    hidden: dict[str, str] = field(default_factory=dict)


def left_out(section: Section) -> dict[str, str]:
    """Column -> reason: vectors and bytes by their type, others as the section says."""
    out = {}
    for f in section.rows.schema:
        if f.name in section.hidden:
            out[f.name] = section.hidden[f.name]
        elif isinstance(f.dataType, Ty.BinaryType):
            out[f.name] = BINARY
        elif isinstance(f.dataType, Ty.ArrayType) and isinstance(f.dataType.elementType, (Ty.FloatType, Ty.DoubleType)):
            out[f.name] = VECTOR
    return out


def owned(sections: list[Section]) -> dict[str, DataFrame]:
    """The rows of each section with the person they belong to; rows that lead to nobody are not held about anyone."""
    first = sections[0]
    out = {first.name: first.rows.withColumn(_OWNER, F.col("id"))}
    for s in sections[1:]:
        parent = s.parent or first.name
        if parent not in out:
            raise ValueError(f"section {s.name} comes before its parent {parent}")
        out[s.name] = spread(s.rows, s.owner).join(out[parent].select(F.col("id").alias(s.owner), _OWNER), s.owner)
    return out


def records(sections: list[Section]) -> DataFrame:
    """(candidate_id, place, section, label, id, body): each record as JSON, nulls included, without what is left out."""
    rows, parts = owned(sections), []
    for place, s in enumerate(sections):
        hidden = left_out(s)
        body = F.to_json(F.struct(*(c for c in s.rows.columns if c not in hidden)), {"ignoreNullFields": "false"})
        parts.append(rows[s.name].select(F.col(_OWNER).alias("candidate_id"), F.lit(place).alias("place"), F.lit(s.name).alias("section"), F.lit(s.label).alias("label"), "id", body.alias("body")))
    return reduce(DataFrame.unionByName, parts)


def omissions(sections: list[Section]) -> DataFrame:
    """(candidate_id, section, column, reason, held): how many values of each column that was left out are held about a person."""
    rows, parts = owned(sections), []
    for s in sections:
        hidden = left_out(s)
        if hidden:
            counted = rows[s.name].groupBy(F.col(_OWNER).alias("candidate_id")).agg(*(F.count(c).alias(c) for c in hidden))
            each = F.array(*(F.struct(F.lit(s.name).alias("section"), F.lit(c).alias("column"), F.lit(why).alias("reason"), F.col(c).alias("held")) for c, why in hidden.items()))
            parts.append(counted.select("candidate_id", F.inline(each)))
    if not parts:
        return sections[0].rows.select(F.col("id").alias("candidate_id"), *(F.lit("").alias(c) for c in ("section", "column", "reason")), F.lit(0).cast("long").alias("held")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def kind_of(column: str) -> str | None:
    """Which names a column points at: jobs, stages, staff or none."""
    return {"job_id": "jobs", "stage_id": "stages"}.get(column) or ("staff" if column in STAFF else None)


def _once(df: DataFrame) -> DataFrame:
    """Each (candidate_id, id) once, by a sort: a hash table of nearly all rows takes more memory than their sort. They are dealt anew
    before it, so that a task holds this sort or those of the joins before, not both, and to a number of tasks: such lean rows
    shuffle in few bytes, by which Spark would put many partitions into one task."""
    n = F.row_number().over(Window.partitionBy("candidate_id", "id").orderBy("id"))
    return spread(df, "candidate_id", "id").withColumn("_n", n).where("_n = 1").drop("_n")


def references(sections: list[Section], names: dict[str, DataFrame]) -> DataFrame:
    """(candidate_id, kind, id, name) of the ids that a person's records point at, where names (id, name) of that kind know them.
    Whole numbers stay numbers until each is there once: rows are lean where they are many."""
    rows, kinds = owned(sections), {}
    for s in sections:
        hidden = left_out(s)
        for f in s.rows.schema:
            if f.name not in hidden and kind_of(f.name) in names:
                id_ = F.col(f.name) if isinstance(f.dataType, Ty.IntegralType) else F.col(f.name).cast("string")
                own = rows[s.name].where(F.col(f.name).isNotNull()).select(F.col(_OWNER).alias("candidate_id"), id_.alias("id"))
                kinds.setdefault(kind_of(f.name), []).append(_once(own).withColumn("id", F.col("id").cast("string")))
    if not kinds:
        return sections[0].rows.select(F.col("id").alias("candidate_id"), *(F.lit("").alias(c) for c in ("kind", "id", "name"))).limit(0)
    parts = []
    for kind, found in kinds.items():
        found = found[0] if len(found) == 1 else _once(reduce(DataFrame.unionByName, found))
        known = names[kind].select(F.col("id").cast("string").alias("id"), F.coalesce("name", F.lit("")).alias("name"))
        parts.append(found.join(known, "id").select("candidate_id", F.lit(kind).alias("kind"), "id", "name"))
    return reduce(DataFrame.unionByName, parts)


def field_label(column: str) -> str:
    plain = column.removesuffix("_id") if column in STAFF else column
    return LABELS.get(column) or plain.replace("_", " ").capitalize()


def _shown(f: Ty.StructField) -> Column:
    """A value as text: yes or no, JSON for what is nested, else as Spark writes it."""
    c = F.col(f.name)
    if isinstance(f.dataType, Ty.BooleanType):
        return F.when(c, "yes").when(~c, "no")
    return F.to_json(c) if isinstance(f.dataType, (Ty.StructType, Ty.ArrayType, Ty.MapType)) else c.cast("string")


def _named(value: Column, name: Column, kind: str) -> Column:
    if kind == "jobs":
        return F.concat(F.coalesce(name, F.lit("Job")), F.lit(" (#"), value, F.lit(")"))
    return F.coalesce(name, F.concat(F.lit("#"), value) if kind == "stages" else F.lit("a former staff account"))


def lines(sections: list[Section], names: dict[str, DataFrame]) -> DataFrame:
    """(candidate_id, place, section, id, position, line) of a document to read, in that order: a line for each value that isn't
    empty, ids replaced by names, and one line for a section that holds nothing. Rows without a reference are spread by their
    own id, so that many nulls of a column don't meet in one task of its join."""
    rows, parts = owned(sections), []
    people = sections[0].rows.select(F.col("id").alias(_OWNER))
    for place, s in enumerate(sections):
        hidden, df, shown = left_out(s), rows[s.name], []
        for k, f in enumerate(s.rows.schema, 1):
            if f.name in hidden or f.name == "candidate_id":
                continue
            value, kind = _shown(f), kind_of(f.name)
            if kind and kind in names:
                known = names[kind].select(F.col("id").cast("string").alias(f"_key{k}"), F.coalesce("name", F.lit("")).alias(f"_name{k}"))
                spread = F.concat(F.lit("\0"), F.coalesce(F.col("id").cast("string"), F.lit("")))
                df = df.withColumn(f"_key{k}", F.coalesce(value, spread)).join(known, f"_key{k}", "left")
                value = F.when(value.isNotNull(), _named(value, F.col(f"_name{k}"), kind))
            shown.append(F.struct(F.lit(k).alias("position"), F.lit(field_label(f.name)).alias("label"), value.alias("value")))
        place_of = (F.col(_OWNER).alias("candidate_id"), F.lit(place).alias("place"), F.lit(s.label).alias("section"))
        each = df.select(*place_of, F.col("id").cast("string").alias("id"), F.inline(F.array(*shown))).where("value <> ''")
        parts.append(each.withColumn("line", F.concat("label", F.lit(": "), "value")).drop("label", "value"))
        if place:
            none = people.join(rows[s.name].select(_OWNER), _OWNER, "left_anti")
            parts.append(none.select(*place_of, F.lit(None).cast("string").alias("id"), F.lit(0).alias("position"), F.lit(NOTHING).alias("line")))
    return reduce(DataFrame.unionByName, parts)
