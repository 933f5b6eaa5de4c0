"""Search, listing, paging and export of candidates and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.functions import labels as L
from talentgrid.functions import text as T


def any_like(columns: list[str], keyword: str):
    """Whether any column holds the keyword; % and _ in it are wildcards."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{keyword}%"), F.lit(False)) for c in columns))


def candidates(df: DataFrame, skills: DataFrame | None = None, tags: DataFrame | None = None, applications: DataFrame | None = None, visible: DataFrame | None = None, keyword: str = "", columns: list[str] = (), status: str = "", job_id: int | None = None, all_tags: list[str] = ()) -> DataFrame:
    """Candidates (id, ...) by visibility, keyword in a column or a skill, status, job and all of some tags. Child tables are
    asked with semi joins, so no candidate appears twice."""
    if visible is not None:
        df = df.join(visible.select(F.col("candidate_id").alias("id")), "id", "left_semi")
    if keyword:
        by_skill = skills.where(F.col("skill_name").ilike(f"%{keyword}%")).select(F.col("candidate_id").alias("id")).distinct().withColumn("by_skill", F.lit(True)) if skills is not None else None
        if by_skill is None:
            df = df.where(any_like(list(columns), keyword))
        else:
            df = df.join(by_skill, "id", "left").where(any_like(list(columns), keyword) | F.col("by_skill").isNotNull()).drop("by_skill")
    if status:
        df = df.where(F.col("status") == status)
    if job_id is not None:
        df = df.join(applications.where(F.col("job_id") == job_id).select(F.col("candidate_id").alias("id")), "id", "left_semi")
    return df.join(with_all(tags, "candidate_id", "tag", all_tags).select(F.col("candidate_id").alias("id")), "id", "left_semi") if all_tags else df


def with_all(df: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """Keys that have every wanted value."""
    return df.where(F.col(value).isin(*wanted)).groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def jobs(df: DataFrame, keyword: str = "", department: str = "", place: str = "", equal: dict[str, str] | None = None, min_salary: int = 0, max_salary: int = 0) -> DataFrame:
    """Jobs by keyword, department, place, equal columns and salary bounds; a bound of zero is none."""
    if keyword:
        df = df.where(any_like(["title", "job_overview", "required_qualifications"], keyword) | F.coalesce(F.col("requisition_number").ilike(f"%{keyword.strip()}%"), F.lit(False)))
    if department:
        df = df.where(F.col("department").ilike(f"%{department}%"))
    if place:
        df = df.where(L.like_any(F.col("location"), L.place_patterns(place)))
    for column, value in (equal or {}).items():
        df = df.where(F.col(column) == value)
    if min_salary:
        df = df.where(F.col("min_salary") >= min_salary)
    return df.where(F.col("max_salary") <= max_salary) if max_salary else df


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an order that ends in a unique column."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def keyset_page(df: DataFrame, key: str, before: int | None, size: int) -> DataFrame:
    """The next ``size`` rows by descending key and one more, which tells whether there are others."""
    return (df if before is None else df.where(F.col(key) < before)).orderBy(F.desc(key)).limit(size + 1)


def by_fit(df: DataFrame, score: str, key: str, descending: bool = True) -> DataFrame:
    """By score with the unscored last in either direction."""
    return df.orderBy(F.col(score).isNull(), F.desc(score) if descending else F.asc(score), key)


def find_job(jobs: DataFrame, text: str) -> DataFrame:
    """By id if the text is a number, else by title: exact before partial, open before closed."""
    if text.strip().isdigit():
        return jobs.where(F.col("id") == int(text)).limit(1)
    exact = F.lower("title") == text.strip().lower()
    return jobs.where(F.lower("title").contains(text.strip().lower())).orderBy(F.desc(exact), F.desc_nulls_last(F.col("status") == "open"), "id").limit(25)


def export_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Guarded text cells, ready for ``write.csv``."""
    return df.select(*(L.csv_cell(F.col(c)).alias(c) for c in columns))


def skill_counts(skills: DataFrame) -> DataFrame:
    return skills.groupBy("skill_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill_name")


def joined_skills(skills: DataFrame, key: str = "candidate_id") -> DataFrame:
    """One ordered, comma-joined list for each key."""
    return skills.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("skill_name")), ", ").alias("skills"))


def duplicates(df: DataFrame, content: str, key: str) -> DataFrame:
    """Contents that occur more than once: digest, first key, copies."""
    return df.groupBy(F.sha2(content, 256).alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")


def banded(hits: DataFrame, query: str, similarity: str, fields: list[str], floor: float = 0.0) -> DataFrame:
    """Hits with the query's words they show, in which fields, the kind of match and the relevance band."""
    terms = T.terms_of(query)
    shown = {f: T.evidence(F.col(f), terms) for f in fields}
    matched = F.filter(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"), lambda t: reduce(lambda a, b: a | b, (F.array_contains(e, t) for e in shown.values())))
    return (
        hits.withColumns({f"_{f}": e for f, e in shown.items()}).withColumn("matched_on", matched)
        .withColumn("match_kind", T.match_kind(F.col(f"_{fields[0]}"), F.col("matched_on")))
        .withColumn("relevance", T.band(F.col(similarity), F.col("matched_on"), terms, floor)).drop(*(f"_{f}" for f in fields))
    )


def ranked(hits: DataFrame, similarity: str, key: str, limit: int) -> DataFrame:
    """Bands in order, then similarity; ``shown`` marks the first ``limit`` that aren't weak. For a pool of bounded size."""
    from pyspark.sql import Window

    order = F.when(F.col("relevance") == "strong", 0).when(F.col("relevance") == "moderate", 1).otherwise(2)
    place = F.row_number().over(Window.orderBy(order, F.desc(similarity), key))
    return hits.withColumn("place", place).withColumn("shown", (F.col("place") <= limit) & (F.col("relevance") != "weak"))
