"""Counts and lists around jobs and candidates: tags, departments, pipeline state, applications with their stage, exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions import labels as L
from talentgrid.functions import vocabulary as V
from talentgrid.operators import governance
from talentgrid.operators import reports as R

UNSPECIFIED = "(unspecified)"


def tag_counts(tags: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """(tag, n), most used first, of all candidates or the visible ones."""
    seen = tags if visible is None else tags.join(visible.select("candidate_id"), "candidate_id", "left_semi")
    return seen.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def tags_of(tags: DataFrame) -> DataFrame:
    """(candidate_id, tags) in order; a candidate holds few tags."""
    return tags.groupBy("candidate_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def without_tag(tags: DataFrame, gone: DataFrame) -> DataFrame:
    """The tags without those named (candidate_id, tag); ones that aren't there change nothing."""
    return tags.join(gone.select("candidate_id", "tag"), ["candidate_id", "tag"], "left_anti")


def active_counts(applications: DataFrame) -> DataFrame:
    return applications.where("status = 'active'").groupBy("job_id").agg(F.count("*").alias("n"))


def department_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by department; jobs without one don't count."""
    return jobs.where(F.col("department") != "").groupBy("department").agg(F.count("*").alias("n"))


def templates(df: DataFrame, job_id: int | None = None) -> DataFrame:
    """A job's templates before the global ones, by name."""
    own = df if job_id is None else df.where((F.col("job_id") == job_id) | F.col("job_id").isNull())
    return own.orderBy(F.col("job_id").isNull(), "name", "id")


def pipeline_overview(candidates: DataFrame, jobs: DataFrame, top: int = 8) -> dict[str, DataFrame]:
    """Counts by status, the positions most applied for, and the numbers of candidates and jobs."""
    position = F.coalesce("position_applied", F.lit(UNSPECIFIED)).alias("position")
    return {
        "by_status": candidates.groupBy("status").agg(F.count("*").alias("n")).orderBy("status"),
        "positions": candidates.groupBy(position).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "position").limit(top),
        "totals": candidates.agg(F.count("*").alias("candidates")).join(F.broadcast(jobs.agg(F.count("*").alias("jobs"), R.counted(F.col("status") == "open").alias("open_jobs")))),
    }


def without_stage(stages: DataFrame, key: str) -> DataFrame:
    """(job_id, last) of jobs none of whose stages has a key, with their last position."""
    by = stages.groupBy("job_id").agg(F.bool_and(F.col("key") != key).alias("lacks"), F.max("position").alias("last"))
    return by.where("lacks").select("job_id", "last")


def current_stage(rows: DataFrame) -> DataFrame:
    """(application_id, stage_key, stage_name) of the first round in progress."""
    here = rows.where("status = 'in_progress'")
    first = F.min_by(F.struct("stage_key", "stage_name"), F.struct("position", "stage_key"))
    return here.groupBy("application_id").agg(first.alias("s")).select("application_id", "s.*")


def applications_of(applications: DataFrame, jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Applications with their job's title and department, and the stage they are at."""
    named = jobs.select(F.col("id").alias("job_id"), F.col("title").alias("job_title"), F.col("department").alias("job_department"))
    return applications.join(named, "job_id").join(current_stage(rows).withColumnRenamed("application_id", "id"), "id", "left")


def details(applications: DataFrame, rows: DataFrame) -> DataFrame:
    """Applications with their ordered stages (one entry for each stage of the job) and the current one."""
    entry = F.struct("position", "stage_key", "stage_name", "status", "started_at", "completed_at")
    line = rows.groupBy("application_id").agg(F.array_sort(F.collect_list(entry)).alias("stages")).withColumnRenamed("application_id", "id")
    return applications.join(line, "id", "left").join(current_stage(rows).withColumnRenamed("application_id", "id"), "id", "left")


def job_pipeline(rows: DataFrame, applications: DataFrame, now: datetime, per_stage: int = 10) -> dict[str, DataFrame]:
    """The state of every job: how many are at each enabled round and who entered first, outcomes with zeros, and who waits."""
    here = rows.where("stage_kind = 'round' and enabled").withColumn("here", (F.col("status") == "in_progress") & (F.col("application_status") == "active"))
    order = Window.partitionBy("job_id", "stage_key", "here").orderBy(F.asc_nulls_last("started_at"), "application_id")
    people = here.where("here").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_stage).withColumn("days", L.whole_days(F.col("started_at"), F.lit(now)))
    outcomes = [R.counted(F.col("status") == s).alias(s) for s in V.TERMINAL]
    return {
        "stages": here.groupBy("job_id", "stage_key").agg(F.min("position").alias("position"), R.counted(F.col("here")).alias("n")).orderBy("job_id", "position"),
        "people": people.select("job_id", "stage_key", "n", "application_id", "candidate_id", "days"),
        "outcomes": applications.groupBy("job_id").agg(*outcomes),
        "waiting": R.no_movement(rows, now).groupBy("job_id").agg(F.count("*").alias("n")),
    }


def interviews_listed(interviews: DataFrame, scope: str, user: str | None = None, most: int = 200) -> DataFrame:
    """Interviews (interviewer_id, state, candidate_name, created_at) of a user, those that wait, or the latest of all; by state and name."""
    if scope == "mine":
        chosen = interviews.where(F.col("interviewer_id") == user) if user else interviews.limit(0)
    elif scope == "pending":
        chosen = interviews.where("state = 'waiting'")
    else:
        chosen = interviews.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    place = F.array_position(F.array(*map(F.lit, V.INTERVIEW_STATES)), F.col("state"))
    return chosen.orderBy(F.when(place > 0, place).otherwise(9), "candidate_name", "id")


def notes_of(notes: DataFrame, users: DataFrame, applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Notes, newest first, with author and job where they are known."""
    author = users.select(F.col("id").alias("author_id"), F.coalesce("name", F.initcap(F.regexp_replace("role", "_", " "))).alias("author"))
    job = applications.select(F.col("id").alias("application_id"), "job_id").join(jobs.select(F.col("id").alias("job_id"), "title"), "job_id", "left")
    named = notes.join(author, "author_id", "left").join(job, "application_id", "left")
    return named.withColumn("author", F.coalesce("author", F.lit("Former team member"))).orderBy(F.desc("created_at"), F.desc("id"))


def candidate_of(subjects: DataFrame, applications: DataFrame, rows: DataFrame, interviews: DataFrame) -> DataFrame:
    """(type, id, candidate_id) of audit subjects (type, id): candidates themselves, applications, stage rows and interviews by theirs."""
    by_application = applications.select(F.lit("application").alias("type"), F.col("id").cast("string").alias("id"), "candidate_id")
    owner = applications.select(F.col("id").alias("application_id"), "candidate_id")
    of_row = rows.select(F.col("id").alias("row_id"), "application_id").join(owner, "application_id")
    by_row = of_row.select(F.lit("stage").alias("type"), F.col("row_id").cast("string").alias("id"), "candidate_id")
    by_interview = interviews.select(F.col("id").alias("interview_id"), F.col("application_stage_id").alias("row_id")).join(of_row, "row_id")
    known = by_application.unionByName(by_row).unionByName(by_interview.select(F.lit("interview").alias("type"), F.col("interview_id").cast("string").alias("id"), "candidate_id"))
    named = subjects.join(known, ["type", "id"], "left")
    return named.select("type", "id", F.when(F.col("type") == "candidate", F.col("id")).otherwise(F.col("candidate_id").cast("string")).alias("candidate_id"))


def export_of(tables: dict[str, tuple[DataFrame, str]], wanted: DataFrame, hidden: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All rows about the wanted candidates (candidate_id) in every table (rows, key column), without vectors, bytes and hidden columns."""
    out = {}
    for name, (df, key) in tables.items():
        own = df.join(wanted.select(F.col("candidate_id").alias(key)), key, "left_semi")
        out[name] = governance.exportable(own, hidden)
    return out


def rendered(df: DataFrame, section: str, order: Column) -> DataFrame:
    """(n, line) of a section as text: a heading, then the fields of each row that aren't empty, in the order of the rows."""
    lines = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(label_of(c) + ": "), F.col(c).cast("string"))) for c in df.columns]
    body = df.select(order.alias("n"), F.concat_ws("\n", *lines).alias("line")).where("line <> ''")
    head = df.sparkSession.range(1).select(F.lit(None).cast(dict(body.dtypes)["n"]).alias("n"), F.lit(section.upper()).alias("line"))
    return head.unionByName(body).orderBy(F.asc_nulls_first("n"))


def label_of(column: str) -> str:
    """A column's name as a label."""
    return column.replace("_", " ").capitalize()


def tasks(df: DataFrame, **equal) -> DataFrame:
    """Tasks whose columns have the given values; None asks for nothing."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df
