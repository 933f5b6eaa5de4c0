"""Lookups and summaries of people and jobs: who is meant, what is known of them, what they saved, and whether fields are in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a resume that an answer shows, and what follows where it was cut (fixed values).
SHOWN = 6000
CUT = "\n...[truncated]"
UNNAMED = "No candidate was named"
#: The longest gram of the index of names.
GRAM = 3
#: Parts of the names that hold a gram, so that a frequent one isn't one task's.
PARTS = 16


def squeezed(c: Column) -> Column:
    """A text without white space at its ends, and with one space for each run of it."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def grams(c: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text; none where it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1))), lambda at: c.substr(at, F.lit(size)))
    return F.array_distinct(F.filter(runs, lambda g: F.length(g) == size))


def candidates_asked(asks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The columns of asks with id and error: for each ``ask`` the candidate (id, name) with that id, else the smallest id among
    those whose name contains it in any case; else what went wrong. Signs have no special meaning. Blank and null asks name nobody.

    Names that contain an ask hold all its grams, so an ask meets only the names that hold its rarest one. Asks that are shorter
    than a gram meet the names by a gram of their own length."""
    asked = asks.withColumn("_ask", F.regexp_replace(F.coalesce("ask", F.lit("")), r"^\s+|\s+$", ""))
    told = asked.select("_ask").where("_ask <> ''").distinct()
    exact = told.join(candidates.select(F.col("id").cast("string").alias("_ask"), F.col("id").alias("_id")).groupBy("_ask").agg(F.min("_id").alias("_id")), "_ask")
    rest = told.join(exact.select("_ask"), "_ask", "left_anti").withColumn("_low", F.lower("_ask"))
    size = F.least(F.length("_low"), F.lit(GRAM))
    own = F.when(size == 1, grams(F.col("_low"), 1)).when(size == 2, grams(F.col("_low"), 2)).otherwise(grams(F.col("_low"), GRAM))
    wanted = rest.select("_ask", "_low", F.explode(own).alias("_gram"))
    names = candidates.where(F.col("name").isNotNull()).select(F.col("id").alias("_id"), F.lower("name").alias("_name"))
    index = names.select("_id", "_name", F.explode(F.concat(*(grams(F.col("_name"), k) for k in range(1, GRAM + 1)))).alias("_gram")).join(wanted.select("_gram").distinct(), "_gram", "left_semi")
    counts = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = wanted.join(counts, "_gram", "left").groupBy("_ask", "_low").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_least"))
    # the names are never sent to all executors, whatever size they are taken for: only those with a chosen gram move, in parts
    chosen = rarest.select("_ask", "_low", F.col("_least.g").alias("_gram"))
    held = index.join(chosen.select("_gram").distinct(), "_gram", "left_semi").withColumn("_part", F.pmod(F.hash("_id"), F.lit(PARTS)))
    spread = chosen.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    near = spread.join(held.hint("merge"), ["_gram", "_part"]).where(F.col("_name").contains(F.col("_low"))).groupBy("_ask").agg(F.min("_id").alias("_id"))
    found = asked.join(exact.unionByName(near), "_ask", "left")
    missing = F.concat(F.lit("No candidate found matching '"), "_ask", F.lit("'"))
    error = F.when(F.col("_ask") == "", UNNAMED).when(F.col("_id").isNull(), missing)
    return found.select(*(F.col(c) for c in asks.columns), F.col("_id").alias("id"), error.alias("error"))


def candidate_summaries(candidates: DataFrame, skills: DataFrame, jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    """The columns of candidates (id, job_id, ...) with their skills in order, the job they applied for (id, title, status) where
    it is known, and whether a resume of theirs is there. A person's distinct skills are at most as many as there are skills."""
    listed = skills.groupBy(F.col("candidate_id").alias("id")).agg(F.sort_array(F.collect_set("skill_name")).alias("skills"))
    has = resumes.select(F.col("candidate_id").alias("id")).distinct().withColumn("has_resume", F.lit(True))
    job = jobs.select(F.col("id").alias("job_id"), F.struct("id", "title", "status").alias("applied_job"))
    known = candidates.join(listed, "id", "left").join(has, "id", "left").join(job, "job_id", "left")
    return known.withColumn("skills", F.coalesce("skills", F.array().cast("array<string>"))).withColumn("has_resume", F.coalesce("has_resume", F.lit(False))).drop("job_id")


def job_summaries(jobs: DataFrame) -> DataFrame:
    """Jobs (id, title, department, location, status, skills) with the comma-separated skills as an array; none without a text."""
    listed = F.transform(F.split("skills", ","), lambda s: F.trim(s))
    return jobs.select("id", "title", "department", "location", "status", F.when(F.coalesce("skills", F.lit("")) == "", F.array().cast("array<string>")).otherwise(listed).alias("skills"))


def latest_resumes(candidates: DataFrame, resumes: DataFrame) -> DataFrame:
    """(candidate_id, candidate, resume_id, parsed_content, error): the text of each candidate's latest resume, as much as an answer
    shows; an error where there is none or it is empty. The latest ids are found first, so texts of older ones aren't shuffled."""
    latest = resumes.groupBy("candidate_id").agg(F.max("id").alias("id"))
    shown = F.when(F.length("parsed_content") > SHOWN, F.concat(F.substring("parsed_content", 1, SHOWN), F.lit(CUT))).otherwise(F.col("parsed_content"))
    texts = resumes.join(latest, ["candidate_id", "id"], "left_semi").where("parsed_content <> ''").select("candidate_id", F.col("id").alias("resume_id"), shown.alias("parsed_content"))
    error = F.when(F.col("resume_id").isNull(), F.concat(F.lit("No parsed resume on file for "), F.coalesce("candidate", F.lit(""))))
    return candidates.select(F.col("id").alias("candidate_id"), F.col("name").alias("candidate")).join(texts, "candidate_id", "left").select("candidate_id", "candidate", "resume_id", "parsed_content", error.alias("error"))


def saved_jobs(saved: DataFrame, jobs: DataFrame) -> DataFrame:
    """Saved jobs (id, candidate_id, job_id, saved_at, notes) with the title, department and location of the job; jobs that are gone don't count."""
    of = jobs.select(F.col("id").alias("job_id"), F.col("title").alias("job_title"), F.col("department").alias("job_department"), F.col("location").alias("job_location"))
    return saved.join(of, "job_id").select("id", "candidate_id", "job_id", "job_title", "job_department", "job_location", "saved_at", "notes")


def checked_fields(changes: DataFrame, jobs: DataFrame, departments: DataFrame) -> DataFrame:
    """The columns of changes with department and requisition number put right, or status and detail of what is wrong first.

    A change (job_id, null for a new job; fields, the names of those it sets; department; requisition_number) needs a department of
    the list (name, active), in any case and spacing, that is active or is the job's own already; a job's own department that is no
    longer listed stays. A requisition number may not be another job's (id, title, department, requisition_number). Fields that a
    change doesn't set are neither checked nor changed. Of several jobs with a number the smallest id is named, or, where that is
    the job itself, the largest."""
    sets = lambda name: F.coalesce(F.array_contains("fields", name), F.lit(False))
    listed = departments.groupBy(F.lower("name").alias("_low")).agg(F.min(F.struct("name", "active")).alias("_d"))
    current = jobs.select(F.col("id").alias("job_id"), F.col("department").alias("_current"))
    taken = jobs.where(F.col("requisition_number").isNotNull()).groupBy(F.col("requisition_number").alias("_number"))
    taken = taken.agg(F.min(F.struct("id", "title")).alias("_first"), F.max(F.struct("id", "title")).alias("_last"))
    number = squeezed(F.col("requisition_number"))
    df = changes.withColumn("_text", squeezed(F.col("department"))).withColumn("_low", F.lower("_text"))
    df = df.withColumn("_number", F.when(number != "", number)).join(current, "job_id", "left").join(listed, "_low", "left").join(taken, "_number", "left")
    kept = F.col("_d.active") | F.coalesce(F.col("_d.name") == F.col("_current"), F.lit(False))
    unlisted = F.col("_d").isNull()
    other = F.when(F.col("job_id").isNull() | (F.col("_first.id") != F.col("job_id")), F.col("_first")).when(F.col("_last.id") != F.col("job_id"), F.col("_last"))
    wrong = (
        F.when(F.col("_text") == "", "A department is required.")
        .when(unlisted & F.coalesce(F.col("_text") == F.col("_current"), F.lit(False)), F.lit(None).cast("string"))
        .when(unlisted, F.concat(F.lit("'"), "_text", F.lit("' is not on the department list. Choose one from the list, or ask an admin to add it on the Team page.")))
        .when(~kept, F.concat(F.lit("'"), "_d.name", F.lit("' is turned off. Choose another department.")))
    )
    wrong = F.when(sets("department"), wrong)
    clash = F.when(sets("requisition_number") & other.isNotNull(), F.concat(F.lit("Requisition "), "_number", F.lit(" is already used by '"), other["title"], F.lit("'.")))
    right = {
        "department": F.when(sets("department"), F.coalesce("_d.name", "_text")).otherwise(F.col("department")),
        "requisition_number": F.when(sets("requisition_number"), F.col("_number")).otherwise(F.col("requisition_number")),
    }
    status = F.when(wrong.isNotNull(), 422).when(clash.isNotNull(), 409)
    return df.select(*(right.get(c, F.col(c)).alias(c) for c in changes.columns), status.alias("status"), F.coalesce(wrong, clash).alias("detail"))
