"""The stage machine as batches: each application gets at most one command, and a refused command is a row with a reason."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentgrid.functions import labels as L
from talentgrid.functions import vocabulary as V

OUTCOME_OF = {"advance": "hired", "reject": "rejected", "decline": "declined", "withdraw": "withdrawn"}


def default_stages(spark: SparkSession) -> DataFrame:
    rows = [(k, n, kind, p) for p, (k, n, kind) in enumerate(V.DEFAULT_STAGES, 1)]
    return spark.createDataFrame(rows, "key string, name string, kind string, position int")


def ensured_job_stages(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """The default stages of every job (id) that has none."""
    bare = jobs.select(F.col("id").alias("job_id")).join(stages.select("job_id"), "job_id", "left_anti")
    return bare.join(F.broadcast(default_stages(jobs.sparkSession))).select("job_id", "key", "name", "kind", "position", F.lit(True).alias("enabled"))


def ensured_rows(applications: DataFrame, stages: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """The stage rows that applications lack: in progress for the first enabled round of an active application that never
    started, skipped where the application is over and had rows, else pending."""
    had = rows.groupBy("application_id").agg(F.max(F.when(F.col("status") != "pending", 1).otherwise(0)).alias("started"), F.count("*").alias("had"))
    wanted = applications.select(F.col("id").alias("application_id"), "job_id", F.col("status").alias("application_status"), "applied_at").join(stages.select(F.col("id").alias("stage_id"), "job_id", "kind", "position", "enabled"), "job_id")
    missing = wanted.join(rows.select("application_id", "stage_id"), ["application_id", "stage_id"], "left_anti").join(had, "application_id", "left")
    open_round = (F.col("kind") == "round") & F.col("enabled")
    first = F.min(F.when(open_round, F.col("position"))).over(Window.partitionBy("application_id"))
    over = F.col("application_status").isin(*V.TERMINAL)
    starts = open_round & (F.col("position") == first) & (F.coalesce("started", F.lit(0)) == 0) & ~over
    status = F.when(over & (F.coalesce("had", F.lit(0)) > 0), "skipped").when(starts, "in_progress").otherwise("pending")
    return missing.select("application_id", "stage_id", status.alias("status"), F.when(starts, F.coalesce("applied_at", F.lit(now))).alias("started_at"))


def applied(rows: DataFrame, commands: DataFrame, now: datetime) -> DataFrame:
    """Rows (application_id, application_status, stage_key, stage_kind, position, enabled, status, started_at, completed_at) after
    one command (application_id, action) each: advance, skip, reject, decline or withdraw. Adds new_status, new_started_at,
    new_completed_at, new_application_status and refused (why nothing changed)."""
    w = Window.partitionBy("application_id")
    is_current, pending = F.col("status") == "in_progress", F.col("status") == "pending"
    df = rows.join(commands.select("application_id", "action"), "application_id", "left")
    df = df.withColumn("current", F.min(F.when(is_current, F.col("position"))).over(w)).withColumn("current_key", F.min_by(F.when(is_current, F.col("stage_key")), F.when(is_current, F.col("position"))).over(w))
    later = pending & (F.col("stage_kind") == "round") & (F.col("position") > F.col("current"))
    df = df.withColumn("next", F.min(F.when(later & F.col("enabled"), F.col("position"))).over(w))
    action, here = F.col("action"), F.col("position") == F.col("current")
    refused = (
        F.when(action.isNull(), F.lit(None)).when(F.col("application_status").isin(*V.TERMINAL), "the application is closed")
        .when(F.col("current").isNull(), "no stage is in progress").when((action == "skip") & F.col("next").isNull(), "no later stage to skip to")
        .when((action == "decline") & ~F.col("current_key").isin(*V.DECLINABLE), "only an offer can be declined")
        .when(~action.isin("advance", "skip", "reject", "decline", "withdraw"), "unknown action")
    )
    df = df.withColumn("refused", refused).withColumn("acts", action.isNotNull() & F.col("refused").isNull())
    moves = action.isin("advance", "skip") & F.col("next").isNotNull()
    ends_as = F.when(moves, F.lit(None)).when(action.isin(*OUTCOME_OF), L.lookup(action, OUTCOME_OF))
    df = df.withColumn("ends_as", F.when(F.col("acts"), ends_as))
    outcome_key = L.lookup(F.col("ends_as"), {"hired": "hired", "declined": "offer_declined", "withdrawn": "withdrawn"})
    status = (
        F.when(~F.col("acts"), F.col("status"))
        .when(here & is_current, L.lookup(action, {"advance": "passed", "skip": "skipped", "reject": "failed", "decline": "passed", "withdraw": "skipped"}))
        .when(moves & (F.col("position") == F.col("next")) & later, "in_progress")
        .when(moves & later & (F.col("position") < F.col("next")), "skipped")
        .when(F.col("ends_as").isNotNull() & (F.col("stage_kind") == "outcome") & (F.col("stage_key") == outcome_key), "passed")
        .when(F.col("ends_as").isNotNull() & pending, "skipped").otherwise(F.col("status"))
    )
    df = df.withColumn("new_status", status)
    changed = F.col("new_status") != F.col("status")
    began = changed & ((F.col("new_status") == "in_progress") | (F.col("stage_kind") == "outcome") & (F.col("new_status") == "passed"))
    done = changed & F.col("new_status").isin("passed", "failed", "skipped")
    return df.select(
        *rows.columns, "action", "refused", "new_status", F.when(began, F.lit(now)).otherwise(F.col("started_at")).alias("new_started_at"),
        F.when(done, F.lit(now)).otherwise(F.col("completed_at")).alias("new_completed_at"), F.coalesce("ends_as", "application_status").alias("new_application_status"),
    )


def candidate_status(application_status: Column, current_key: Column) -> Column:
    """The candidate's status: of a closed application by its outcome, else by the current stage; custom stages are interviews."""
    return F.coalesce(L.lookup(application_status, V.APPLICATION_TO_CANDIDATE), L.lookup(current_key, V.STAGE_TO_CANDIDATE), F.lit("interviewing"))


def renumbered(stages: DataFrame, *order: Column) -> DataFrame:
    """Positions from 1 within each job."""
    return stages.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)))


def with_custom_stage(stages: DataFrame, name: str, after_key: str) -> DataFrame:
    """The job's stages with a new round after another, renumbered; refused (unchanged) beyond the number allowed."""
    slug = "custom_" + "".join(c if c.isalnum() else "_" for c in name.lower())[:40].strip("_")
    same = stages.where(F.col("key").rlike(f"^{slug}(_[0-9]+)?$")).groupBy("job_id").agg(F.count("*").alias("same"))
    custom = stages.where(F.col("key").startswith("custom_")).groupBy("job_id").agg(F.count("*").alias("custom"))
    host = stages.where(F.col("key") == after_key).join(same, "job_id", "left").join(custom, "job_id", "left").where(F.coalesce("custom", F.lit(0)) < V.MAX_CUSTOM_STAGES)
    key = F.when(F.col("same").isNull(), slug).otherwise(F.concat(F.lit(slug + "_"), (F.col("same") + 1).cast("string")))
    new = host.select("job_id", key.alias("key"), F.lit(name).alias("name"), F.lit("round").alias("kind"), (F.col("position") + 0.5).alias("position"), F.lit(True).alias("enabled"))
    return renumbered(stages.select("job_id", "key", "name", "kind", F.col("position").cast("double").alias("position"), "enabled").unionByName(new), F.col("position"))


def left_behind(rows: DataFrame) -> DataFrame:
    """Active applications: pending rounds before the current one become skipped, with a note."""
    current = F.min(F.when(F.col("status") == "in_progress", F.col("position"))).over(Window.partitionBy("application_id"))
    passed_by = (F.col("application_status") == "active") & (F.col("status") == "pending") & (F.col("stage_kind") == "round") & (F.col("position") < current)
    return rows.withColumn("new_status", F.when(passed_by, "skipped").otherwise(F.col("status"))).withColumn("note", F.when(passed_by, V.MOVED_STAGE_NOTE))


def public_view(rows: DataFrame) -> DataFrame:
    """What a candidate may see: no skipped rows, outcomes only if they came true, pending rounds only if enabled."""
    seen = rows.where("status <> 'skipped' and (stage_kind <> 'outcome' or status = 'passed') and (status <> 'pending' or enabled)")
    return seen.select("application_id", "stage_key", "position", L.lookup(F.col("status"), {"pending": "upcoming", "in_progress": "current", "passed": "done", "failed": "done"}).alias("state")).orderBy("application_id", "position")


def added_applications(wanted: DataFrame, applications: DataFrame) -> DataFrame:
    """The wanted (job_id, candidate_id, source) that don't exist yet, once each, with a stored source."""
    new = wanted.dropDuplicates(["job_id", "candidate_id"]).join(applications.select("job_id", "candidate_id"), ["job_id", "candidate_id"], "left_anti")
    return new.select("job_id", "candidate_id", L.source_key(F.col("source")).alias("source"), F.lit("active").alias("status"))
