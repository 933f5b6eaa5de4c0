"""Backfills of stage tables: rows that old data lacks, computed from what is there. Running one again adds nothing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status of a person -> place of the round in progress (from 0) and status of the application (fixed values).
SNAPSHOT = {"active": (0, "active"), "screening": (1, "active"), "interviewing": (3, "active"), "offered": (7, "active"), "on_hold": (1, "active")}
CLOSED = ("hired", "rejected", "declined", "withdrawn")


def with_outcome_stage(stages: DataFrame, key: str, name: str, kind: str = "outcome") -> DataFrame:
    """(job_id, key, name, kind, position) to add: the stage behind the last one of every job that has stages but not this one."""
    have = stages.groupBy("job_id").agg((F.max("position") + 1).alias("position"), F.max((F.col("key") == key).cast("int")).alias("has"))
    return have.where("has = 0").select("job_id", F.lit(key).alias("key"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), "position")


def outcome_rows(applications: DataFrame, stages: DataFrame, rows: DataFrame, key: str, now: datetime) -> DataFrame:
    """(application_id, stage_id, status, started_at, completed_at) to add: a row of the stage ``key`` for every application that
    has rows, but none of that stage.

    applications: id, job_id, status, applied_at; stages: id, job_id, key; rows: application_id, stage_id, completed_at. An application
    closed when its last row was completed, else when it was made, else now: a lateral lookup for each application."""
    a = applications.alias("a").join(stages.where(F.col("key") == key).select(F.col("id").alias("stage_id"), "job_id").alias("s"), "job_id")
    mine = rows.select("application_id", "completed_at").alias("r").where(F.col("r.application_id") == F.col("a.id").outer())
    closed = mine.select(F.max("completed_at").alias("last"))
    a = a.lateralJoin(closed).withColumn("at", F.coalesce("last", F.col("applied_at"), F.lit(now)))
    a = a.join(rows.select(F.col("application_id").alias("id")).distinct(), "id", "left_semi")
    a = a.join(rows.select(F.col("application_id").alias("id"), "stage_id").distinct(), ["id", "stage_id"], "left_anti")
    gone, active = F.col("status") == "withdrawn", F.col("status") == "active"
    return a.select(
        F.col("id").alias("application_id"), "stage_id", F.when(gone, "passed").when(active, "pending").otherwise("skipped").alias("status"),
        F.when(gone, F.col("at")).alias("started_at"), F.when(~F.coalesce(active, F.lit(False)), F.col("at")).alias("completed_at"),
    )


def _looked_up(c: Column, table: dict[str, object], other: object) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def snapshot_rows(applications: DataFrame, stages: DataFrame, rows: DataFrame) -> DataFrame:
    """(application_id, stage_id, status, started_at, completed_at, application_status) to add: a row per stage for every application
    that has none, placed by the person's status.

    applications: id, job_id, status, applied_at, candidate_status; stages: id, job_id, key, position. A closed application keeps its
    status; a person without a known status counts as active."""
    person = F.coalesce("candidate_status", F.lit("active"))
    closed = F.when(F.col("status").isin(*CLOSED), F.col("status")).when(person.isin("hired", "rejected", "withdrawn"), person)
    place = F.when(closed.isNull(), _looked_up(person, {k: v[0] for k, v in SNAPSHOT.items()}, 0))
    a = applications.join(rows.select(F.col("application_id").alias("id")).distinct(), "id", "left_anti")
    a = a.select("id", "job_id", "applied_at", F.coalesce(closed, F.lit("active")).alias("derived"), place.alias("place"))
    before = F.sort_array(F.collect_list(F.struct("position", F.col("id").alias("stage_id"), "key")))
    lists = stages.groupBy("job_id").agg(before.alias("all"))  # the few stages of one job
    each = a.join(lists, "job_id").select("*", F.posexplode("all").alias("i", "s"))
    i, derived = F.col("i"), F.col("derived")
    hired = F.when(F.col("s.key") == "offer_declined", "skipped").otherwise("passed")
    out = F.when(i == 0, "passed").when((i == 1) & (derived == "rejected"), "failed").otherwise("skipped")
    running = F.when(i < F.col("place"), "passed").when(i == F.col("place"), "in_progress").otherwise("pending")
    status = F.when(derived == "hired", hired).when(derived.isin(*CLOSED), out).otherwise(running)
    each = each.withColumn("state", status)
    return each.select(
        F.col("id").alias("application_id"), F.col("s.stage_id").alias("stage_id"), F.col("state").alias("status"), F.when(F.col("state") != "pending", F.col("applied_at")).alias("started_at"),
        F.when(F.col("state").isin("passed", "failed", "skipped"), F.col("applied_at")).alias("completed_at"), derived.alias("application_status"),
    )
