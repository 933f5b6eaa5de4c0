"""Pipeline reports over a spine of stage rows.

The spine has one row for each application and stage: application_id, job_id, candidate_id,
application_status, source, applied_at, stage_id, stage_key, stage_name, stage_kind, position,
enabled, status, started_at, completed_at, changed_by, row_id. ``now`` is always an argument. Each
report is one pass over the spine or the applications; ranked lists end with an id.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions import labels as L
from talentgrid.functions import vocabulary as V


def spine(applications: DataFrame, stages: DataFrame, rows: DataFrame) -> DataFrame:
    """Stage rows with their stage and application (inner joins)."""
    r = rows.select(F.col("id").alias("row_id"), "application_id", "stage_id", "status", "started_at", "completed_at", "changed_by")
    s = stages.select(F.col("id").alias("stage_id"), F.col("key").alias("stage_key"), F.col("name").alias("stage_name"), F.col("kind").alias("stage_kind"), "position", "enabled")
    a = applications.select(F.col("id").alias("application_id"), "job_id", "candidate_id", F.col("status").alias("application_status"), "source", "applied_at")
    return r.join(s, "stage_id").join(a, "application_id")


def scoped(df: DataFrame, job_id: int | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Rows of one job, and of the given candidates only; no candidates given means all, an empty table means none."""
    if job_id is not None:
        df = df.where(F.col("job_id") == job_id)
    return df if candidates is None else df.join(candidates.select("candidate_id"), "candidate_id", "left_semi")


def counted(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


#: Accuracy of the sketch that brackets a median: some three in as many values of a group lie between its bounds.
BRACKET = 10_000


def medians(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """(by, median, n): the exact median of a column and how many values there are.

    A sketch of each group gives two values that the middle lies between, whatever the sketch's error. Values below are counted by
    partial sums; only those between are put in order, a few ten-thousandths of a group, equal ones as one row."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.lit(1).alias("_all"))
    group = ["_all", *by]
    reach = 3 / BRACKET
    bounds = rows.groupBy(*group).agg(F.percentile_approx("_v", [0.5 - reach, 0.5 + reach], BRACKET).alias("b"), F.count("*").alias("n"))
    bounds = bounds.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"), "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    placed = rows.join(bounds, same).withColumn("_v", F.when(F.col("_v") >= F.col("lo"), F.col("_v"))).where("_v is null or _v <= hi")  # all that is below counts as one value
    counts = placed.groupBy(*group, "_v").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.partitionBy(*group).orderBy(F.asc_nulls_first("_v"))))
    first_above = lambda place: F.min(F.when(F.col("upto") > place, F.col("_v")))
    middle = (first_above(F.floor((F.col("n") - 1) / 2)) + first_above(F.floor(F.col("n") / 2))) / 2
    return upto.groupBy(*group).agg(F.round(middle, 2).alias("median"), F.max("n").alias("n")).drop("_all")


def lasted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("days", L.days_between(F.col("started_at"), F.col("completed_at")))


def funnel(rows: DataFrame, one_job: bool = False) -> DataFrame:
    """Per round: how many applications ever reached it, how many are there now, and the share of all applications."""
    known, rounds = F.col("application_id").isNotNull(), F.col("stage_kind") == "round"
    reached = known & rounds & F.col("status").isin(*V.REACHED)
    here = known & rounds & (F.col("status") == "in_progress") & (F.col("application_status") == "active")
    # an application's rows of one stage become one by a sort, which spills, where distinct counts would keep every application in a hash map for
    # each of them; what is sorted has no more columns than it needs
    flags = F.when(rounds, 1).otherwise(0).bitwiseOR(F.when(reached, 2).otherwise(0)).bitwiseOR(F.when(here, 4).otherwise(0))
    lean = rows.select("application_id", "stage_key", F.when(rounds, F.col("stage_name")).alias("stage_name"), F.when(rounds, F.col("position")).alias("position"), flags.alias("_flags"))
    each = lean.groupBy("application_id", "stage_key").agg(F.min("position").alias("position"), F.min("stage_name").alias("stage_name"), F.bit_or("_flags").alias("_flags"))
    has = lambda flag: F.col("_flags").bitwiseAND(F.lit(flag)) != 0
    first = F.row_number().over(Window.partitionBy("application_id").orderBy("stage_key")) == 1
    by = each.withColumn("first", first & known).groupBy("stage_key").agg(
        F.max(has(1)).alias("round"), F.min("position").alias("position"), F.min("stage_name").alias("stage_name"), counted(has(2)).alias("ever"), counted(has(4)).alias("here"), counted(F.col("first")).alias("first"))
    by = by.withColumn("total", F.sum("first").over(Window.partitionBy())).where("round")  # as many rows as there are stages
    share = F.when(F.col("total") > 0, F.round(F.col("ever") / F.col("total"), 3)).otherwise(0.0)
    return by.select("stage_key", L.stage_name(F.col("stage_key"), F.col("stage_name"), one_job).alias("stage_name"), "position", "ever", "here", share.alias("share")).orderBy("position", "stage_key")


def time_in_stage(rows: DataFrame) -> DataFrame:
    """Exact median days of the rounds that ended after they began."""
    done = lasted(rows.where("stage_kind = 'round' and status in ('passed', 'failed') and completed_at > started_at"))
    place = done.groupBy("stage_key").agg(F.min("position").alias("position"))
    out = medians(done, ("stage_key",), "days").join(place, "stage_key")
    return out.select("stage_key", "position", F.col("median").alias("median_days"), "n").orderBy("position", "stage_key")


def time_to_outcome(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Median days from application to hire and to rejection, with counts; one row without ``by``, even over nothing."""
    decided = rows.withColumns({"started_at": F.col("applied_at"), "completed_at": F.col("outcome_at")})
    done = lasted(decided.where("completed_at > started_at and application_status in ('hired', 'rejected')"))
    of = lambda status, column: F.max(F.when(F.col("application_status") == status, F.col(column)))
    columns = []
    for status, name in (("hired", "hire"), ("rejected", "reject")):
        columns += [of(status, "median").alias(f"{name}_median"), F.coalesce(of(status, "n"), F.lit(0)).alias("hires" if name == "hire" else "rejects")]
    each = medians(done, (*by, "application_status"), "days")
    return each.groupBy(*by).agg(*columns).orderBy(*by) if by else each.agg(*columns)


def outcomes(rows: DataFrame) -> DataFrame:
    """Applications with the time of the stage row that decided them: a passed outcome, or the failed round."""
    deciding = (F.col("stage_kind") == "outcome") & (F.col("status") == "passed") | (F.col("status") == "failed")
    by = ("application_id", "job_id", "candidate_id", "application_status", "source", "applied_at")
    return rows.groupBy(*by).agg(F.max(F.when(deciding, F.col("completed_at"))).alias("outcome_at"))


def no_movement(rows: DataFrame, now: datetime, days: int = V.NO_MOVEMENT_DAYS) -> DataFrame:
    """Active applications whose current round began more than ``days`` ago, longest wait first."""
    at = F.lit(now)
    waiting = rows.where("application_status = 'active' and status = 'in_progress'").where(F.col("started_at") < at - F.make_dt_interval(F.lit(days)))
    return waiting.withColumn("days_waiting", L.whole_days(F.col("started_at"), at)).orderBy("started_at", "application_id")


def pending_feedback(interviews: DataFrame, feedback: DataFrame, now: datetime) -> DataFrame:
    """Interviews without submitted feedback, longest pending first, those without a start last."""
    open_ones = interviews.join(feedback.where("status = 'submitted'"), "interview_id", "left_anti")
    days = F.greatest(F.lit(0).cast("long"), L.whole_days(F.col("started_at"), F.lit(now)))
    return open_ones.withColumn("days_pending", days).orderBy(F.asc_nulls_last("started_at"), "interview_id")


def source_mix(applications: DataFrame) -> DataFrame:
    key = F.coalesce(L.blank_to_null(F.lower("source")), F.lit("unknown"))
    return applications.groupBy(key.alias("source")).agg(F.count("*").alias("applications"), counted(F.col("status") == "hired").alias("hired")).orderBy(F.desc("applications"), "source")


def department_mix(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    key = F.coalesce(L.blank_to_null(F.col("department")), F.lit("No department"))
    joined = applications.join(jobs.select(F.col("id").alias("job_id"), "department"), "job_id")
    return joined.groupBy(key.alias("department")).agg(F.count_distinct("job_id").alias("jobs"), F.count("*").alias("applications"), counted(F.col("status") == "hired").alias("hired")).orderBy(F.desc("applications"), "department")


def quarter(now: datetime, offset: int = 0) -> tuple[datetime, datetime, str]:
    """[start, end) and label of the calendar quarter of ``now``, moved by whole quarters."""
    n = 4 * now.year + (now.month - 1) // 3 + offset
    first = lambda k: datetime(k // 4, k % 4 * 3 + 1, 1)
    return first(n), first(n + 1), f"Q{n % 4 + 1} {n // 4}"


def outcomes_between(rows: DataFrame, start: datetime, end: datetime, label: str) -> DataFrame:
    """Hires and rejections decided in [start, end)."""
    inside = (F.col("outcome_at") >= F.lit(start)) & (F.col("outcome_at") < F.lit(end))
    return rows.agg(counted(inside & (F.col("application_status") == "hired")).alias("hires"), counted(inside & (F.col("application_status") == "rejected")).alias("rejects")).select(F.lit(label).alias("label"), "hires", "rejects")


def activity(rows: DataFrame, applications: DataFrame, limit: int = V.ACTIVITY_LIMIT) -> DataFrame:
    """The latest completions and arrivals, newest first, completions before arrivals of the same time. A round that an outcome
    of the same application ended at the same time isn't told twice; stages without an event are dropped after the cut."""
    closing = rows.where("stage_kind = 'outcome' and completed_at is not null").select("application_id", "completed_at").distinct()
    rounds = rows.where("completed_at is not null")
    told = rounds.where("stage_kind = 'outcome'").unionByName(rounds.where("stage_kind <> 'outcome'").join(closing, ["application_id", "completed_at"], "left_anti").select(*rounds.columns))
    kind = L.event_kind(F.col("stage_kind"), F.col("stage_key"), F.col("status"))
    done = told.orderBy(F.desc("completed_at"), F.desc("row_id")).limit(limit).select(F.lit(0).alias("feed"), F.col("completed_at").alias("at"), "application_id", kind.alias("event"), "stage_key", F.col("row_id").alias("id")).where("event is not null")
    arrived = applications.where("applied_at is not null").orderBy(F.desc("applied_at"), F.desc("id")).limit(limit).select(F.lit(1).alias("feed"), F.col("applied_at").alias("at"), F.col("id").alias("application_id"), F.lit("applied").alias("event"), F.lit(None).cast("string").alias("stage_key"), "id")
    return done.unionByName(arrived).orderBy(F.desc("at"), "feed", F.desc("id")).limit(limit)


def candidates_at_stage(rows: DataFrame, keys: list[str], now: datetime, limit: int = 25) -> DataFrame:
    """Who is at these stages, longest wait first, with the number of all of them on every row."""
    here = rows.where(F.col("stage_key").isin(*keys) & (F.col("status") == "in_progress") & (F.col("application_status") == "active"))
    total = here.agg(F.count("*").alias("total"))
    return here.join(F.broadcast(total)).withColumn("days_waiting", L.whole_days(F.col("started_at"), F.lit(now))).orderBy(F.asc_nulls_last("started_at"), "application_id").limit(limit)


def board(rows: DataFrame, per_stage: int = 10) -> DataFrame:
    """Per enabled round of a job: how many are there and the first of them by entry."""
    here = (F.col("status") == "in_progress") & (F.col("application_status") == "active")
    rounds = rows.where("stage_kind = 'round' and enabled").withColumn("here", F.coalesce(here, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("job_id", "stage_key", "here").orderBy(F.asc_nulls_first("started_at"), "application_id"))
    first = rounds.where("here").withColumn("place", place).where(F.col("place") <= per_stage)
    people = first.groupBy("job_id", "stage_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "application_id"))), lambda p: p["application_id"]).alias("people"))
    counts = rounds.groupBy("job_id", "stage_key").agg(F.min("position").alias("position"), counted(F.col("here")).alias("n"))
    none = F.array().cast(dict(people.dtypes)["people"])
    return counts.join(people, ["job_id", "stage_key"], "left").withColumn("people", F.coalesce("people", none)).orderBy("job_id", "position")


def status_counts(applications: DataFrame) -> DataFrame:
    """One row with every terminal status, zeros included, and the active ones."""
    return applications.agg(*(counted(F.col("status") == s).alias(s) for s in ("active", *V.TERMINAL)))
