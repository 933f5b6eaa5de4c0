"""The stages of jobs as tables: their layout, edits to it, names as people type them, interviewers and feedback.

Stages have job_id, id, key, name, kind, position, enabled. An edit is one row for each job; what a rule refuses is a row with a
reason, and the job's stages stay as they are.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions import labels as L
from talentgrid.functions import text as T
from talentgrid.functions import vocabulary as V


def by_job():
    return Window.partitionBy("job_id")


def is_movable(key: Column, kind: Column) -> Column:
    """Interview rounds: all rounds but the first and the offers."""
    return (kind == "round") & (key != V.FIRST_ROUND) & ~key.isin(*V.OFFER_ROUNDS)


def is_custom(key: Column) -> Column:
    return key.startswith(V.CUSTOM_PREFIX)


def layout(stages: DataFrame, *order: Column) -> DataFrame:
    """Positions from 1 in each job: the first round, interview rounds in the given order, offers, outcomes as they were."""
    key = F.col("key")
    part = F.when(key == V.FIRST_ROUND, 0).when(is_movable(key, F.col("kind")), 1).when(key.isin(*V.OFFER_ROUNDS), 2).otherwise(3)
    offer = F.array_position(F.array(*map(F.lit, V.OFFER_ROUNDS)), key)
    place = by_job().orderBy(part, F.when(part == 2, offer), *(F.when(part == 1, c) for c in order), "position")
    return stages.withColumn("position", F.row_number().over(place))


def reordered(stages: DataFrame, orders: DataFrame) -> DataFrame:
    """The stages of jobs after new orders (job_id, keys) of their interview rounds; refused where an order isn't exactly these."""
    df = stages.join(orders, "job_id", "left")
    movable = F.sort_array(F.collect_set(F.when(is_movable(F.col("key"), F.col("kind")), F.col("key"))).over(by_job()))
    exact = (F.sort_array("keys") == movable) & (F.size(F.array_distinct("keys")) == F.size("keys"))
    df = df.withColumn("refused", F.when(F.col("keys").isNotNull() & ~exact, "the order must list every interview stage exactly once"))
    asked = F.when(F.col("refused").isNull() & F.col("keys").isNotNull(), F.array_position("keys", F.col("key")))
    return layout(df.withColumn("_asked", asked), F.col("_asked")).drop("keys", "_asked")


def without_stages(stages: DataFrame, rows: DataFrame, removals: DataFrame) -> DataFrame:
    """(job_id, key, refused) of removals (job_id, key): only added stages go, and only those at which no candidate has history (rows:
    stage_id, status)."""
    history = rows.where(F.col("status").isin(*V.REACHED)).select(F.col("stage_id").alias("id")).distinct().withColumn("used", F.lit(True))
    found = removals.join(stages.select("job_id", "key", "id"), ["job_id", "key"], "left").join(history, "id", "left")
    refused = (
        F.when(F.col("id").isNull(), "no such stage").when(~is_custom(F.col("key")), "a default stage can only be turned off")
        .when(F.col("used"), "the stage has candidate history")
    )
    return found.select("job_id", "key", refused.alias("refused"))


def removed(stages: DataFrame, outcome: DataFrame) -> DataFrame:
    """The stages without those that ``without_stages`` let go, renumbered."""
    gone = outcome.where(F.col("refused").isNull()).select("job_id", "key")
    left = stages.join(gone, ["job_id", "key"], "left_anti")
    return left.withColumn("position", F.row_number().over(by_job().orderBy("position")))


def switched(stages: DataFrame, switches: DataFrame, rows: DataFrame) -> DataFrame:
    """(job_id, key, enabled, refused) of switches (job_id, key, enabled): the first round and outcomes stay on, and so does a stage
    where active applications are (rows: stage_id, application_status, status)."""
    here = rows.where((F.col("status") == "in_progress") & (F.col("application_status") == "active")).groupBy(F.col("stage_id").alias("id")).agg(F.count("*").alias("here"))
    own = stages.select("job_id", "key", "id", "kind", F.col("enabled").alias("was"))
    found = switches.join(own, ["job_id", "key"], "left").join(here, "id", "left")
    off = ~F.col("enabled")
    refused = (
        F.when(F.col("id").isNull(), "no such stage").when(off & ((F.col("kind") == "outcome") | (F.col("key") == V.FIRST_ROUND)), "the stage cannot be turned off")
        .when(off & F.col("was") & (F.coalesce("here", F.lit(0)) > 0), "candidates are at the stage")
    )
    return found.select("job_id", "key", F.when(refused.isNull(), F.col("enabled")).otherwise(F.col("was")).alias("enabled"), refused.alias("refused"))


def resolved(stages: DataFrame, text: str, one_job: bool = False) -> DataFrame:
    """(key, name, position) of the rounds that a text means, in pipeline order: an alias, else an exact key or name, else all rounds
    whose key or name holds the words."""
    name = L.stage_name(F.col("key"), F.col("name"), one_job)
    rounds = stages.where("kind = 'round'").groupBy("key").agg(F.min("name").alias("name"), F.min("position").alias("position")).withColumn("name", name)
    wanted = T.stage_text(F.lit(text))
    alias = F.coalesce(*(F.when(wanted == a, F.array(*map(F.lit, keys))) for a, keys in V.STAGE_ALIASES.items()))
    names = F.array(T.stage_text(F.col("key")), T.stage_text(F.col("name")))
    rank = F.when(alias.isNotNull(), F.when(F.array_contains(alias, F.col("key")), 0)).when(F.array_contains(names, wanted), 1).when(F.exists(names, lambda n: n.contains(wanted)), 2)
    ranked = rounds.withColumn("rank", F.when(wanted != "", rank)).where("rank is not null")
    best = ranked.agg(F.min("rank").alias("best"))
    return ranked.join(F.broadcast(best), F.col("rank") == F.col("best")).select("key", "name", "position").orderBy("position", "key")


def can(role: Column, permission: str) -> Column:
    """Whether a role may do something; unknown roles may nothing."""
    return F.coalesce(role.isin(*(r for r, own in V.PERMISSIONS.items() if permission in own)), F.lit(False))


def assigned(wanted: DataFrame, interviews: DataFrame) -> DataFrame:
    """(row_id, user_id, outcome) of interviewers for stage rows (row_id, user_id, role, kind, status, application_status): new, already,
    or why not. ``interviews`` has row_id and user_id."""
    had = interviews.select("row_id", "user_id").distinct().withColumn("had", F.lit(True))
    once = wanted.dropDuplicates(["row_id", "user_id"]).join(had, ["row_id", "user_id"], "left")
    outcome = (
        F.when(~F.coalesce(F.col("role").isin(*V.STAFF_ROLES), F.lit(False)), "not on the team").when(F.col("kind") != "round", "not a round")
        .when(F.col("application_status").isin(*V.TERMINAL), "the application is closed").when(F.col("status") == "skipped", "the stage was skipped")
        .when(F.col("had"), "already").otherwise("new")
    )
    return once.select("row_id", "user_id", outcome.alias("outcome"))


def default_interviewers(entered: DataFrame, defaults: DataFrame, interviews: DataFrame) -> DataFrame:
    """``assigned`` for the default interviewers (stage_id, user_id, role) of stages that applications entered (row_id, stage_id, kind,
    status, application_status); only people on the team count."""
    staff = defaults.where(F.col("role").isin(*V.STAFF_ROLES))
    return assigned(entered.join(staff, "stage_id"), interviews)


def feedback_written(forms: DataFrame, interviews: DataFrame, now: datetime) -> DataFrame:
    """Feedback after forms (interview_id, user_id, action draft or submit, rating, recommendation, notes), one for each interview.
    ``interviews``: interview_id, interviewer_id, stage_status, status (draft, submitted or null). Refused forms change nothing."""
    df = forms.join(interviews, "interview_id", "left")
    submit = F.col("action") == "submit"
    known = F.col("recommendation").isin(*V.RECOMMENDATIONS)
    refused = (
        F.when(F.col("interviewer_id").isNull(), "no such interview").when(F.col("interviewer_id") != F.col("user_id"), "only the assigned interviewer can write")
        .when(F.col("status") == "submitted", "feedback has been submitted").when(~F.col("stage_status").isin(*V.REACHED), "the stage has not started")
        .when(F.coalesce(~known, submit), "choose one of the four recommendations").when(F.coalesce(~F.col("rating").between(1, 5), submit), "a rating is from 1 to 5")
    )
    notes = F.when(submit, F.nullif(F.trim("notes"), F.lit(""))).otherwise(F.nullif(F.col("notes"), F.lit("")))
    df = df.withColumn("refused", refused).withColumn("ok", F.col("refused").isNull())
    return df.select(
        "interview_id", "refused", F.when(F.col("ok"), F.when(submit, "submitted").otherwise("draft")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("ok"), F.col("rating")).alias("rating"), F.when(F.col("ok"), F.col("recommendation")).alias("recommendation"), F.when(F.col("ok"), notes).alias("notes"),
        F.when(F.col("ok") & submit, F.lit(now)).alias("submitted_at"), F.when(F.col("ok"), F.lit(now)).alias("updated_at"),
    )


def tallies(entries: DataFrame, by: str) -> DataFrame:
    """(by, tally, split) of submitted feedback (by, recommendation, rating): the recommendations and ratings as a sentence, and a note
    where some say hire and some do not."""
    counts = [F.count(F.when(F.col("recommendation") == k, 1)).alias(f"_{k}") for k in V.RECOMMENDATIONS]
    hire = F.count(F.when(F.col("recommendation").isin(*V.HIRE_SIDE), 1)).alias("_side")
    all_of = F.count(F.nullif(F.col("recommendation"), F.lit(""))).alias("_all")
    df = entries.groupBy(by).agg(*counts, hire, all_of, F.min("rating").alias("_low"), F.max("rating").alias("_high"))
    said = [F.when(F.col(f"_{k}") > 0, F.concat(F.col(f"_{k}").cast("string"), F.lit(" " + words.lower()))) for k, words in V.RECOMMENDATIONS.items()]
    low, high = F.col("_low").cast("string"), F.col("_high").cast("string")
    ratings = F.when(F.col("_low") == F.col("_high"), F.concat(F.lit("every rating "), low, F.lit(" of 5"))).otherwise(F.concat(F.lit("ratings from "), low, F.lit(" to "), high, F.lit(" of 5")))
    text = F.concat_ws(", ", *said, ratings)
    sentence = F.when(text == "", "").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000), F.lit(".")))
    against = F.col("_all") - F.col("_side")
    split = F.concat(F.lit("The recommendations are split: "), F.col("_side").cast("string"), F.lit(" hire or strong hire, "), against.cast("string"), F.lit(" against."))
    return df.select(by, sentence.alias("tally"), F.when((F.col("_side") > 0) & (against > 0), split).alias("split"))


def score_visible(applications: DataFrame, rows: DataFrame, interviews: DataFrame, feedback: DataFrame, user: str, role: str) -> DataFrame:
    """(candidate_id) whose score a user may see: all of them with the permission, else those they submitted feedback on."""
    if "score.before_feedback" in V.PERMISSIONS.get(role, ()):
        return applications.select("candidate_id").distinct()
    told = feedback.where("status = 'submitted'").select("interview_id")
    mine = interviews.where(F.col("interviewer_id") == user).join(told, "interview_id", "left_semi").select(F.col("application_stage_id").alias("id"))
    at = rows.join(mine, "id", "left_semi").select(F.col("application_id").alias("id"))
    return applications.join(at, "id", "left_semi").select("candidate_id").distinct()


def feedback_visible(interviews: DataFrame, visible: DataFrame, user: str) -> DataFrame:
    """Interviews (interview_id, interviewer_id, candidate_id) whose feedback a user may read: their own, and others' where they may see the score."""
    seen = visible.select("candidate_id").distinct().withColumn("_seen", F.lit(True))
    return interviews.join(seen, "candidate_id", "left").where((F.col("interviewer_id") == user) | F.col("_seen")).drop("_seen")


def actions(status: Column, current_key: Column, later_round: Column) -> Column:
    """What can be done with an application, in order; nothing where it is closed or at no stage."""
    open_here = (status == "active") & current_key.isNotNull()
    some = F.array(F.lit("advance"), F.when(later_round, "skip"), F.lit("reject"), F.when(current_key.isin(*V.DECLINABLE), "decline"), F.lit("withdraw"))
    return F.when(open_here, F.filter(some, lambda a: a.isNotNull())).otherwise(F.array().cast("array<string>"))
