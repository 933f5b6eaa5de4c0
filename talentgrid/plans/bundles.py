"""Reports that belong together, as named lazy DataFrames over one spine, and the composed searches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions import labels as L
from talentgrid.functions import scoring as S
from talentgrid.functions import vocabulary as V
from talentgrid.operators import matching, search, vectors
from talentgrid.operators import reports as R


def dashboard(spine: DataFrame, applications: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Funnel, outcomes, waiting and activity of one scope; nothing runs until a part is asked for."""
    stages = R.funnel(spine)
    late = stages.where(F.col("position") >= V.INTERVIEW_POSITION).agg(F.coalesce(F.sum("here"), F.lit(0)).alias("here"))
    hired = applications.agg(F.count(F.when(F.col("status") == "hired", 1)).alias("hired"), F.count("*").alias("total"))
    summary = late.join(F.broadcast(hired)).select((F.col("here") + F.col("hired")).alias("interviewing_or_later"), "hired", "total")
    return {"summary": summary, "funnel": stages, "outcomes": R.time_to_outcome(R.outcomes(spine)), "no_movement": R.no_movement(spine, now).limit(V.LIST_LIMIT), "activity": R.activity(spine, applications)}


def reports(spine: DataFrame, applications: DataFrame, jobs: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """All reports of one scope, this quarter's and the last one's outcomes included."""
    decided = R.outcomes(spine)
    return {
        "funnel": R.funnel(spine), "time_in_stage": R.time_in_stage(spine), "time_to_outcome": R.time_to_outcome(decided), "by_job": R.time_to_outcome(decided, ("job_id",)),
        "sources": R.source_mix(applications), "departments": R.department_mix(applications, jobs),
        "quarters": R.outcomes_between(decided, *R.quarter(now)).unionByName(R.outcomes_between(decided, *R.quarter(now, -1))),
    }


def candidate_search(candidates: DataFrame, query_vector: Column, query: str, place: str = "", limit: int = 8, key: str = "id") -> DataFrame:
    """The pool nearest to a query, in a place if one is asked for, banded by the evidence of its words and ranked."""
    pool = candidates.where(L.like_any(F.col("location"), L.place_patterns(place))) if place else candidates
    hits = vectors.top_k(pool, query_vector, key, V.SEARCH_POOL, floor=V.MIN_SEARCH_RELEVANCE)
    banded = search.banded(hits, query, "similarity", ["position", "company", "headline", "skills"], V.MIN_SEARCH_RELEVANCE)
    return search.ranked(banded, "similarity", key, limit)


def candidates_for_job(job: DataFrame, candidates: DataFrame, least: float = V.LEAST_SCORE, limit: int = 10) -> DataFrame:
    """The best candidates for one job, by score."""
    return matching.best_candidates(job.limit(1), candidates, least, limit).orderBy("rank")


def similar_jobs(jobs: DataFrame, job_id: int, limit: int = 5) -> DataFrame:
    """The jobs (id, title, skills, location) most like one of them."""
    one = jobs.where(F.col("id") == job_id).select(F.col("title").alias("_t"), F.col("skills").alias("_s"), F.col("location").alias("_l")).limit(1)
    score = S.job_similarity(F.col("_t"), F.col("title"), F.col("_s"), F.col("skills"), F.col("_l"), F.col("location"))
    return jobs.where(F.col("id") != job_id).join(F.broadcast(one)).withColumn("score", F.round(score, 1)).drop("_t", "_s", "_l").orderBy(F.desc("score"), "id").limit(limit)
