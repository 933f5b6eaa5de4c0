"""Scoring of pairs of jobs and candidates.

What depends on one side only is worked out on that side, once for each job and once for each candidate. The pairs then go
through steps of plain columns, each of which the next step reads, so that the plan stays short and nothing is computed twice.

Jobs: job_id, title, text, wanted (array), requirements (JSON or null). Candidates: id, position, skills (array), and where
they are known years (double), degrees (array) and similarity (cosine of the titles' embeddings; null for none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions import requirements as R
from talentgrid.functions import scoring as S
from talentgrid.functions import vocabulary as V

#: Jobs that may be broadcast to the candidates; more of them are paired by a shuffle.
MOST_JOBS = 10_000


def keys(skills: Column) -> Column:
    return F.transform(F.coalesce(skills, R.no_skills()), lambda s: F.trim(F.lower(s)))


def with_title(df: DataFrame, own: str, title: str, text: Column) -> DataFrame:
    """Adds what is read from a title: its role categories, and level and years of a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    df = df.withColumns({f"{own}_plain": S.plain_title(F.col(title)), f"{own}_found": S.years_in(low)})
    df = df.withColumns({f"{own}_skill_kind": S.role_category(F.col(f"{own}_plain"), False), f"{own}_role_kind": S.role_category(F.col(f"{own}_plain"), True)})
    df = df.withColumn(f"{own}_level", S.level_of(low, F.col(f"{own}_found")))
    return df.withColumn(f"{own}_years", F.coalesce(F.col(f"{own}_found"), S.usual_years(F.col(f"{own}_level")))).drop(f"{own}_plain", f"{own}_found")


def job_side(jobs: DataFrame) -> DataFrame:
    raw = F.col("requirements") if "requirements" in jobs.columns else F.lit(None).cast("string")
    df = jobs.select("job_id", "title", "text", F.coalesce("wanted", R.no_skills()).alias("wanted"), R.parsed(raw).alias("req"))
    df = df.withColumns({"want": keys(R.with_must_haves(F.col("wanted"), F.col("req.must"))), "must": F.coalesce("req.must", R.no_skills()), "nice": F.coalesce("req.nice", R.no_skills())})
    return with_title(df.select("job_id", "title", "text", "want", "must", "nice", "req.min_years", "req.max_years", "req.min_education"), "j", "title", F.concat_ws(" ", "title", "text"))


def candidate_side(candidates: DataFrame) -> DataFrame:
    given = lambda name, kind: F.col(name).cast(kind) if name in candidates.columns else F.lit(None).cast(kind)
    df = candidates.select(
        "id", "position", keys(F.col("skills")).alias("have"), given("similarity", "double").alias("similarity"),
        given("years", "double").alias("years"), R.highest_education(given("degrees", "array<string>")).alias("education"),
    )
    return with_title(df, "c", "position", F.col("position"))


def with_matches(df: DataFrame, wanted: str, out: str) -> DataFrame:
    """Adds which wanted skills the candidate has (exact), nearly has (partial) and lacks (missing), spelt as they are wanted."""
    key = lambda s: F.trim(F.lower(s))
    has = lambda s: F.array_contains(F.col("have"), key(s))
    near = lambda s: F.exists("have", lambda h: (h.contains(key(s)) | key(s).contains(h)) & (F.abs(F.length(key(s)) - F.length(h)) <= V.NEAR_LENGTH))
    df = df.withColumns({f"{out}_exact": F.filter(wanted, lambda s: (key(s) != "") & has(s)), f"{out}_rest": F.filter(wanted, lambda s: (key(s) != "") & ~has(s))})
    df = df.withColumn(f"{out}_partial", F.filter(f"{out}_rest", near))
    return df.withColumn(f"{out}_missing", F.filter(f"{out}_rest", lambda s: ~F.array_contains(F.col(f"{out}_partial"), s))).drop(f"{out}_rest")


def scored(pairs: DataFrame) -> DataFrame:
    """Adds to pairs of both sides match_score with its parts: skill, role, relationship, experience, tier, penalized, reasons, limit
    and explanation."""
    c = F.col
    df = pairs
    for wanted, out in (("want", "skill"), ("must", "must"), ("nice", "nice")):
        df = with_matches(df, wanted, out)
    # skills, with points for nice-to-have ones, cut between categories whose skills don't carry over
    hits = F.size("skill_exact") + F.size("skill_partial")
    share = (F.size("skill_exact") * 100.0 + F.size("skill_partial") * 50.0) / F.nullif(F.size("want"), F.lit(0))
    overlap = F.when((F.size("want") == 0) | (F.size("have") == 0), V.NO_SIGNAL).otherwise(F.least(F.lit(100.0), share * F.when(hits >= F.size("want") * 0.8, 1.1).otherwise(1.0)))
    bonus = V.NICE_BONUS * (F.size("nice_exact") + 0.5 * F.size("nice_partial")) / F.nullif(F.size("nice"), F.lit(0))
    df = df.withColumns({"overlap": overlap, "bonus": F.coalesce(bonus, F.lit(0.0))})
    df = df.withColumn("skill", S.skill_penalty(F.least(c("overlap") + c("bonus"), F.lit(100.0)), c("j_skill_kind"), c("c_skill_kind")))
    # role and seniority
    df = df.withColumn("relationship", S.relationship(c("title"), c("position"), c("j_role_kind"), c("c_role_kind")))
    df = df.withColumn("base", F.when(c("relationship") == "missing", V.NO_SIGNAL).otherwise(F.coalesce(c("similarity") * 100.0, F.lit(V.NO_SIGNAL))))
    df = df.withColumn("role", S.role_score(c("base"), c("relationship")))
    df = df.withColumns({"short": R.years_short(c("min_years"), c("years")), "over": R.years_over(c("min_years"), c("max_years"), c("years"))})
    df = df.withColumns({
        "seniority": S.experience_score(c("j_level"), c("j_years"), c("c_level"), c("c_years")),
        "penalty": R.years_penalty(c("short"), c("over")),
        "met": R.education_met(c("min_education"), c("education")),
    })
    df = df.withColumn("experience", F.greatest(c("seniority") - c("penalty"), F.lit(0.0)))
    # the blend, and what caps it
    df = df.withColumns({"tier": S.tier_name(c("role")), "penalized": (c("role") < V.WEAK_ROLE) & (c("skill") < V.WEAK_SKILL)})
    df = df.withColumn("before", S.blended(c("tier"), c("skill"), c("role"), c("experience")) * F.when(c("penalized"), V.WEAK_FACTOR).otherwise(1.0))
    df = df.withColumn("reasons", R.missing(c("must_missing"), c("min_years"), c("short"), c("min_education"), c("met")))
    df = df.withColumn("limit", R.cap(F.size("reasons")))
    rules = R.explanation({
        "must": c("must"), "must_missing": c("must_missing"), "nice": c("nice"), "nice_hits": F.size("nice_exact") + F.size("nice_partial"), "min_years": c("min_years"),
        "max_years": c("max_years"), "years": c("years"), "short": c("short"), "over": c("over"), "min_education": c("min_education"), "education": c("education"),
        "met": c("met"), "reasons": c("reasons"), "limit": c("limit"), "before": c("before"),
    })
    words = F.concat_ws(". ", S.explanation(c("skill_exact"), c("role"), c("skill"), c("experience")), F.nullif(rules, F.lit("")))
    return df.select(
        "job_id", "id", F.least("before", "limit").alias("match_score"), "skill", "role", "relationship", "experience", "tier", "penalized",
        F.col("skill_exact").alias("exact"), F.col("skill_partial").alias("partial"), F.col("skill_missing").alias("missing"), "reasons", "limit", words.alias("explanation"),
    )


def pairs(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every job with every candidate. The jobs are broadcast where their number has been checked."""
    jobs = job_side(jobs)
    few = jobs.select("job_id").limit(MOST_JOBS + 1).count() <= MOST_JOBS
    return candidate_side(candidates).crossJoin(F.broadcast(jobs) if few else jobs)


def best_candidates(jobs: DataFrame, candidates: DataFrame, least: float = V.LEAST_SCORE, limit: int = 10) -> DataFrame:
    """The best candidates of every job by score, at least ``least``, at most ``limit`` a job, with their rank."""
    order = Window.partitionBy("job_id").orderBy(F.desc("match_score"), "id")
    ranked = scored(pairs(jobs, candidates)).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= limit) & (F.col("match_score") >= least))  # after the rank, or the whole score would become the join's condition


def best_jobs(candidates: DataFrame, jobs: DataFrame, least: float = V.LEAST_SCORE, limit: int = 10) -> DataFrame:
    """The best jobs of every candidate by score."""
    order = Window.partitionBy("id").orderBy(F.desc("match_score"), "job_id")
    ranked = scored(pairs(jobs, candidates)).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= limit) & (F.col("match_score") >= least))  # after the rank, or the whole score would become the join's condition


def trace(jobs: DataFrame, candidates: DataFrame, candidate_id=None, limit: int = 50) -> DataFrame:
    """All candidates of every job with their rank over all; one candidate keeps the rank among all."""
    order = Window.partitionBy("job_id").orderBy(F.desc("match_score"), "id")
    ranked = scored(pairs(jobs, candidates)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit) if candidate_id is None else ranked.where(F.col("id") == candidate_id)


def applicants(applications: DataFrame, jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The scores of the candidates that applied to each job; pairs come from the applications, not from all."""
    wanted = applications.select("job_id", F.col("candidate_id").alias("id")).distinct()
    return scored(wanted.join(candidate_side(candidates), "id").join(job_side(jobs), "job_id"))


def profiles(candidates: DataFrame, spans: DataFrame, degrees: DataFrame, today: Column) -> DataFrame:
    """(id, years, degrees) of every candidate (id): years of dated experience (candidate_id, start_date, end_date), overlaps once,
    and all degrees (candidate_id, degree). Without rows both are null."""
    from talentgrid.operators.ranking import merged_years

    years = merged_years(spans, "candidate_id", today).withColumnRenamed("candidate_id", "id")
    held = degrees.where(F.col("degree").isNotNull()).groupBy(F.col("candidate_id").alias("id")).agg(F.array_sort(F.collect_list("degree")).alias("degrees"))
    return candidates.select("id").join(years, "id", "left").join(held, "id", "left")
