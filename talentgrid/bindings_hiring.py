"""More operators bound to the star-schema tables, with their SQL: lists and counts, stage edits, feedback, dates, profiles.

Roles are those of ``bindings``. Stage rows have the id order key * 10 + line number; an interviewer is a supplier.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.bindings import APPS_SQL, NOW, NOW_SQL, SKILLS_SQL, STATUS_SQL, applications, query, skills, stage_rows
from talentgrid.functions import dates as D
from talentgrid.functions import profiles as P
from talentgrid.functions import vocabulary as V
from talentgrid.operators import listing, ranking, stages, transitions
from talentgrid.sources.tables import table


def customer_tags(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("tag"))


# ---------------------------------------------------------------- lists and counts
@query("tag_counts", "SELECT o_orderpriority AS tag, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 3) GROUP BY 1")
def tag_counts(spark, d):
    seen = table(spark, d, "lineitem").where("l_suppkey = 3").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("candidate_id"))
    return listing.tag_counts(customer_tags(spark, d), seen)


@query("tags_by_candidate", "SELECT o_custkey AS candidate_id, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS tags FROM orders GROUP BY 1")
def tags_by_candidate(spark, d):
    return listing.tags_of(customer_tags(spark, d)).select("candidate_id", F.array_join("tags", ", ").alias("tags"))


@query("tag_removed", "SELECT o_custkey AS candidate_id, o_orderpriority AS tag, count(*) AS n FROM orders WHERE NOT (o_custkey % 3 = 0 AND o_orderpriority = '2-HIGH') GROUP BY 1, 2")
def tag_removed(spark, d):
    gone = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("candidate_id"), F.lit("2-HIGH").alias("tag"))
    return listing.without_tag(customer_tags(spark, d), gone).groupBy("candidate_id", "tag").agg(F.count("*").alias("n"))


@query("active_counts", f"SELECT job_id, count(*) AS n FROM {APPS_SQL} WHERE status = 'active' GROUP BY 1")
def active_counts(spark, d):
    return listing.active_counts(applications(spark, d))


@query("department_counts", "SELECT CASE WHEN r_regionkey = 1 THEN '' ELSE r_name END AS department, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 1 GROUP BY 1")
def department_counts(spark, d):
    jobs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return listing.department_counts(jobs.select(F.when(F.col("r_regionkey") == 1, "").otherwise(F.col("r_name")).alias("department")))


@query("top_positions", "SELECT coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END, '(unspecified)') AS position, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 4")
def top_positions(spark, d):
    people = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("position_applied"), F.lit("active").alias("status"))
    jobs = table(spark, d, "nation").select(F.lit("open").alias("status"))
    return listing.pipeline_overview(people, jobs, 4)["positions"]


@query("jobs_without_stage", "SELECT l_orderkey AS job_id, max(l_linenumber) AS last FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R')")
def jobs_without_stage(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("key"), F.col("l_linenumber").alias("position"))
    return listing.without_stage(rows, "R")


CURRENT_SQL = """(SELECT l_orderkey AS id, min(l_returnflag) AS stage_key FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)"""


@query("candidate_applications", f"""
    SELECT a.id, candidate_id, n_name AS job_title, r_name AS job_department, status, stage_key FROM {APPS_SQL} a JOIN nation ON job_id = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN {CURRENT_SQL} c ON c.id = a.id""")
def candidate_applications(spark, d):
    jobs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.col("r_name").alias("department"))
    return listing.applications_of(applications(spark, d), jobs, stage_rows(spark, d)).select("id", "candidate_id", "job_title", "job_department", "status", "stage_key")


@query("application_details", f"""
    SELECT a.id, string_agg(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END || l_returnflag || CASE l_linestatus WHEN 'F' THEN 'passed' ELSE 'in_progress' END, ' '
           ORDER BY CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, l_linestatus DESC) AS line FROM {APPS_SQL} a LEFT JOIN lineitem ON l_orderkey = a.id GROUP BY 1""")
def application_details(spark, d):
    line = F.array_join(F.transform("stages", lambda s: F.concat(s["position"].cast("string"), s["stage_key"], s["status"])), " ")
    return listing.details(applications(spark, d).select("id"), stage_rows(spark, d)).select("id", F.nullif(line, F.lit("")).alias("line"))


@query("job_people", f"""
    SELECT job_id, stage_key, n, application_id, days FROM (
      SELECT c_nationkey AS job_id, l_returnflag AS stage_key, l_orderkey AS application_id, CAST(floor((epoch_us({NOW_SQL}) - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) AS days,
             row_number() OVER (PARTITION BY c_nationkey, l_returnflag ORDER BY o_orderdate, l_orderkey) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linestatus = 'O' AND o_orderstatus = 'O') WHERE n <= 10""")
def job_people(spark, d):
    return listing.job_pipeline(stage_rows(spark, d), applications(spark, d), NOW)["people"].drop("candidate_id")


@query("job_outcomes", f"""
    SELECT job_id, count(CASE WHEN status = 'hired' THEN 1 END) AS hired, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected, count(CASE WHEN status = 'declined' THEN 1 END) AS declined,
           count(CASE WHEN status = 'withdrawn' THEN 1 END) AS withdrawn FROM {APPS_SQL} GROUP BY 1""")
def job_outcomes(spark, d):
    return listing.job_pipeline(stage_rows(spark, d), applications(spark, d), NOW)["outcomes"]


@query("audit_subjects", """
    SELECT CASE event_id % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'application' WHEN 2 THEN 'stage' ELSE 'other' END AS type, CAST(CASE event_id % 4 WHEN 2 THEN event_id * 10 + 1 ELSE event_id END AS VARCHAR) AS id,
           CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey = event_id)
             WHEN 2 THEN (SELECT CAST(min(o_custkey) AS VARCHAR) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = event_id AND l_linenumber = 1) END AS candidate_id FROM events""")
def audit_subjects(spark, d):
    k = F.col("event_id")
    kind = F.when(k % 4 == 0, "candidate").when(k % 4 == 1, "application").when(k % 4 == 2, "stage").otherwise("other")
    subjects = table(spark, d, "events").select(kind.alias("type"), F.when(k % 4 == 2, k * 10 + 1).otherwise(k).cast("string").alias("id"))
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("application_id")).distinct()
    interviews = rows.limit(0).select("id", F.col("id").alias("application_stage_id"))
    return listing.candidate_of(subjects, applications(spark, d), rows, interviews)


# ---------------------------------------------------------------- stages
STAGES_SQL = "(SELECT n_nationkey AS job_id, key, position, n_nationkey * 100 + position AS id FROM nation, (VALUES " + ", ".join(f"('{k}', {p})" for p, (k, *_) in enumerate(V.DEFAULT_STAGES, 1)) + ") s(key, position))"


def job_stages(spark, d):
    """The default stages of every nation as a job."""
    jobs = table(spark, d, "nation").select(F.col("n_nationkey").alias("job_id"))
    both = jobs.join(F.broadcast(transitions.default_stages(spark)))
    return both.select("job_id", (F.col("job_id") * 100 + F.col("position")).alias("id"), "key", "name", "kind", "position", F.lit(True).alias("enabled"))


@query("stages_reordered", f"""
    SELECT job_id, key, CASE WHEN job_id % 3 = 0 AND position BETWEEN 2 AND 7 THEN 9 - position ELSE position END AS position,
           CASE WHEN job_id % 3 = 1 THEN 'the order must list every interview stage exactly once' END AS refused FROM {STAGES_SQL}""")
def stages_reordered(spark, d):
    middle = [k for k, _, kind in V.DEFAULT_STAGES if kind == "round" and k != V.FIRST_ROUND and k not in V.OFFER_ROUNDS]
    order = F.when(F.col("job_id") % 3 == 0, F.array(*map(F.lit, middle[::-1]))).otherwise(F.array(*map(F.lit, [*middle[1:], middle[1]])))
    orders = table(spark, d, "nation").select(F.col("n_nationkey").alias("job_id")).where("job_id % 3 < 2").select("job_id", order.alias("keys"))
    return stages.reordered(job_stages(spark, d), orders).select("job_id", "key", "position", "refused")


@query("stages_switched", f"""
    SELECT job_id, key, CASE WHEN key IN ('resume_submitted', 'offer_declined', 'hired', 'withdrawn') THEN 'the stage cannot be turned off' WHEN (job_id + position) % 5 = 0 THEN 'candidates are at the stage' END AS refused,
           key IN ('resume_submitted', 'offer_declined', 'hired', 'withdrawn') OR (job_id + position) % 5 = 0 AS enabled FROM {STAGES_SQL}""")
def stages_switched(spark, d):
    all_stages = job_stages(spark, d)
    here = all_stages.where("(job_id + position) % 5 = 0").select(F.col("id").alias("stage_id"), F.lit("active").alias("application_status"), F.lit("in_progress").alias("status"))
    return stages.switched(all_stages, all_stages.select("job_id", "key", F.lit(False).alias("enabled")), here)


@query("stages_removed", f"""
    SELECT job_id, key, CASE WHEN key NOT LIKE 'custom%' THEN 'a default stage can only be turned off' WHEN job_id % 2 = 0 THEN 'the stage has candidate history' END AS refused
    FROM (SELECT job_id, CASE WHEN position = 3 THEN 'custom_' || key ELSE key END AS key FROM {STAGES_SQL})""")
def stages_removed(spark, d):
    own = job_stages(spark, d).withColumn("key", F.when(F.col("position") == 3, F.concat(F.lit("custom_"), "key")).otherwise(F.col("key")))
    history = own.where("position = 3").select(F.col("id").alias("stage_id"), F.when(F.col("job_id") % 2 == 0, "passed").otherwise("pending").alias("status"))
    return stages.without_stages(own, history, own.select("job_id", "key"))


@query("stage_resolved", "SELECT l_returnflag AS key, 'Round ' || l_returnflag AS name, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS position FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2, 3")
def stage_resolved(spark, d):
    rows = stage_rows(spark, d).select("job_id", F.col("stage_key").alias("key"), F.col("stage_name").alias("name"), F.col("stage_kind").alias("kind"), "position")
    return stages.resolved(rows, "the N stage")


ROLE_SQL = "CASE l_suppkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'interviewer' WHEN 2 THEN 'demo' END"


@query("interviewers_assigned", f"""
    SELECT outcome, count(*) AS n FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey, CASE WHEN {ROLE_SQL} IS NULL OR {ROLE_SQL} = 'demo' THEN 'not on the team' WHEN {STATUS_SQL} <> 'active' THEN 'the application is closed'
      WHEN l_linenumber = 2 THEN 'the stage was skipped' WHEN l_linenumber = 3 THEN 'already' ELSE 'new' END AS outcome FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def interviewers_assigned(spark, d):
    li, s = table(spark, d, "lineitem"), F.col("l_suppkey") % 4
    role = F.when(s == 0, "admin").when(s == 1, "interviewer").when(s == 2, "demo")
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")
    status = F.when(F.col("l_linenumber") == 2, "skipped").otherwise("in_progress")
    wanted = li.select(row, F.col("l_suppkey").alias("user_id"), role.alias("role"), F.lit("round").alias("kind"), status.alias("status"), F.col("l_orderkey").alias("id"))
    wanted = wanted.join(applications(spark, d).select("id", F.col("status").alias("application_status")), "id")
    had = li.where("l_linenumber = 3").select(row, F.col("l_suppkey").alias("user_id"))
    return stages.assigned(wanted, had).groupBy("outcome").agg(F.count("*").alias("n"))


@query("feedback_forms", """
    SELECT refused, status, count(*) AS n, count(rating) AS ratings, count(notes) AS notes FROM (
      SELECT refused, CASE WHEN refused IS NULL THEN CASE WHEN l_linenumber % 2 = 0 THEN 'submitted' ELSE 'draft' END WHEN l_suppkey % 7 = 1 THEN 'submitted' END AS status, CASE WHEN refused IS NULL THEN r END AS rating, CASE WHEN refused IS NULL AND l_linenumber <> 2 THEN l_shipmode END AS notes
      FROM (SELECT *, CASE WHEN l_suppkey % 7 = 0 THEN 'only the assigned interviewer can write' WHEN l_suppkey % 7 = 1 THEN 'feedback has been submitted' WHEN l_suppkey % 7 = 2 THEN 'the stage has not started'
               WHEN l_suppkey % 7 = 3 THEN 'choose one of the four recommendations' WHEN r IS NULL AND l_linenumber % 2 = 0 OR r NOT BETWEEN 1 AND 5 THEN 'a rating is from 1 to 5' END AS refused
            FROM (SELECT *, 'x' AS l_shipmode, CASE WHEN l_partkey % 8 < 7 THEN l_partkey % 8 END AS r FROM lineitem))) GROUP BY 1, 2""")
def feedback_forms(spark, d):
    s, n = F.col("l_suppkey") % 7, F.col("l_linenumber")
    li = table(spark, d, "lineitem").withColumn("interview_id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    rating = F.when(F.col("l_partkey") % 8 < 7, (F.col("l_partkey") % 8).cast("int"))
    both = li.select(
        "interview_id", F.lit("u").alias("user_id"), F.when(n % 2 == 0, "submit").otherwise("draft").alias("action"), rating.alias("rating"), F.when(s == 3, "maybe").otherwise("hire").alias("recommendation"),
        F.when(n == 2, " ").otherwise("x").alias("notes"), F.when(s == 0, "v").otherwise("u").alias("interviewer_id"), F.when(s == 1, "submitted").alias("status"), F.when(s == 2, "pending").otherwise("passed").alias("stage_status"),
    )
    forms, interviews = both.select("interview_id", "user_id", "action", "rating", "recommendation", "notes"), both.select("interview_id", "interviewer_id", "stage_status", "status")
    out = stages.feedback_written(forms, interviews, NOW)
    return out.groupBy("refused", "status").agg(F.count("*").alias("n"), F.count("rating").alias("ratings"), F.count("notes").alias("notes"))


@query("feedback_tallies", """
    WITH f AS (SELECT l_orderkey AS id, ['strong_hire', 'hire', 'no_hire', 'strong_no_hire', NULL][1 + l_suppkey % 5] AS r, 1 + l_partkey % 5 AS g FROM lineitem),
         c AS (SELECT id, count(CASE r WHEN 'strong_hire' THEN 1 END) AS a, count(CASE r WHEN 'hire' THEN 1 END) AS b, count(CASE r WHEN 'no_hire' THEN 1 END) AS c, count(CASE r WHEN 'strong_no_hire' THEN 1 END) AS d, min(g) AS lo, max(g) AS hi FROM f GROUP BY 1),
         t AS (SELECT *, concat_ws(', ', CASE WHEN a > 0 THEN a || ' strong hire' END, CASE WHEN b > 0 THEN b || ' hire' END, CASE WHEN c > 0 THEN c || ' no hire' END, CASE WHEN d > 0 THEN d || ' strong no hire' END,
                      CASE WHEN lo = hi THEN 'every rating ' || lo || ' of 5' ELSE 'ratings from ' || lo || ' to ' || hi || ' of 5' END) AS s FROM c)
    SELECT id, upper(s[1]) || s[2:] || '.' AS tally, CASE WHEN a + b > 0 AND c + d > 0 THEN 'The recommendations are split: ' || (a + b) || ' hire or strong hire, ' || (c + d) || ' against.' END AS split FROM t""")
def feedback_tallies(spark, d):
    names = F.array(*map(F.lit, V.RECOMMENDATIONS))
    given = F.get(names, (F.col("l_suppkey") % 5).cast("int"))
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), given.alias("recommendation"), (1 + F.col("l_partkey") % 5).cast("int").alias("rating"))
    return stages.tallies(entries, "id")


@query("score_visibility", "SELECT DISTINCT o_custkey AS candidate_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 5 AND l_linestatus = 'F'")
def score_visibility(spark, d):
    li = table(spark, d, "lineitem")
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = li.select(row.alias("id"), F.col("l_orderkey").alias("application_id"))
    own = F.xxhash64("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("interview_id")
    interviews = li.select(own, row.alias("application_stage_id"), F.col("l_suppkey").cast("string").alias("interviewer_id"))
    feedback = li.select(own, F.when(F.col("l_linestatus") == "F", "submitted").otherwise("draft").alias("status"))
    return stages.score_visible(applications(spark, d), rows, interviews, feedback, "5", "interviewer")


@query("available_actions", f"""
    SELECT id, CASE WHEN status <> 'active' OR id % 4 = 0 THEN '' ELSE 'advance' || CASE WHEN id % 3 > 0 THEN ' skip' ELSE '' END || ' reject' || CASE WHEN id % 4 = 1 THEN ' decline' ELSE '' END || ' withdraw' END AS actions FROM {APPS_SQL}""")
def available_actions(spark, d):
    k = F.col("id")
    at = F.when(k % 4 == 1, "offer").when(k % 4 > 1, "hr_screen")
    return applications(spark, d).select("id", F.array_join(stages.actions(F.col("status"), at, k % 3 > 0), " ").alias("actions"))


# ---------------------------------------------------------------- dates and profiles
WRITTEN_SQL = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%b %Y') WHEN 1 THEN strftime(o_orderdate, '%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN 'Present' WHEN 4 THEN 'some day' ELSE strftime(o_orderdate, '%B %-d, %Y') END"


def written_dates(spark, d):
    """Order dates as people write them."""
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = F.when(k == 0, F.date_format(at, "MMM yyyy")).when(k == 1, F.date_format(at, "MM/yyyy")).when(k == 2, F.date_format(at, "yyyy")).when(k == 3, "Present").when(k == 4, "some day").otherwise(F.date_format(at, "MMMM d, yyyy"))
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"))


@query("date_keys", f"""
    SELECT o_orderkey, {WRITTEN_SQL} AS text, CASE o_orderkey % 6 WHEN 2 THEN strftime(o_orderdate, '%Y-00') WHEN 3 THEN '9999-99' WHEN 4 THEN '0000-00' ELSE strftime(o_orderdate, '%Y-%m') END AS sort_key,
           CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-01') END AS month,
           CASE o_orderkey % 6 WHEN 3 THEN 'Present' WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y') END AS year,
           CASE o_orderkey % 6 WHEN 3 THEN 'Present' WHEN 4 THEN 'some day' ELSE strftime(o_orderdate, '%Y') END AS service FROM orders""")
def date_keys(spark, d):
    c = F.col("text")
    return written_dates(spark, d).select("o_orderkey", "text", D.sort_key(c).alias("sort_key"), D.education_month(c).alias("month"), D.year_of(c).alias("year"), D.service_date(c).alias("service"))


@query("date_ranges", """
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date, CASE WHEN o_orderkey % 2 = 1 THEN CAST(date_trunc('month', o_orderdate + INTERVAL 400 DAY) AS DATE) END AS end_date FROM orders""")
def date_ranges(spark, d):
    at = F.col("o_orderdate")
    end = F.when(F.col("o_orderkey") % 2 == 1, F.date_format(F.date_add(F.to_date(at), 400), "MMM yyyy")).otherwise("Present")
    texts = table(spark, d, "orders").select("o_orderkey", F.concat(F.date_format(at, "MMM yyyy"), F.lit(" - "), end).alias("text"))
    return texts.select("o_orderkey", D.date_range(F.col("text"), F.lit("2001-08-01").cast("date")).alias("r")).select("o_orderkey", "r.*")


@query("latest_positions", """
    WITH e AS (SELECT o_custkey AS candidate_id, o_orderpriority AS title, CASE WHEN o_orderkey % 9 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS e, o_orderkey FROM orders)
    SELECT candidate_id, arg_min(title, (e IS NOT NULL, CASE WHEN e IS NULL THEN 0 ELSE -CAST(replace(e, '-', '') AS BIGINT) END, o_orderkey)) AS latest,
           arg_min(title, (coalesce(e, '9999'), o_orderkey)) AS shown FROM e GROUP BY 1""")
def latest_positions(spark, d):
    end = F.when(F.col("o_orderkey") % 9 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    entry = F.struct("o_orderkey", F.col("o_orderpriority").alias("title"), end.alias("end_date"))
    people = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return people.select("candidate_id", P.latest_experience(F.col("entries"))["title"].alias("latest"), P.shown_experience(F.col("entries"))["title"].alias("shown"))


@query("bullet_ends", r"""
    SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS ended, t <> '' AND (t LIKE '%...' OR length(regexp_extract(t, '(\S+)$', 1)) <= 2) AS looks_cut,
           CASE WHEN text = '' THEN NULL ELSE left(split_part(text, chr(10), 1), 100) || CASE WHEN length(left(split_part(text, chr(10), 1), 100)) < length(text) THEN '...' ELSE '' END END AS headline
    FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def bullet_ends(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", P.ended(c).alias("ended"), P.looks_cut(c).alias("looks_cut"), P.headline(c).alias("headline"))


@query("shared_skills", f"""
    WITH s AS (SELECT candidate_id, list(skill_name ORDER BY skill_name) AS own FROM {SKILLS_SQL} GROUP BY 1), f AS (SELECT own AS asked FROM s ORDER BY candidate_id LIMIT 1)
    SELECT candidate_id, array_to_string(list_sort(list_intersect(asked, own)), ',') AS matching, array_to_string(list_filter(asked, lambda x: NOT list_contains(own, x)), ',') AS missing FROM s, f""")
def shared_skills(spark, d):
    own = skills(spark, d).groupBy("candidate_id").agg(F.array_sort(F.collect_set("skill_name")).alias("own"))
    first = own.orderBy("candidate_id").limit(1).select(F.col("own").alias("asked"))
    both = own.join(F.broadcast(first)).withColumn("s", P.same_skills(F.col("asked"), F.col("own")))
    return both.select("candidate_id", F.array_join("s.matching", ",").alias("matching"), F.array_join("s.missing", ",").alias("missing"))


@query("job_descriptions", """
    SELECT p_partkey, 'Job Title: ' || p_name || CASE WHEN p_partkey % 3 > 0 THEN chr(10) || 'Department: ' || p_brand ELSE '' END || chr(10) || 'Job Type: ' || p_type AS text, regexp_matches(p_name, '(?i)\\b(ai|ml|llm)\\b') AS is_ai FROM part""")
def job_descriptions(spark, d):
    department = F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise("")
    p = table(spark, d, "part")
    return p.select("p_partkey", P.description_text(F.col("p_name"), department, F.lit(None).cast("string"), F.col("p_type"), F.lit("")).alias("text"), P.is_ai_role(F.col("p_name")).alias("is_ai"))


@query("interviewer_numbers", "SELECT l_orderkey, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS number FROM lineitem")
def interviewer_numbers(spark, d):
    return ranking.numbered(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


@query("stages_renumbered", "SELECT l_orderkey AS job_id, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS position FROM lineitem")
def stages_renumbered(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    return transitions.renumbered(rows, F.desc("l_linenumber"))
