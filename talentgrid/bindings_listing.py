"""Labels, views and lists bound to the star schema, with their SQL.

A line item is a stage row: its line number gives its status, its supplier the interviewer, its quantity a score.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.bindings import POSITION_SQL, STATUS_SQL, applications, query
from talentgrid.functions import labels as L
from talentgrid.functions import profiles as P
from talentgrid.functions import text as T
from talentgrid.operators import listing, reports, search, stages, transitions
from talentgrid.sources.tables import kind_of, spread, table

STATES = {1: "passed", 2: "in_progress", 3: "pending", 4: "failed"}
STATES_SQL = "CASE l_linenumber WHEN 1 THEN 'passed' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'pending' WHEN 4 THEN 'failed' ELSE 'skipped' END"


def rows(spark, d):
    """Stage rows with a status by line number; stage R is an outcome, every other supplier's rows are of a switched-off stage.
    What a row's columns say is spelled out behind the join, so that it sorts and moves lean rows; tasks take equal shares."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    status = F.when(n == 1, "passed").when(n == 2, "in_progress").when(n == 3, "pending").when(n == 4, "failed").otherwise("skipped")
    a = applications(spark, d).select(F.col("id").alias("application_id"), F.col("status").alias("application_status"), "candidate_id")
    li = spread(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "application_id"), "application_id")
    return li.join(a, "application_id").select(
        "application_id", flag.alias("stage_key"), F.when(flag == "R", "outcome").otherwise("round").alias("stage_kind"), status.alias("status"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("position"), (F.col("l_suppkey") % 2 == 0).alias("enabled"), F.col("l_suppkey").alias("interviewer_id"),
        "l_quantity", "l_linenumber", "l_shipdate", "l_partkey", "application_status", "candidate_id",
    )


ROWS_SQL = f"""(SELECT l_orderkey AS application_id, l_returnflag AS stage_key, CASE WHEN l_returnflag = 'R' THEN 'outcome' ELSE 'round' END AS stage_kind, {STATES_SQL} AS status, {POSITION_SQL} AS position,
    l_suppkey % 2 = 0 AS enabled, l_suppkey AS interviewer_id, {STATUS_SQL} AS application_status, o_custkey AS candidate_id, l_quantity, l_linenumber, l_shipdate, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("public_views", f"""
    SELECT application_id, stage_key, position, CASE status WHEN 'pending' THEN 'upcoming' WHEN 'in_progress' THEN 'current' ELSE 'done' END AS state FROM {ROWS_SQL}
    WHERE status <> 'skipped' AND (stage_kind <> 'outcome' OR status = 'passed') AND (status <> 'pending' OR enabled)""")
def public_views(spark, d):
    return transitions.public_view(rows(spark, d))


@query("rows_left_behind", f"""
    SELECT application_id, new_status, count(*) AS n, count(*) FILTER (WHERE moved) AS notes FROM (SELECT *, CASE WHEN moved THEN 'skipped' ELSE status END AS new_status FROM (
      SELECT *, coalesce(application_status = 'active' AND status = 'pending' AND stage_kind = 'round' AND position < min(CASE WHEN status = 'in_progress' THEN position END) OVER (PARTITION BY application_id), false) AS moved FROM {ROWS_SQL})) GROUP BY 1, 2""")
def rows_left_behind(spark, d):
    """An application's rows are counted for all states at once, so a task holds one small row for each application."""
    found = transitions.left_behind(rows(spark, d))
    states = (*STATES.values(), "skipped")
    counts = [reports.counted(F.col("new_status") == s).alias(s) for s in states]
    noted = [reports.counted(F.col("note").isNotNull()).alias("notes")]  # only rows that become skipped have one
    by = found.groupBy("application_id").agg(*counts, *noted)
    each = F.array(*(F.struct(F.lit(s).alias("new_status"), F.col(s).alias("n"), (F.col("notes") if s == "skipped" else F.lit(0).cast("long")).alias("notes")) for s in states))
    return by.select("application_id", F.inline(each)).where("n > 0")


KEYS = ("resume_submitted", "hm_review", "offer", "custom_panel")


@query("candidate_statuses", f"""
    SELECT o_orderkey AS id, CASE {STATUS_SQL} WHEN 'hired' THEN 'hired' WHEN 'rejected' THEN 'rejected' ELSE ['active', 'screening', 'offered', 'interviewing'][1 + o_custkey % 4] END AS status FROM orders""")
def candidate_statuses(spark, d):
    key = F.get(F.array(*map(F.lit, KEYS)), (F.col("candidate_id") % 4).cast("int"))
    return applications(spark, d).select("id", transitions.candidate_status(F.col("status"), key).alias("status"))


@query("custom_stages", """
    SELECT n_nationkey AS job_id, key, name, place AS position FROM nation, (VALUES ('a', 'First', 1, 0), ('custom_panel_talk', 'Earlier', 3, 1), ('custom_panel_talk_2', 'Panel talk', 2, 1), ('b', 'Last', 4, 1), ('b', 'Last', 3, 2),
      ('custom_panel_talk', 'Panel talk', 2, 2)) s(key, name, place, which) WHERE which = 0 OR which = CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END""")
def custom_stages(spark, d):
    """A custom round after the first stage of every job; jobs of one region have one of that name already."""
    known = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(p).alias("position")) for k, n, p in (("a", "First", 1), ("custom_panel_talk", "Earlier", 2), ("b", "Last", 3))])
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("job_id"), "n_regionkey", F.explode(known).alias("s")).where("s.key not like 'custom%' or n_regionkey = 1")
    s = s.select("job_id", "s.key", "s.name", F.lit("round").alias("kind"), "s.position", F.lit(True).alias("enabled"))
    return transitions.with_custom_stage(s, "Panel talk", "a").select("job_id", "key", "name", F.col("position").cast("int").alias("position"))


@query("row_labels", f"""
    SELECT stage_key, CASE WHEN l_linenumber > 5 THEN 'submitted' WHEN status IN ('in_progress', 'passed', 'failed') THEN 'waiting' WHEN status = 'skipped' THEN 'skipped' ELSE 'upcoming' END AS state,
           CASE WHEN l_quantity IS NULL THEN 'none' WHEN 2 * l_quantity >= 70 THEN 'strong' WHEN 2 * l_quantity >= 50 THEN 'moderate' ELSE 'weak' END AS tone, count(*) AS n FROM {ROWS_SQL} GROUP BY 1, 2, 3""")
def row_labels(spark, d):
    state = L.interview_state(F.col("l_linenumber") > 5, F.col("status"))
    return rows(spark, d).groupBy("stage_key", state.alias("state"), L.fit_tone(2 * F.col("l_quantity")).alias("tone")).agg(F.count("*").alias("n"))


@query("part_labels", """
    SELECT p_partkey, CASE WHEN p_size % 4 = 3 AND lo > 0 THEN '$' || format('{:,}', lo) || ' - $' || format('{:,}', hi) WHEN p_size % 4 = 1 AND lo > 0 THEN 'From $' || format('{:,}', lo) WHEN p_size % 4 >= 2 THEN 'Up to $' || format('{:,}', hi) ELSE 'Not disclosed' END AS salary,
           upper(p_type[1]) || lower(p_type[2:]) || ' Job' AS kind, 'duplicate:' || md5(p_name) || ':' || p_size AS key, CASE p_size % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' END AS file, false AS uuid
    FROM (SELECT *, p_size * 1000 AS lo, p_size * 2000 + 7 AS hi FROM part)""")
def part_labels(spark, d):
    n = F.col("p_size")
    low, high = F.when(n % 2 == 1, n * 1000), F.when(n % 4 >= 2, n * 2000 + 7).otherwise(0)
    path = F.concat(F.lit("cv."), F.col("p_name"), F.when(n % 3 == 0, ".PDF").when(n % 3 == 1, ".docx").otherwise(".html"))
    return table(spark, d, "part").select(
        "p_partkey", L.salary_text(low, high).alias("salary"), L.humanized(F.concat("p_type", F.lit("_-job"))).alias("kind"), P.duplicate_key(F.md5("p_name"), n).alias("key"), kind_of(path).alias("file"),
        T.is_uuid(F.col("p_brand")).alias("uuid"),
    )


@query("notes_listed", """
    SELECT l_orderkey AS application_id, l_linenumber AS id, l_shipdate AS created_at, CASE WHEN s_suppkey IS NULL THEN 'Former team member' WHEN s_suppkey % 3 = 0 THEN 'Hiring Team' ELSE s_name END AS author, n_name AS title
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey <> 3) ON l_suppkey = s_suppkey LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""")
def notes_listed(spark, d):
    notes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("application_id"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").alias("created_at"), F.col("l_suppkey").alias("author_id"))
    team = table(spark, d, "supplier").where("s_nationkey <> 3")
    users = team.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("name"), F.lit("hiring_team").alias("role"))
    jobs = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    return listing.notes_of(notes, users, applications(spark, d), jobs).select("application_id", "id", "created_at", "author", "title")


@query("feedback_readable", f"""
    SELECT application_id, l_linenumber, interviewer_id FROM {ROWS_SQL} WHERE interviewer_id = 5 OR candidate_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def feedback_readable(spark, d):
    visible = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("candidate_id"))
    return stages.feedback_visible(rows(spark, d), visible, 5).select("application_id", "l_linenumber", "interviewer_id")


@query("interviews_waiting", f"SELECT application_id, l_linenumber AS id, 'Customer ' || candidate_id AS candidate_name FROM {ROWS_SQL} WHERE status IN ('in_progress', 'passed', 'failed')")
def interviews_waiting(spark, d):
    found = rows(spark, d).select("application_id", F.col("l_linenumber").alias("id"), F.concat(F.lit("Customer "), "candidate_id").alias("candidate_name"), L.interview_state(F.lit(False), F.col("status")).alias("state"))
    return listing.interviews_listed(found, "pending").drop("state")


@query("rows_in_scope", f"""
    SELECT stage_key, count(*) AS n FROM {ROWS_SQL} r JOIN customer ON candidate_id = c_custkey WHERE c_nationkey = 4 AND candidate_id IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey < 30) GROUP BY 1""")
def rows_in_scope(spark, d):
    seen = rows(spark, d).where("interviewer_id < 30").select("candidate_id")
    own = rows(spark, d).join(applications(spark, d).select(F.col("id").alias("application_id"), "job_id"), "application_id")
    return reports.scoped(own, 4, seen).groupBy("stage_key").agg(F.count("*").alias("n"))


@query("jobs_found", """
    SELECT p_partkey AS id, p_name AS title FROM part WHERE lower(p_name) LIKE '%red gear%' ORDER BY lower(p_name) = 'red gear' DESC, p_size > 20 DESC, p_partkey LIMIT 25""")
def jobs_found(spark, d):
    jobs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 20, "open").otherwise("closed").alias("status"))
    return search.find_job(jobs, " Red Gear ").select("id", "title")


@query("rows_exported", "SELECT s_suppkey::VARCHAR AS s_suppkey, CASE WHEN s_acctbal < 0 THEN '''' ELSE '' END || s_acctbal::VARCHAR AS s_acctbal, s_name FROM supplier")
def rows_exported(spark, d):
    return search.export_rows(table(spark, d, "supplier"), ["s_suppkey", "s_acctbal", "s_name"])
