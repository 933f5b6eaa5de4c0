"""The operators bound to the star-schema tables, each with its SQL where SQL can express it.

Roles: an application is an order, a candidate a customer, a stage row a line item (return flag =
stage, line status F = passed and O = in progress, order date = start, ship date = end), a job a
nation, a department a region, a skill of a customer or an order a brand, an audit event an event.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.functions import labels as L
from talentgrid.functions import scoring as S
from talentgrid.functions import text as T
from talentgrid.operators import evaluation, governance, matching, ranking, search, transitions, vectors
from talentgrid.operators import reports as R
from talentgrid.plans import bundles
from talentgrid.sources import pages as P
from talentgrid.sources.tables import stable_index, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = datetime(2001, 8, 1)
NOW_SQL = "TIMESTAMP '2001-08-01 00:00:00'"
STATUS = {"F": "hired", "O": "active", "P": "rejected"}
STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'hired' WHEN 'O' THEN 'active' ELSE 'rejected' END"
POSITION_SQL = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- roles
def applications(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("job_id"), F.col("o_custkey").alias("candidate_id"),
        L.lookup(F.col("o_orderstatus"), STATUS).alias("status"), F.col("c_mktsegment").alias("source"), F.col("o_orderdate").alias("applied_at"),
    )


def stage_rows(spark: SparkSession, d: str) -> DataFrame:
    """The spine: line items with their order and customer."""
    li, a = table(spark, d, "lineitem"), applications(spark, d)
    flag = F.col("l_returnflag")
    return li.join(a, F.col("l_orderkey") == F.col("id")).select(
        F.col("l_orderkey").alias("application_id"), "job_id", "candidate_id", F.col("status").alias("application_status"), "source", "applied_at",
        flag.alias("stage_key"), F.concat(F.lit("Round "), flag).alias("stage_name"), F.lit("round").alias("stage_kind"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("position"), F.lit(True).alias("enabled"),
        F.when(F.col("l_linestatus") == "F", "passed").otherwise("in_progress").alias("status"),
        F.col("applied_at").alias("started_at"), F.col("l_shipdate").alias("completed_at"), F.col("l_linenumber").alias("line"),
    )


def skills(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, skill_name): the brands each customer bought."""
    li, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part").select("p_partkey", "p_brand")
    rows = li.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").alias("candidate_id"), F.col("p_brand").alias("skill_name")).distinct()


SKILLS_SQL = "(SELECT DISTINCT o_custkey AS candidate_id, p_brand AS skill_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
APPS_SQL = f"(SELECT o_orderkey AS id, c_nationkey AS job_id, o_custkey AS candidate_id, {STATUS_SQL} AS status, c_mktsegment AS source, o_orderdate AS applied_at FROM orders JOIN customer ON o_custkey = c_custkey)"
DAYS_SQL = "(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0"


# ---------------------------------------------------------------- reports
@query("stage_funnel", f"""
    WITH t AS (SELECT count(DISTINCT l_orderkey) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_returnflag AS stage_key, 'Round ' || l_returnflag AS stage_name, {POSITION_SQL} AS position, count(DISTINCT l_orderkey) AS ever,
           count(DISTINCT CASE WHEN l_linestatus = 'O' AND o_orderstatus = 'O' THEN l_orderkey END) AS here, round(count(DISTINCT l_orderkey) / (SELECT total FROM t), 3) AS share
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def stage_funnel(spark, d):
    return R.funnel(stage_rows(spark, d))


@query("time_in_stage", f"""
    SELECT l_returnflag AS stage_key, {POSITION_SQL} AS position, round(quantile_cont({DAYS_SQL}, 0.5), 2) AS median_days, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' AND l_shipdate > o_orderdate GROUP BY 1, 2""")
def time_in_stage(spark, d):
    return R.time_in_stage(stage_rows(spark, d))


DECIDED_SQL = f"""(SELECT o_orderkey, c_nationkey AS job_id, {STATUS_SQL} AS status, o_orderdate, max(l_shipdate) AS l_shipdate
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""
OUTCOME_COLS = f"""round(quantile_cont(CASE WHEN status = 'hired' THEN {DAYS_SQL} END, 0.5), 2) AS hire_median, count(CASE WHEN status = 'hired' THEN 1 END) AS hires,
    round(quantile_cont(CASE WHEN status = 'rejected' THEN {DAYS_SQL} END, 0.5), 2) AS reject_median, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejects"""
OUTCOME_FROM = f"FROM {DECIDED_SQL} WHERE status IN ('hired', 'rejected') AND l_shipdate > o_orderdate"


def decided(spark, d):
    return stage_rows(spark, d).groupBy("application_id", "job_id", "application_status", "applied_at").agg(F.max("completed_at").alias("outcome_at"))


@query("time_to_outcome", f"SELECT {OUTCOME_COLS} {OUTCOME_FROM}")
def time_to_outcome(spark, d):
    return R.time_to_outcome(decided(spark, d))


@query("time_to_outcome_by_job", f"SELECT job_id, {OUTCOME_COLS} {OUTCOME_FROM} GROUP BY 1")
def time_to_outcome_by_job(spark, d):
    return R.time_to_outcome(decided(spark, d), ("job_id",))


@query("no_movement", f"""
    SELECT o_orderkey AS application_id, l_linenumber AS line, o_orderdate AS started_at, CAST(floor((epoch_us({NOW_SQL}) - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) AS days_waiting
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_linestatus = 'O' AND o_orderdate < {NOW_SQL} - INTERVAL 7 DAY""")
def no_movement(spark, d):
    return R.no_movement(stage_rows(spark, d), NOW).select("application_id", "line", "started_at", "days_waiting")


@query("pending_feedback", f"""
    SELECT o_orderkey AS interview_id, o_orderdate AS started_at, greatest(0, CAST(floor((epoch_us({NOW_SQL}) - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT)) AS days_pending
    FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def pending_feedback(spark, d):
    interviews = table(spark, d, "orders").select(F.col("o_orderkey").alias("interview_id"), F.col("o_orderdate").alias("started_at"))
    feedback = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("interview_id"), F.when(F.col("l_returnflag") == "R", "submitted").otherwise("draft").alias("status"))
    return R.pending_feedback(interviews, feedback, NOW)


@query("source_mix", f"SELECT coalesce(nullif(trim(lower(source)), ''), 'unknown') AS source, count(*) AS applications, count(CASE WHEN status = 'hired' THEN 1 END) AS hired FROM {APPS_SQL} GROUP BY 1")
def source_mix(spark, d):
    return R.source_mix(applications(spark, d))


@query("department_mix", f"""
    SELECT coalesce(nullif(trim(r_name), ''), 'No department') AS department, count(DISTINCT job_id) AS jobs, count(*) AS applications, count(CASE WHEN status = 'hired' THEN 1 END) AS hired
    FROM {APPS_SQL} a JOIN nation ON job_id = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def department_mix(spark, d):
    jobs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("department"))
    return R.department_mix(applications(spark, d), jobs)


@query("outcomes_quarter", f"""
    SELECT label, count(CASE WHEN status = 'hired' THEN 1 END) AS hires, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejects
    FROM {DECIDED_SQL} JOIN (VALUES ('Q3 2001', TIMESTAMP '2001-07-01', TIMESTAMP '2001-10-01'), ('Q2 2001', TIMESTAMP '2001-04-01', TIMESTAMP '2001-07-01')) q(label, a, b)
    ON l_shipdate >= a AND l_shipdate < b GROUP BY 1""")
def outcomes_quarter(spark, d):
    rows = decided(spark, d)
    return R.outcomes_between(rows, *R.quarter(NOW)).unionByName(R.outcomes_between(rows, *R.quarter(NOW, -1)))


@query("activity_feed", """
    WITH done AS (SELECT 0 AS feed, l_shipdate AS "at", l_orderkey AS application_id, 'passed' AS event, l_returnflag AS stage_key, l_orderkey * 10 + l_linenumber AS id
                  FROM lineitem WHERE l_linestatus = 'F' ORDER BY l_shipdate DESC, id DESC LIMIT 20),
         come AS (SELECT 1 AS feed, o_orderdate AS "at", o_orderkey AS application_id, 'applied' AS event, CAST(NULL AS VARCHAR) AS stage_key, o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
    SELECT * FROM (SELECT * FROM done UNION ALL SELECT * FROM come) ORDER BY "at" DESC, feed, id DESC LIMIT 20""")
def activity_feed(spark, d):
    rows = stage_rows(spark, d).where("status = 'passed'").withColumn("row_id", F.col("application_id") * 10 + F.col("line"))
    return R.activity(rows, applications(spark, d))


@query("candidates_at_stage", """
    WITH h AS (SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND o_orderstatus = 'O')
    SELECT l_orderkey AS application_id, (SELECT count(*) FROM h) AS total FROM h ORDER BY o_orderdate, l_orderkey LIMIT 25""")
def candidates_at_stage(spark, d):
    return R.candidates_at_stage(stage_rows(spark, d), ["R"], NOW).select("application_id", "total")


@query("status_counts", f"""SELECT count(CASE WHEN status = 'active' THEN 1 END) AS active, count(CASE WHEN status = 'hired' THEN 1 END) AS hired, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected,
    count(CASE WHEN status = 'declined' THEN 1 END) AS declined, count(CASE WHEN status = 'withdrawn' THEN 1 END) AS withdrawn FROM {APPS_SQL}""")
def status_counts(spark, d):
    return R.status_counts(applications(spark, d))


@query("dashboard_summary", f"""
    SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND o_orderstatus = 'O')
           + count(CASE WHEN status = 'hired' THEN 1 END) AS interviewing_or_later, count(CASE WHEN status = 'hired' THEN 1 END) AS hired, count(*) AS total FROM {APPS_SQL}""")
def dashboard_summary(spark, d):
    rows = stage_rows(spark, d).withColumn("row_id", F.col("application_id"))
    return bundles.dashboard(rows, applications(spark, d), NOW)["summary"]


# ---------------------------------------------------------------- search and listing
@query("candidate_search", f"""
    SELECT c_custkey AS id, c_name AS name FROM customer WHERE (c_name ILIKE '%12%' OR EXISTS (SELECT 1 FROM {SKILLS_SQL} s WHERE s.candidate_id = c_custkey AND s.skill_name ILIKE '%12%'))
    AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND c_nationkey = 7)""")
def candidate_search(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return search.candidates(c, skills(spark, d), applications=applications(spark, d), keyword="12", columns=["name"], job_id=7)


@query("all_tags", "SELECT o_custkey AS candidate_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 3")
def all_tags(spark, d):
    tags = table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("tag"))
    return search.with_all(tags, "candidate_id", "tag", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(spark, d):
    return search.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3, 25)


@query("page_keyset", "SELECT event_id, event_type FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 51")
def page_keyset(spark, d):
    return search.keyset_page(table(spark, d, "events").select("event_id", "event_type"), "event_id", 5000, 50)


@query("skills_breakdown", f"SELECT skill_name, count(*) AS n FROM {SKILLS_SQL} GROUP BY 1")
def skills_breakdown(spark, d):
    return search.skill_counts(skills(spark, d))


@query("skills_joined", f"SELECT candidate_id, string_agg(skill_name, ', ' ORDER BY skill_name) AS skills FROM {SKILLS_SQL} GROUP BY 1")
def skills_joined(spark, d):
    return search.joined_skills(skills(spark, d))


@query("content_dedupe", "SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dedupe(spark, d):
    return search.duplicates(table(spark, d, "documents"), "text", "doc_id")


@query("csv_guard", "SELECT doc_id, CASE WHEN left(text, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || text ELSE text END AS text FROM documents")
def csv_guard(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", L.csv_cell(F.col("text")).alias("text"))


# ---------------------------------------------------------------- ranking
@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark, d):
    return ranking.latest(table(spark, d, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("mode_per_group", "SELECT key, value, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS k FROM (SELECT o_custkey AS key, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE k = 1")
def mode_per_group(spark, d):
    return ranking.most_used(table(spark, d, "orders"), F.col("o_custkey"), "o_orderpriority")


@query("merged_years", """
    WITH s AS (SELECT o_custkey AS candidate_id, CAST(o_orderdate AS DATE) AS s, least(CAST(o_orderdate AS DATE) + 120, DATE '2001-08-01') AS e FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2001-08-01'),
         b AS (SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
         i AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b)
    SELECT candidate_id, round(sum(days) / 365.25, 1) AS years FROM (SELECT candidate_id, island, max(e) - min(s) AS days FROM i GROUP BY 1, 2) GROUP BY 1""")
def merged_years(spark, d):
    day = F.to_date("o_orderdate")
    spans = table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), day.alias("start_date"), F.date_add(day, 120).alias("end_date")).where(F.col("start_date") <= F.lit("2001-08-01").cast("date"))
    return ranking.merged_years(spans, "candidate_id", F.lit("2001-08-01").cast("date"))


@query("trim_history", """
    WITH s AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
    SELECT conv_id, turn, role FROM s WHERE n <= 4 AND c <= 1500""")
def trim_history(spark, d):
    return ranking.trimmed_history(table(spark, d, "conversations"), "conv_id", "turn", "text", 4, 1500).select("conv_id", "turn", "role")


@query("global_rank", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def global_rank(spark, d):
    return ranking.ranked(table(spark, d, "customer"), None, "c_acctbal", "c_custkey").select("c_custkey", "rank")


# ---------------------------------------------------------------- vectors and banding
COS_SQL = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def query_vector(spark, d):
    return vectors.literal(list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]))


@query("vec_topk_cosine", f"""
    SELECT vec_id, round(greatest(0, least(1, c)), 6) AS similarity FROM (SELECT e.vec_id, {COS_SQL} AS c FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) ORDER BY c DESC, vec_id LIMIT 10""")
def vec_topk_cosine(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), query_vector(spark, d), "vec_id", 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vec_floor", f"""
    SELECT vec_id, round(c, 6) AS similarity FROM (SELECT e.vec_id, {COS_SQL} AS c FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) WHERE c >= 0.2 ORDER BY c DESC, vec_id LIMIT 100""")
def vec_floor(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), query_vector(spark, d), "vec_id", 100, floor=0.2).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vec_topk_l2", "SELECT vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), vec_id LIMIT 10")
def vec_topk_l2(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), query_vector(spark, d), "vec_id", 10, metric="l2").select("vec_id", F.round("distance", 6).alias("distance"))


@query("vec_similar", f"""
    SELECT vec_id, round(greatest(0, least(1, c)), 6) AS similarity FROM (SELECT e.vec_id, {COS_SQL} AS c FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id = 6) q WHERE e.vec_id <> q.vec_id) ORDER BY c DESC, vec_id LIMIT 5""")
def vec_similar(spark, d):
    return vectors.similar_to(table(spark, d, "embeddings"), "vec_id", 6, 5).select("vec_id", F.round("similarity", 6).alias("similarity"))


#: A corpus word of each language and a role word; the invented prose has no real skills.
TERMS = ["thonle", "der", "que"]


@query("query_evidence", "SELECT doc_id, " + " + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END" for t in ("der", "que")) + " AS matched FROM documents")
def query_evidence(spark, d):
    # hyphens don't occur inside words of the corpus, so one form of the text decides
    return table(spark, d, "documents").select("doc_id", F.size(T.evidence(F.col("text"), ["der", "que"])).alias("matched"))


@query("banding", """
    SELECT vec_id, CASE WHEN s >= 0.65 THEN 'strong' WHEN s >= 0.45 AND m THEN 'moderate' ELSE 'weak' END AS relevance
    FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS s, label IN (1, 3) AS m FROM embeddings)""")
def banding(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", ((F.col("vec_id") % 100) / 100.0).alias("s"), F.when(F.col("label").isin(1, 3), F.array(F.lit("airline"))).otherwise(F.array().cast("array<string>")).alias("m"))
    return e.select("vec_id", T.band(F.col("s"), F.col("m"), ["airline", "pilots"]).alias("relevance"))


# ---------------------------------------------------------------- scoring
ORDER_SKILLS_SQL = "(SELECT l_orderkey, list(DISTINCT lower(p_brand)) AS wanted FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"
CUSTOMER_SKILLS_SQL = f"(SELECT candidate_id, list(DISTINCT lower(skill_name)) AS have FROM {SKILLS_SQL} GROUP BY 1)"


def order_skills(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("wanted"))


#: The other customer whose brands an order is compared with: the order's key modulo the number of customers.
OTHER_SQL = "l_orderkey % (SELECT count(*) FROM customer)"


def pairs(spark, d):
    """Every order's brands against those of another customer (OTHER_SQL), so that all customers who bought anything take part."""
    have = skills(spark, d).groupBy("candidate_id").agg(F.array_sort(F.collect_set("skill_name")).alias("have"))
    customers = table(spark, d, "customer").agg(F.count("*").alias("customers"))
    other = order_skills(spark, d).join(F.broadcast(customers)).withColumn("candidate_id", F.col("l_orderkey") % F.col("customers"))
    return other.drop("customers").join(have, "candidate_id")


@query("skill_overlap", f"""
    SELECT l_orderkey, exact, round(least(100, (CASE WHEN exact + partial >= 0.8 * total THEN 1.1 ELSE 1.0 END) * (100.0 * exact + 50.0 * partial) / total), 4) AS score FROM (
      SELECT l_orderkey, len(wanted) AS total, len(list_filter(wanted, lambda w: list_contains(have, w))) AS exact,
             len(list_filter(wanted, lambda w: NOT list_contains(have, w) AND len(list_filter(have, lambda h: (contains(h, w) OR contains(w, h)) AND abs(length(h) - length(w)) <= 3)) > 0)) AS partial
      FROM {ORDER_SKILLS_SQL} JOIN {CUSTOMER_SKILLS_SQL} ON candidate_id = {OTHER_SQL})""")
def skill_overlap(spark, d):
    m = pairs(spark, d).withColumn("m", S.skill_match(F.col("wanted"), F.col("have")))
    return m.select("l_orderkey", F.size("m.exact").alias("exact"), F.round("m.score", 4).alias("score"))


@query("skill_jaccard", f"""
    SELECT l_orderkey, round(len(list_intersect(wanted, have)) / len(list_distinct(list_concat(wanted, have))), 4) AS jaccard
    FROM {ORDER_SKILLS_SQL} JOIN {CUSTOMER_SKILLS_SQL} ON candidate_id = {OTHER_SQL}""")
def skill_jaccard(spark, d):
    return pairs(spark, d).select("l_orderkey", F.round(S.jaccard(F.col("wanted"), F.col("have")), 4).alias("jaccard"))


@query("seniority_match", """
    WITH s AS (SELECT p_partkey, ['entry', 'junior', 'mid', 'senior', 'lead', 'principal', 'executive'][1 + p_size % 7] AS jl, p_size % 15 AS jy,
                      ['entry', 'junior', 'mid', 'senior', 'lead', 'principal', 'executive'][1 + p_partkey % 7] AS cl, p_partkey % 11 AS cy, p_partkey % 7 - p_size % 7 AS g, p_partkey % 11 - p_size % 15 AS y FROM part)
    SELECT p_partkey, round(greatest(0, least(100, 0.7 * (CASE WHEN g < -2 THEN 20 WHEN g = -2 THEN 40 WHEN g = -1 THEN 70 WHEN g = 0 THEN 100 WHEN g = 1 THEN 90 WHEN g = 2 THEN 80 ELSE 60 END)
      + 0.3 * (CASE WHEN y < -3 THEN 30 WHEN y < -1 THEN 60 WHEN y <= 1 THEN 100 WHEN y <= 3 THEN 90 WHEN y <= 5 THEN 80 ELSE 70 END)
      + CASE WHEN jl IN ('entry', 'junior') AND cl IN ('senior', 'lead', 'principal') THEN -20 WHEN jl IN ('principal', 'executive') AND cl IN ('entry', 'junior') THEN -25 ELSE 0 END)), 4) AS score FROM s""")
def seniority_match(spark, d):
    from talentgrid.functions.vocabulary import LEVELS

    level = lambda c: F.element_at(F.array(*map(F.lit, LEVELS)), (c % 7 + 1).cast("int"))
    p = table(spark, d, "part")
    job = F.struct(level(F.col("p_size")).alias("level"), (F.col("p_size") % 15).cast("int").alias("years"))
    candidate = F.struct(level(F.col("p_partkey")).alias("level"), (F.col("p_partkey") % 11).cast("int").alias("years"))
    return p.select("p_partkey", F.round(S.experience_match(job, candidate)["score"], 4).alias("score"))


@query("score_tiers", """
    SELECT c_custkey, round((s * w[1] + r * w[2] + x * w[3]) * w[4] * CASE WHEN r < 50 AND s < 60 THEN 0.4 ELSE 1 END, 6) AS score FROM (
      SELECT c_custkey, (c_custkey % 101) * 1.0 AS s, (c_custkey * 7 % 101) * 1.0 AS r, (c_custkey * 13 % 101) * 1.0 AS x,
             CASE WHEN c_custkey * 7 % 101 < 30 THEN [0.15, 0.7, 0.15, 0.25] WHEN c_custkey * 7 % 101 < 50 THEN [0.2, 0.6, 0.2, 0.45] ELSE [0.35, 0.45, 0.2, 1.0] END AS w FROM customer)""")
def score_tiers(spark, d):
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select(k, (k % 101 * 1.0).alias("s"), (k * 7 % 101 * 1.0).alias("r"), (k * 13 % 101 * 1.0).alias("x")).withColumn("t", S.tier(F.col("r")))
    weighted = (F.col("s") * F.col("t.skill") + F.col("r") * F.col("t.role") + F.col("x") * F.col("t.experience")) * F.col("t.multiplier")
    return df.select(k, F.round(weighted * F.when((F.col("r") < 50) & (F.col("s") < 60), 0.4).otherwise(1.0), 6).cast("decimal(18,6)").alias("score"))


#: How many of some wanted brands a customer has, and nearly has: one name holds the other and is three characters longer at most.
EXACT_SQL = "len(list_filter({0}, lambda w: list_contains(have, w)))"
PARTIAL_SQL = "len(list_filter({0}, lambda w: NOT list_contains(have, w) AND len(list_filter(have, lambda h: (contains(h, w) OR contains(w, h)) AND abs(length(h) - length(w)) <= 3)) > 0))"
#: Positions of customers by key modulo 8, with the category, the place of the level among all levels, and its years.
POSITIONS = (
    ("Data Scientist", "data_science", 3, 4), ("Sales Manager", "sales_marketing", 5, 10), ("Senior Software Engineer", "software_engineering", 4, 7), ("UX Designer", "design", 3, 4),
    ("Project Manager", "operations", 5, 10), ("Accountant", "finance", 3, 4), ("Director", "executive", 7, 15), ("", None, 3, 4),
)
JOBS_SQL = """(SELECT l_orderkey AS job_id, n, wanted, CASE n WHEN 1 THEN 'data_science' ELSE 'sales_marketing' END AS kind, CASE n WHEN 1 THEN 4 ELSE 5 END AS level, CASE n WHEN 1 THEN 5 ELSE 10 END AS years
    FROM (SELECT l_orderkey, wanted, row_number() OVER (ORDER BY l_orderkey) AS n FROM (SELECT l_orderkey, list(DISTINCT p_brand ORDER BY p_brand) AS wanted FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)) WHERE n <= 2)"""
PEOPLE_SQL = f"""(SELECT c_custkey AS id, have, kind, level, own_years, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 13)::DOUBLE END AS years, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS degree,
      list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) AS similarity
    FROM customer JOIN (SELECT candidate_id, list(skill_name) AS have FROM {SKILLS_SQL} GROUP BY 1) ON candidate_id = c_custkey LEFT JOIN embeddings e ON vec_id = c_custkey
    JOIN (VALUES {", ".join(f"({k}, {'NULL' if kind is None else chr(39) + kind + chr(39)}, {level}, {years})" for k, (_, kind, level, years) in enumerate(POSITIONS))}) p(k, kind, level, own_years) ON k = c_custkey % 8)"""


def people(spark, d):
    """Customers as candidates, with positions by POSITIONS, recorded years, degrees, and the cosine of their vector with the first."""
    k = F.col("c_custkey")
    have = skills(spark, d).groupBy(F.col("candidate_id").alias("c_custkey")).agg(F.array_sort(F.collect_set("skill_name")).alias("skills"))
    degrees = F.when(k % 4 == 0, F.array(F.lit("B.Sc. Maths"))).when(k % 4 == 1, F.array(F.lit("MBA"), F.lit("GED"))).when(k % 4 == 2, F.array(F.lit("High School Diploma")))
    near = table(spark, d, "embeddings").select(F.col("vec_id").alias("c_custkey"), vectors.cosine(F.col("embedding"), query_vector(spark, d)).alias("similarity"))
    position = F.element_at(F.array(*(F.lit(p[0]) for p in POSITIONS)), (k % 8 + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey").join(have, "c_custkey").join(near, "c_custkey", "left")
    return rows.select(k.alias("id"), position.alias("position"), "skills", F.when(k % 5 != 0, (k % 13).cast("double")).alias("years"), degrees.alias("degrees"), "similarity")


def posts(spark, d):
    """The first two orders as jobs: one with requirements, one without."""
    two = order_skills(spark, d).orderBy("l_orderkey").limit(2)
    first = F.col("l_orderkey") == two.agg(F.min("l_orderkey")).scalar()
    asked = F.to_json(F.struct(F.slice("wanted", 1, 1).alias("must_have_skills"), F.slice("wanted", 2, 1).alias("nice_to_have_skills"), F.lit(3).alias("min_years"), F.lit(8).alias("max_years"), F.lit("bachelor").alias("min_education")))
    return two.select(
        F.col("l_orderkey").alias("job_id"), F.when(first, "Senior Data Engineer").otherwise("Marketing Lead").alias("title"), F.when(first, "5 years of experience").otherwise("").alias("text"),
        "wanted", F.when(first, asked).alias("requirements"),
    )


@query("pair_ranking", f"""
    WITH p AS (SELECT job_id, j.n, wanted, j.kind AS jk, j.level AS jl, j.years AS jy, id, have, c.kind AS ck, c.level AS cl, own_years AS cy, c.years AS y, degree, similarity,
                      len(wanted) AS total, {EXACT_SQL.format("wanted")} AS exact, {PARTIAL_SQL.format("wanted")} AS partial,
                      CASE WHEN j.n = 1 THEN 10.0::DOUBLE * ({EXACT_SQL.format("wanted[2:2]")} + 0.5::DOUBLE * {PARTIAL_SQL.format("wanted[2:2]")}) ELSE 0 END AS bonus,
                      j.n = 1 AND {EXACT_SQL.format("wanted[1:1]")} + {PARTIAL_SQL.format("wanted[1:1]")} = 0 AS lacks FROM {JOBS_SQL} j, {PEOPLE_SQL} c),
         r AS (SELECT *, CASE WHEN ck IS NULL THEN 'missing' WHEN jk = ck THEN 'same_category' WHEN jk = 'data_science' AND ck IN ('sales_marketing', 'design') OR jk = 'sales_marketing' AND ck IN ('data_science', 'software_engineering') THEN 'highly_incompatible'
                              WHEN jk = 'data_science' AND ck IN ('software_engineering', 'operations') THEN 'moderately_incompatible' ELSE 'unrelated' END AS relationship,
                      CASE WHEN n = 1 THEN greatest(coalesce(3 - y, 0), 0) ELSE 0.0::DOUBLE END AS short, CASE WHEN n = 1 THEN greatest(coalesce(y - 8, 0), 0) ELSE 0.0::DOUBLE END AS over,
                      least(100, (100.0::DOUBLE * exact + 50.0::DOUBLE * partial) / total * CASE WHEN exact + partial >= 0.8 * total THEN 1.1::DOUBLE ELSE 1 END) + bonus AS s0 FROM p),
         b AS (SELECT *, CASE WHEN relationship = 'missing' THEN 30.0::DOUBLE ELSE coalesce(similarity * 100, 30.0::DOUBLE) END AS base, least(s0, 100) * CASE WHEN relationship = 'moderately_incompatible' THEN 0.3::DOUBLE ELSE 1 END AS skill,
                      (CASE WHEN cl - jl < -2 THEN 20 WHEN cl - jl = -2 THEN 40 WHEN cl - jl = -1 THEN 70 WHEN cl = jl THEN 100 WHEN cl - jl = 1 THEN 90 WHEN cl - jl = 2 THEN 80 ELSE 60 END) * 0.7::DOUBLE
                      + (CASE WHEN cy - jy < -3 THEN 30 WHEN cy - jy < -1 THEN 60 WHEN cy - jy <= 1 THEN 100 WHEN cy - jy <= 3 THEN 90 WHEN cy - jy <= 5 THEN 80 ELSE 70 END) * 0.3::DOUBLE AS seniority FROM r),
         x AS (SELECT *, greatest(0, least(100, CASE relationship WHEN 'highly_incompatible' THEN least(base * 0.15::DOUBLE, 12) WHEN 'moderately_incompatible' THEN least(base * 0.2::DOUBLE, 20) WHEN 'same_category' THEN least(base * 1.3::DOUBLE, 100) ELSE base END)) AS role,
                      greatest(0, seniority - CASE WHEN short > 0 THEN least(10 * short, 40) ELSE least(5 * over, 20) END) AS experience, CAST(lacks AS INT) + CAST(short >= 2 AS INT) + CAST(n = 1 AND coalesce(degree < 1, false) AS INT) AS gone FROM b),
         w AS (SELECT *, CASE WHEN role < 30 THEN 'severe_role_mismatch' WHEN role < 50 THEN 'moderate_role_mismatch' ELSE 'standard' END AS tier,
                      CASE WHEN role < 30 THEN (skill * 0.15::DOUBLE + role * 0.7::DOUBLE + experience * 0.15::DOUBLE) * 0.25::DOUBLE WHEN role < 50 THEN (skill * 0.2::DOUBLE + role * 0.6::DOUBLE + experience * 0.2::DOUBLE) * 0.45::DOUBLE
                           ELSE skill * 0.35::DOUBLE + role * 0.45::DOUBLE + experience * 0.2::DOUBLE END * CASE WHEN role < 50 AND skill < 60 THEN 0.4::DOUBLE ELSE 1 END AS before FROM x),
         m AS (SELECT *, CASE WHEN gone >= 2 THEN least(before, 50) WHEN gone = 1 THEN least(before, 70) ELSE before END AS match_score FROM w)
    SELECT job_id, id, round(match_score, 4) AS match_score, relationship, tier, gone AS missing, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY match_score DESC, id) AS rank FROM m WHERE match_score >= 1) WHERE rank <= 200""")
def pair_ranking(spark, d):
    """The best customers for two jobs: the whole score of every pair, requirements included."""
    best = matching.best_candidates(posts(spark, d), people(spark, d), 1.0, 200)
    return best.select("job_id", "id", F.round("match_score", 4).alias("match_score"), "relationship", "tier", F.size("reasons").alias("missing"), "rank")


@query("similar_jobs", """
    WITH j AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name), ' ')) AS words, list_distinct([p_brand, p_type]) AS skills, CAST(p_size AS VARCHAR) AS place FROM part),
         o AS (SELECT * FROM j WHERE id = 1)
    SELECT j.id, round(100 * (0.35::DOUBLE * len(list_intersect(o.words, j.words)) / greatest(len(o.words), len(j.words)) + 0.40::DOUBLE * len(list_intersect(o.skills, j.skills)) / len(list_distinct(list_concat(o.skills, j.skills)))
           + 0.10::DOUBLE * CASE WHEN o.place = j.place THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END + 0.15::DOUBLE * 0.3::DOUBLE), 1) AS score FROM j, o WHERE j.id <> o.id ORDER BY score DESC, j.id LIMIT 5""")
def similar_jobs(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array(F.col("p_brand"), F.col("p_type")).alias("skills"), F.col("p_size").cast("string").alias("location"))
    return bundles.similar_jobs(names, 1).select("id", "score")


# ---------------------------------------------------------------- text
@query("pii_scrub", r"""
    SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email removed]', 'g'), '\+1 \(\d{3}\) \d{3}-\d{4}', '[phone removed]', 'g') AS text FROM documents""")
def pii_scrub(spark, d):
    return table(spark, d, "documents").select("doc_id", T.scrubbed(F.col("text")).alias("text"))


@query("clean_text", r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.storable(F.col("text")).alias("text"))


@query("norm_tag", "SELECT p_partkey, rtrim(left(trim(regexp_replace(lower(p_name || 'plus' || replace(p_brand, '#', 'sharp')), '[^a-z0-9]+', '-', 'g'), '-'), 50), '-') AS tag FROM part")
def norm_tag(spark, d):
    return table(spark, d, "part").select("p_partkey", T.tag(F.concat("p_name", F.lit("+"), "p_brand")).alias("tag"))


@query("answer_keys", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9@+]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM documents")
def answer_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.answer_key(F.col("text")).alias("key"))


@query("cache_keys", "SELECT doc_id, 'parse:' || sha256(text) AS key, CAST(('0x' || left(sha256(text), 8)) AS BIGINT) % 1000000 AS short_id FROM documents")
def cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cache_key("parse", F.col("text")).alias("key"), T.short_id(F.col("text")).alias("short_id"))


@query("placeholders", "SELECT c_custkey, replace(replace('Hello {{name}}, about {{job}} {{other}}', '{{name}}', c_name), '{{job}}', c_mktsegment) AS text FROM customer")
def placeholders(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", T.rendered(F.lit("Hello {{name}}, about {{job}} {{other}}"), {"name": F.col("c_name"), "job": F.col("c_mktsegment")}).alias("text"))


@query("page_titles", "SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '') AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", P.title(F.col("html")).alias("title"))


@query("page_chunks")
def page_chunks(spark, d):
    return P.chunks(P.page_texts(table(spark, d, "pages")), "text", "page_id")


@query("document_chunks")
def document_chunks(spark, d):
    return P.chunks(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query("source_labels", "SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) = '' THEN 'Not recorded' ELSE 'Other' END AS label, 'other' AS source FROM customer")
def source_labels(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.source_label(F.col("c_mktsegment")).alias("label"), L.source_key(F.col("c_mktsegment")).alias("source"))


# ---------------------------------------------------------------- transitions
def machine(spark, d):
    """One row for each order and stage, the earliest line deciding: stages before the order's first open line are passed."""
    a = applications(spark, d).select(F.col("id").alias("application_id"), F.col("status").alias("application_status"), F.col("applied_at").alias("started_at"), (F.col("id") % 5).cast("int").alias("at"))
    stages = transitions.default_stages(spark).select(F.col("key").alias("stage_key"), F.col("kind").alias("stage_kind"), "position", F.lit(True).alias("enabled"))
    rows = a.crossJoin(F.broadcast(stages))
    status = F.when(F.col("position") <= F.col("at"), "passed").when((F.col("position") == F.col("at") + 1) & (F.col("application_status") == "active"), "in_progress").otherwise("pending")
    return rows.select("application_id", "application_status", "stage_key", "stage_kind", "position", "enabled", status.alias("status"), "started_at", F.lit(None).cast("timestamp_ntz").alias("completed_at"))


@query("pipeline_advance", f"""
    WITH a AS (SELECT o_orderkey, {STATUS_SQL} AS s, CAST(o_orderkey % 5 AS INT) AS k FROM orders),
         r AS (SELECT o_orderkey, s, k, p, CASE WHEN p <= k THEN 'passed' WHEN p = k + 1 AND s = 'active' THEN 'in_progress' ELSE 'pending' END AS st FROM a, range(1, 13) t(p))
    SELECT CASE WHEN s <> 'active' THEN st WHEN p = k + 1 THEN 'passed' WHEN p = k + 2 THEN 'in_progress' ELSE st END AS new_status, p AS position, count(*) AS n FROM r GROUP BY 1, 2""")
def pipeline_advance(spark, d):
    rows = machine(spark, d)
    commands = applications(spark, d).select(F.col("id").alias("application_id"), F.lit("advance").alias("action"))
    return transitions.applied(rows, commands, NOW).groupBy("new_status", "position").agg(F.count("*").alias("n"))


@query("pipeline_reject", f"""
    WITH a AS (SELECT o_orderkey, {STATUS_SQL} AS s, CAST(o_orderkey % 5 AS INT) AS k FROM orders)
    SELECT CASE WHEN s = 'active' THEN 'rejected' ELSE s END AS new_application_status, CASE WHEN s <> 'active' THEN 'the application is closed' END AS refused, count(*) AS n FROM a GROUP BY 1, 2""")
def pipeline_reject(spark, d):
    commands = applications(spark, d).select(F.col("id").alias("application_id"), F.lit("reject").alias("action"))
    out = transitions.applied(machine(spark, d), commands, NOW).select("application_id", "new_application_status", "refused").distinct()
    return out.groupBy("new_application_status", "refused").agg(F.count("*").alias("n"))


@query("stage_backfill", "SELECT n_nationkey AS job_id, 12 AS stages FROM nation WHERE n_nationkey NOT IN (3, 5)")
def stage_backfill(spark, d):
    jobs = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return transitions.ensured_job_stages(jobs, jobs.where("id in (3, 5)").select(F.col("id").alias("job_id"))).groupBy("job_id").agg(F.count("*").cast("int").alias("stages"))


# ---------------------------------------------------------------- governance and evaluation
ACTIVITY_SQL = "(SELECT c_custkey AS candidate_id, (SELECT max(greatest(o_orderdate, l_shipdate)) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS last_activity FROM customer)"


def activity(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return governance.last_activity(c, [(table(spark, d, "orders"), "o_custkey", ["o_orderdate"]), (li, "o_custkey", ["l_shipdate"])])


@query("last_activity", f"SELECT * FROM {ACTIVITY_SQL}")
def last_activity(spark, d):
    return activity(spark, d)


@query("retention_hold", f"""
    SELECT candidate_id, last_activity, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = candidate_id AND o_orderstatus = 'O') THEN 'open application' WHEN last_activity IS NULL THEN 'no recorded activity' END AS held
    FROM {ACTIVITY_SQL} WHERE last_activity IS NULL OR last_activity < TIMESTAMP '2001-05-01'""")
def retention_hold(spark, d):
    return governance.inactive(activity(spark, d), applications(spark, d), datetime(2001, 5, 1))


@query("erasure_counts", """
    SELECT 'orders' AS "table", count(*) AS erased FROM orders WHERE o_custkey % 50 = 7 UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 7)""")
def erasure_counts(spark, d):
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    gone = table(spark, d, "customer").where("c_custkey % 50 = 7").select(F.col("c_custkey").alias("candidate_id"))
    return governance.erasure({"orders": (o, "o_custkey"), "lines": (li, "o_custkey")}, gone)[1]


@query("visibility", "SELECT DISTINCT o_custkey AS candidate_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 11")
def visibility(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("application_id"))
    interviews = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("application_stage_id"), F.col("l_suppkey").cast("string").alias("interviewer_id"))
    return governance.visible_candidates(applications(spark, d), rows, interviews, "11")


@query("audit_quota", "SELECT user_id AS who, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 4")
def audit_quota(spark, d):
    return governance.over_quota(table(spark, d, "events"), "user_id", "ts", 4)


@query("rule_classify", """SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND event_id % 2 = 0 THEN 'read one' WHEN event_type IN ('click', 'view') THEN 'read list' WHEN event_type = 'purchase' THEN 'write' END AS rule FROM events""")
def rule_classify(spark, d):
    e = table(spark, d, "events")
    method = F.when(F.col("event_type").isin("click", "view"), "GET").when(F.col("event_type") == "purchase", "POST").otherwise("HEAD")
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/api/candidates/"), F.col("event_id").cast("string"))).otherwise("/api/candidates")
    rules = [("GET", "/api/candidates/{id}", "read one"), ("GET", "/api/candidates", "read list"), ("POST", "/api/candidates", "write"), ("POST", "/api/candidates/{id}", "write")]
    return e.select("event_id", governance.classified(method, path, rules).alias("rule"))


@query("bulk_tag", """
    SELECT k AS candidate_id, CASE WHEN c_custkey IS NULL THEN 'not found' WHEN has THEN 'already' WHEN n >= 20 THEN 'limit' ELSE 'ok' END AS outcome
    FROM (SELECT DISTINCT o_custkey + 5 AS k FROM orders) LEFT JOIN customer ON c_custkey = k
    LEFT JOIN (SELECT o_custkey, count(*) AS n, bool_or(o_orderpriority = '1-URGENT') AS has FROM orders GROUP BY 1) t ON t.o_custkey = k""")
def bulk_tag(spark, d):
    o = table(spark, d, "orders")
    tags = o.select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("tag"))
    return governance.bulk_tag(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), tags, o.select((F.col("o_custkey") + 5).alias("candidate_id")), "1-URGENT")


NEAR_SQL = "len(list_filter({0}, lambda x: len(list_filter({1}, lambda y: contains(x, y) OR contains(y, x))) > 0))::DOUBLE"


@query("extraction_f1", f"""
    SELECT l_orderkey, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM (
      SELECT l_orderkey, {NEAR_SQL.format("have", "wanted")} / len(have) AS p, {NEAR_SQL.format("wanted", "have")} / len(wanted) AS r FROM {ORDER_SKILLS_SQL} JOIN {CUSTOMER_SKILLS_SQL} ON candidate_id = {OTHER_SQL})""")
def extraction_f1(spark, d):
    return pairs(spark, d).select("l_orderkey", F.round(evaluation.set_f1(F.col("wanted"), F.col("have")), 4).alias("f1"))


@query("extraction_recall")
def extraction_recall(spark, d):
    return pairs(spark, d).select("l_orderkey", F.round(evaluation.recall(evaluation.keys(F.col("wanted")), evaluation.keys(F.col("have"))), 4).alias("recall"))


@query("stable_buckets", """
    WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
         h AS (SELECT xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c_name, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]))) AS crc FROM customer, t)
    SELECT crc % 10 AS bucket, count(*) AS n FROM h GROUP BY 1""")
def stable_buckets(spark, d):
    return table(spark, d, "customer").groupBy(stable_index(F.col("c_name"), 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("new_applications", f"""
    SELECT job_id, candidate_id, 'active' AS status FROM (SELECT DISTINCT n_nationkey AS job_id, c_custkey AS candidate_id FROM customer JOIN nation ON n_nationkey = (c_nationkey + c_custkey % 2) % 25) w
    WHERE NOT EXISTS (SELECT 1 FROM {APPS_SQL} a WHERE a.job_id = w.job_id AND a.candidate_id = w.candidate_id)""")
def new_applications(spark, d):
    wanted = table(spark, d, "customer").select(((F.col("c_nationkey") + F.col("c_custkey") % 2) % 25).alias("job_id"), F.col("c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("source"))
    return transitions.added_applications(wanted, applications(spark, d)).select("job_id", "candidate_id", "status")


@query("resume_parse")
def resume_parse(spark, d):
    from talentgrid.functions import resume

    return table(spark, d, "documents").select("doc_id", resume.parsed(F.col("text")).alias("p")).select("doc_id", "p.email", "p.phone", F.size("p.skills").alias("n_skills"))


@query("name_casing", "SELECT c_custkey, 'Customer#' || right(c_name, 9) AS name FROM customer")
def name_casing(spark, d):
    from talentgrid.functions import resume

    return table(spark, d, "customer").select("c_custkey", resume.cased_name(F.col("c_name")).alias("name"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("conversation_threads", """
    SELECT CAST(conv_id AS VARCHAR) AS thread, arg_min(text, turn) AS subject, max(turn) AS last_at, count(*) AS messages FROM conversations GROUP BY 1""")
def conversation_threads(spark, d):
    mails = table(spark, d, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("thread_id"), F.col("text").alias("subject"), F.col("role").alias("sender"), F.col("turn").alias("at"), F.lit(True).alias("is_read"))
    return ranking.threads(mails).select("thread", "subject", "last_at", "messages")


@query("board", """
    SELECT job_id, stage_key, min(position) AS position, count(CASE WHEN here THEN 1 END) AS n FROM (
      SELECT c_nationkey AS job_id, l_returnflag AS stage_key, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS position, l_linestatus = 'O' AND o_orderstatus = 'O' AS here
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2""")
def board(spark, d):
    return R.board(stage_rows(spark, d)).select("job_id", "stage_key", "position", "n")


@query("expired_cache", "SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) <= 604800 * 1000000::BIGINT")
def expired_cache(spark, d):
    return governance.unexpired(table(spark, d, "events"), "ts", 604_800, datetime(2024, 1, 31)).select("event_id")


@query("candidate_export", "SELECT vec_id, label FROM embeddings")
def candidate_export(spark, d):
    return governance.exportable(table(spark, d, "embeddings"))


@query("upsert", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return governance.merged(c, c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment")), "c_custkey")


@query("skill_penalties", """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 24.0 ELSE 80.0 END AS score FROM part""")
def skill_penalties(spark, d):
    p = table(spark, d, "part")
    own = F.when(F.col("p_size") % 2 == 0, "software_engineering").otherwise("data_science")
    return p.select("p_partkey", F.round(S.skill_penalty(F.lit(80.0), F.lit("data_science"), own), 4).alias("score"))


from talentgrid import bindings_answers, bindings_feeds, bindings_hiring, bindings_listing, bindings_market, bindings_people, bindings_rows, bindings_text  # noqa: E402, F401  register further queries
