"""Provider feeds, rows that stages lack, default interviewers, texts for embedding and education, bound to the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.bindings import NOW, POSITION_SQL, STATUS_SQL, applications, query
from talentgrid.bindings_hiring import ROLE_SQL
from talentgrid.functions import education
from talentgrid.functions import profiles as P
from talentgrid.functions import resume
from talentgrid.functions import text as T
from talentgrid.operators import stages, transitions, vectors
from talentgrid.sources.tables import all_providers, table


@query("provider_feeds", """
    SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS location, p_brand AS department, CASE WHEN p_size % 2 = 0 THEN p_name || '!' ELSE '' END AS description,
      CASE WHEN p_size % 3 = 0 AND p_size % 4 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN p_size % 3 = 0 THEN 'greenhouse' ELSE 'lever' END AS provider FROM part""")
def provider_feeds(spark, d):
    p = table(spark, d, "part").withColumn("about", F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("!"))))
    own = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.struct(F.col("p_type").alias("name")).alias("location"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("departments"), F.col("about").alias("content"), F.when(F.col("p_size") % 4 == 0, "closed").alias("status"))
    other = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.struct(F.col("p_type").alias("location"), F.col("p_brand").alias("team")).alias("categories"), F.col("about").alias("description"))
    return all_providers({"greenhouse": p.where("p_size % 3 = 0").select(F.to_json(own).alias("value")), "lever": p.where("p_size % 3 > 0").select(F.to_json(other).alias("value"))})


@query("rows_ensured", f"""
    WITH a AS (SELECT o_orderkey AS id, c_nationkey AS job, {STATUS_SQL} AS over, o_orderdate AS since FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT n_nationkey * 10 + p AS stage, n_nationkey AS job, p, p < 3 AND (p <> 1 OR n_nationkey % 2 = 0) AS opens FROM nation, (VALUES (1), (2), (3)) v(p)),
    r AS (SELECT l_orderkey AS id, c_nationkey * 10 + {POSITION_SQL} AS stage, max(l_linestatus) = 'F' AS began FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_suppkey % 2 = 0 GROUP BY 1, 2),
    h AS (SELECT id, bool_or(began) AS began FROM r GROUP BY 1),
    m AS (SELECT a.id, a.over, a.since, s.stage, s.opens, s.p, h.id IS NOT NULL AS had, coalesce(h.began, false) AS began FROM a JOIN s USING (job) LEFT JOIN h USING (id) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = a.id AND r.stage = s.stage)),
    f AS (SELECT *, coalesce(opens AND p = min(CASE WHEN opens THEN p END) OVER (PARTITION BY id) AND NOT began AND over = 'active', false) AS starts FROM m)
    SELECT id AS application_id, stage AS stage_id, CASE WHEN over <> 'active' AND had THEN 'skipped' WHEN starts THEN 'in_progress' ELSE 'pending' END AS status, CASE WHEN starts THEN since END AS started_at FROM f""")
def rows_ensured(spark, d):
    p = F.col("p")
    layout = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("p"))
    layout = layout.select((F.col("n_nationkey") * 10 + p).alias("id"), F.col("n_nationkey").alias("job_id"), F.when(p == 3, "outcome").otherwise("round").alias("kind"), p.alias("position"), ((p != 1) | (F.col("n_nationkey") % 2 == 0)).alias("enabled"))
    a = applications(spark, d)
    place = F.expr(POSITION_SQL)
    rows = table(spark, d, "lineitem").where("l_suppkey % 2 = 0").join(a.select(F.col("id").alias("l_orderkey"), "job_id"), "l_orderkey")
    rows = rows.groupBy(F.col("l_orderkey").alias("application_id"), (F.col("job_id") * 10 + place).alias("stage_id")).agg(F.when(F.max("l_linestatus") == "F", "passed").otherwise("pending").alias("status"))
    return transitions.ensured_rows(a, layout, rows, NOW)


@query("interviewers_default", f"""
    SELECT outcome, count(*) AS n FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey, CASE WHEN {STATUS_SQL} <> 'active' THEN 'the application is closed' WHEN l_linenumber = 2 THEN 'the stage was skipped' WHEN l_linenumber = 3 THEN 'already' ELSE 'new' END AS outcome
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE coalesce({ROLE_SQL}, 'demo') <> 'demo') GROUP BY 1""")
def interviewers_default(spark, d):
    li, s = table(spark, d, "lineitem"), F.col("s_suppkey") % 4
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")
    entered = li.select(row, F.col("l_suppkey").alias("stage_id"), F.lit("round").alias("kind"), F.when(F.col("l_linenumber") == 2, "skipped").otherwise("in_progress").alias("status"), F.col("l_orderkey").alias("id"))
    entered = entered.join(applications(spark, d).select("id", F.col("status").alias("application_status")), "id").drop("id")
    defaults = table(spark, d, "supplier").select(F.col("s_suppkey").alias("stage_id"), F.col("s_suppkey").alias("user_id"), F.when(s == 0, "admin").when(s == 1, "interviewer").when(s == 2, "demo").alias("role"))
    had = li.where("l_linenumber = 3").select(row, F.col("l_suppkey").alias("user_id"))
    return stages.default_interviewers(entered, defaults, had).groupBy("outcome").agg(F.count("*").alias("n"))


@query("texts_embedded", """
    SELECT c_custkey AS id, concat_ws(' | ', c_name, CASE WHEN c_nationkey % 2 = 0 THEN n_name END, c_mktsegment) AS embedded, concat_ws(' ', c_name, CASE WHEN c_nationkey % 2 = 0 THEN n_name END, c_mktsegment, c_mktsegment || ' ' || n_name) AS profile
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def texts_embedded(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    even = F.col("c_nationkey") % 2 == 0
    own = vectors.embedding_text(F.col("c_name"), F.when(even, F.col("n_name")).otherwise("  "), F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")), F.lit(None).cast("string"))
    return c.select(F.col("c_custkey").alias("id"), own.alias("embedded"), P.profile_text(F.col("c_name"), F.when(even, F.col("n_name")), F.col("c_mktsegment"), F.array("c_mktsegment", "n_name")).alias("profile"))


@query("skill_keys", r"""
    SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_type || ', C++ / ' || p_name || ' (' || p_brand || ')'), '[^a-z0-9+#.\-_/ ]', ' ', 'g'), '\s+', ' ', 'g')) AS skill FROM part""")
def skill_keys(spark, d):
    raw = F.concat("p_type", F.lit(", C++ / "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.skill_key(raw).alias("skill"))


@query("months_named", "SELECT strftime(o_orderdate, '%b %Y') AS month, count(*) AS n FROM orders GROUP BY 1")
def months_named(spark, d):
    return table(spark, d, "orders").groupBy(P.standard_month(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))


@query("json_found", """
    SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE '{"kind": "' || event_type || '", "id": [' || event_id || ']}' END AS found FROM events""")
def json_found(spark, d):
    """Objects in answers: fenced, with a trailing comma, or cut off."""
    kind, own = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "id": [')), F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here {it} is:\n```json\n"), kind, own, F.lit("]}\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("{} "), kind, own, F.lit(",]} {"))).otherwise(F.concat(kind, own))
    return table(spark, d, "events").select("event_id", resume.json_objects(text).alias("found"))


@query("education_entries", """
    SELECT c_custkey AS id, 0 AS place, c_mktsegment || ' College' AS institution, CASE WHEN c_custkey % 2 = 0 THEN 'MBA' ELSE 'Ph.D' END AS degree FROM customer WHERE c_custkey % 3 > 0
    UNION ALL SELECT c_custkey, 0, 'MIT', 'PhD' FROM customer WHERE c_custkey % 3 = 0""")
def education_entries(spark, d):
    """Resumes made from customers: degree and school on one line, on two, or without a heading; schools of other sections don't count."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = F.concat("c_mktsegment", F.lit(" College - "), "r_name")
    own = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("MBA, "), at)).otherwise(F.concat(at, F.lit("\nPh.D. 1999")))
    body = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("Cook at Old School\nEducation:\n"), own, F.lit("\n"), own, F.lit("\nSKILLS & MORE\n"))).otherwise(F.lit("Cook at Old School\n\n"))
    found = c.select(F.col("c_custkey").alias("id"), F.posexplode(education.entries(F.concat(body, F.lit("MIT PhD")))))
    return found.select("id", F.col("pos").alias("place"), "col.institution", "col.degree")
