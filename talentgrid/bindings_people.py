"""Exports, lookups and checks of people and jobs bound to the star schema, with their SQL.

A person is a customer, an application an order, a stage row a line item, a resume a vector or a document; staff are suppliers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.bindings import SKILLS_SQL, STATUS, STATUS_SQL, query, skills
from talentgrid.functions import labels as L
from talentgrid.operators import exports, lookup
from talentgrid.sources.tables import table


# ---------------------------------------------------------------- exports
def sections(spark, d):
    c, o, li, e = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "embeddings"))
    people = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("source"), (F.col("c_acctbal") > 0).alias("open_to_offers"), F.col("c_name").cast("binary").alias("photo"))
    resumes = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("candidate_id"), F.col("label").alias("version"), F.concat(F.lit("/store/"), "vec_id").alias("file_path"), "embedding")
    applied = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("candidate_id"), (F.col("o_custkey") % 30).alias("job_id"), L.lookup(F.col("o_orderstatus"), STATUS).alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("applied_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("public_token"),
    )
    staff = F.when(F.col("l_linenumber") != 4, F.col("l_suppkey") % 120)
    stages = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("application_id"), (F.col("l_partkey") % 7).alias("stage_id"), staff.alias("interviewer_id"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("outcome_note"))
    return [
        exports.Section("candidates", "Profile", people),
        exports.Section("resumes", "Resumes", resumes, hidden={"file_path": "server storage location"}),
        exports.Section("job_applications", "Applications", applied, hidden={"public_token": "status-page link credential"}),
        exports.Section("application_stages", "Pipeline stage history", stages, "application_id", "job_applications"),
    ]


def names(spark, d):
    named = lambda t, key, name: table(spark, d, t).select(F.col(key).alias("id"), F.col(name).alias("name"))
    return {"jobs": named("nation", "n_nationkey", "n_name"), "stages": named("region", "r_regionkey", "r_name"), "staff": named("supplier", "s_suppkey", "s_name")}


PEOPLE_SQL = "(SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS source, c_acctbal > 0 AS open_to_offers FROM customer)"
RESUMES_SQL = "(SELECT vec_id AS id, vec_id AS candidate_id, label AS version, embedding FROM embeddings JOIN customer ON vec_id = c_custkey)"
APPLIED_SQL = f"""(SELECT o_orderkey AS id, o_custkey AS candidate_id, o_custkey % 30 AS job_id, {STATUS_SQL} AS status, strftime(o_orderdate, '%Y-%m-%d') AS applied_at,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS public_token FROM orders JOIN customer ON o_custkey = c_custkey)"""
STAGES_SQL = f"""(SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS application_id, l_partkey % 7 AS stage_id, CASE WHEN l_linenumber <> 4 THEN l_suppkey % 120 END AS interviewer_id,
    CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS outcome_note, a.candidate_id AS owner, a.id AS application FROM lineitem JOIN {APPLIED_SQL} a ON l_orderkey = a.id)"""


@query("subject_records", f"""
    SELECT id AS candidate_id, 0 AS place, 'candidates' AS section, 'Profile' AS label, id, CAST(to_json({{'id': id, 'full_name': full_name, 'source': source, 'open_to_offers': open_to_offers}}) AS VARCHAR) AS body FROM {PEOPLE_SQL}
    UNION ALL SELECT candidate_id, 1, 'resumes', 'Resumes', id, CAST(to_json({{'id': id, 'candidate_id': candidate_id, 'version': version}}) AS VARCHAR) FROM {RESUMES_SQL}
    UNION ALL SELECT candidate_id, 2, 'job_applications', 'Applications', id, CAST(to_json({{'id': id, 'candidate_id': candidate_id, 'job_id': job_id, 'status': status, 'applied_at': applied_at}}) AS VARCHAR) FROM {APPLIED_SQL}
    UNION ALL SELECT owner, 3, 'application_stages', 'Pipeline stage history', id,
      CAST(to_json({{'id': id, 'application_id': application_id, 'stage_id': stage_id, 'interviewer_id': interviewer_id, 'outcome_note': outcome_note}}) AS VARCHAR) FROM {STAGES_SQL}""")
def subject_records(spark, d):
    return exports.records(sections(spark, d))


@query("subject_omissions", f"""
    SELECT id AS candidate_id, 'candidates' AS section, 'photo' AS "column", 'binary data' AS reason, 1 AS held FROM {PEOPLE_SQL}
    UNION ALL SELECT candidate_id, 'resumes', 'embedding', 'search vector derived from the profile', count(embedding) FROM {RESUMES_SQL} GROUP BY 1
    UNION ALL SELECT candidate_id, 'resumes', 'file_path', 'server storage location', count(*) FROM {RESUMES_SQL} GROUP BY 1
    UNION ALL SELECT candidate_id, 'job_applications', 'public_token', 'status-page link credential', count(public_token) FROM {APPLIED_SQL} GROUP BY 1""")
def subject_omissions(spark, d):
    return exports.omissions(sections(spark, d))


@query("subject_references", f"""
    SELECT DISTINCT candidate_id, 'jobs' AS kind, CAST(job_id AS VARCHAR) AS id, n_name AS name FROM {APPLIED_SQL} JOIN nation ON job_id = n_nationkey
    UNION ALL SELECT DISTINCT owner, 'stages', CAST(stage_id AS VARCHAR), r_name FROM {STAGES_SQL} JOIN region ON stage_id = r_regionkey
    UNION ALL SELECT DISTINCT owner, 'staff', CAST(interviewer_id AS VARCHAR), s_name FROM {STAGES_SQL} JOIN supplier ON interviewer_id = s_suppkey""")
def subject_references(spark, d):
    return exports.references(sections(spark, d), names(spark, d))


@query("subject_lines", f"""
    WITH p AS {PEOPLE_SQL}, r AS {RESUMES_SQL}, a AS {APPLIED_SQL}, s AS {STAGES_SQL},
    f AS (
      SELECT id AS candidate_id, 0 AS place, 'Profile' AS section, CAST(id AS VARCHAR) AS id, unnest([
        {{'position': 1, 'label': 'Record id', 'value': CAST(id AS VARCHAR)}}, {{'position': 2, 'label': 'Full name', 'value': full_name}}, {{'position': 3, 'label': 'Source', 'value': source}},
        {{'position': 4, 'label': 'Open to offers', 'value': CASE WHEN open_to_offers THEN 'yes' WHEN NOT open_to_offers THEN 'no' END}}]) AS x FROM p
      UNION ALL SELECT candidate_id, 1, 'Resumes', CAST(id AS VARCHAR), unnest([{{'position': 1, 'label': 'Record id', 'value': CAST(id AS VARCHAR)}}, {{'position': 3, 'label': 'Version', 'value': CAST(version AS VARCHAR)}}]) FROM r
      UNION ALL SELECT candidate_id, 2, 'Applications', CAST(id AS VARCHAR), unnest([{{'position': 1, 'label': 'Record id', 'value': CAST(id AS VARCHAR)}}, {{'position': 3, 'label': 'Job', 'value': coalesce(n_name, 'Job') || ' (#' || job_id || ')'}},
        {{'position': 4, 'label': 'Status', 'value': status}}, {{'position': 5, 'label': 'Applied at', 'value': applied_at}}]) FROM a LEFT JOIN nation ON job_id = n_nationkey
      UNION ALL SELECT owner, 3, 'Pipeline stage history', CAST(id AS VARCHAR), unnest([{{'position': 1, 'label': 'Record id', 'value': CAST(id AS VARCHAR)}}, {{'position': 2, 'label': 'Application id', 'value': CAST(application_id AS VARCHAR)}},
        {{'position': 3, 'label': 'Stage', 'value': coalesce(r_name, '#' || stage_id)}}, {{'position': 4, 'label': 'Interviewer', 'value': CASE WHEN interviewer_id IS NOT NULL THEN coalesce(s_name, 'a former staff account') END}},
        {{'position': 5, 'label': 'Outcome note', 'value': outcome_note}}]) FROM s LEFT JOIN region ON stage_id = r_regionkey LEFT JOIN supplier ON interviewer_id = s_suppkey)
    SELECT candidate_id, place, section, id, x.position AS position, x.label || ': ' || x.value AS line FROM f WHERE x.value <> ''
    UNION ALL SELECT id, 1, 'Resumes', NULL, 0, 'None held.' FROM p WHERE id NOT IN (SELECT candidate_id FROM r)
    UNION ALL SELECT id, 2, 'Applications', NULL, 0, 'None held.' FROM p WHERE id NOT IN (SELECT candidate_id FROM a)
    UNION ALL SELECT id, 3, 'Pipeline stage history', NULL, 0, 'None held.' FROM p WHERE id NOT IN (SELECT owner FROM s)""")
def subject_lines(spark, d):
    return exports.lines(sections(spark, d), names(spark, d))


# ---------------------------------------------------------------- lookups
ASK_SQL = """CASE s_suppkey % 5 WHEN 0 THEN ' ' || s_suppkey || ' ' WHEN 1 THEN 'MER#00000' || lpad(CAST(s_suppkey % 300 AS VARCHAR), 4, '0') WHEN 2 THEN '  ' WHEN 3 THEN s_name ELSE '#' END"""


@query("candidates_asked", f"""
    WITH a AS (SELECT s_suppkey AS ask_id, {ASK_SQL} AS ask, trim({ASK_SQL}) AS t FROM supplier)
    SELECT ask_id, ask, coalesce(any_value(e.c_custkey), min(n.c_custkey)) AS id, CASE WHEN t = '' THEN 'No candidate was named' WHEN coalesce(any_value(e.c_custkey), min(n.c_custkey)) IS NULL THEN 'No candidate found matching ''' || t || '''' END AS error
    FROM a LEFT JOIN customer e ON t = CAST(e.c_custkey AS VARCHAR) LEFT JOIN customer n ON t <> '' AND contains(lower(n.c_name), lower(t)) GROUP BY ask_id, ask, t""")
def candidates_asked(spark, d):
    asks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ask_id"), F.expr(ASK_SQL.replace("VARCHAR", "STRING")).alias("ask"))
    return lookup.candidates_asked(asks, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("candidate_summaries", f"""
    SELECT c_custkey AS id, c_name AS name, coalesce(s.skills, '') AS skills, n_name AS job, CASE WHEN n_regionkey = 2 THEN 'closed' WHEN n_name IS NOT NULL THEN 'open' END AS job_status, c_custkey IN (SELECT doc_id // 2 FROM documents) AS has_resume
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + c_custkey % 2 LEFT JOIN (SELECT candidate_id, string_agg(skill_name, '|' ORDER BY skill_name) AS skills FROM {SKILLS_SQL} GROUP BY 1) s ON candidate_id = c_custkey""")
def candidate_summaries(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_nationkey") + F.col("c_custkey") % 2).alias("job_id"))
    jobs = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"), F.when(F.col("n_regionkey") == 2, "closed").otherwise("open").alias("status"))
    found = lookup.candidate_summaries(people, skills(spark, d), jobs, resumes(spark, d))
    return found.select("id", "name", F.array_join("skills", "|").alias("skills"), F.col("applied_job.title").alias("job"), F.col("applied_job.status").alias("job_status"), "has_resume")


def resumes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("doc_id div 2").alias("candidate_id"), F.when(F.col("doc_id") % 7 != 3, F.col("text")).alias("parsed_content"))


@query("resumes_latest", """
    WITH r AS (SELECT doc_id AS id, doc_id // 2 AS candidate_id, CASE WHEN doc_id % 7 <> 3 THEN text END AS body, max(doc_id) OVER (PARTITION BY doc_id // 2) AS latest FROM documents)
    SELECT c_custkey AS candidate_id, c_name AS candidate, r.id AS resume_id, CASE WHEN length(body) > 6000 THEN substring(body, 1, 6000) || chr(10) || '...[truncated]' ELSE body END AS parsed_content,
      CASE WHEN r.id IS NULL THEN 'No parsed resume on file for ' || c_name END AS error FROM customer LEFT JOIN r ON candidate_id = c_custkey AND r.id = latest AND body <> ''""")
def resumes_latest(spark, d):
    return lookup.latest_resumes(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), resumes(spark, d))


@query("job_summaries", """
    SELECT p_partkey AS id, p_name AS title, p_brand AS department, p_type AS location, 'open' AS status,
      CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand || '|' || p_type || '|' ELSE p_name END AS skills, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1 END AS n FROM part""")
def job_summaries(spark, d):
    text = F.when(F.col("p_size") % 3 == 1, F.concat("p_brand", F.lit(" , "), "p_type", F.lit(","))).when(F.col("p_size") % 3 == 2, F.col("p_name")).when(F.col("p_size") % 2 == 0, "")
    found = lookup.job_summaries(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("department"), F.col("p_type").alias("location"), F.lit("open").alias("status"), text.alias("skills")))
    return found.withColumn("n", F.size("skills")).withColumn("skills", F.array_join("skills", "|"))


@query("jobs_saved", """
    SELECT o_orderkey AS id, o_custkey AS candidate_id, o_custkey % 30 AS job_id, n_name AS job_title, r_name AS job_department, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS job_location, o_orderdate AS saved_at, o_orderpriority AS notes
    FROM orders JOIN nation ON o_custkey % 30 = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def jobs_saved(spark, d):
    jobs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    jobs = jobs.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.col("r_name").alias("department"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name")).alias("location"))
    saved = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("candidate_id"), (F.col("o_custkey") % 30).alias("job_id"), F.col("o_orderdate").alias("saved_at"), F.col("o_orderpriority").alias("notes"))
    return lookup.saved_jobs(saved, jobs)


# ---------------------------------------------------------------- fields of jobs
DEPARTMENT_SQL = "CASE o_orderkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN '  middle   east ' WHEN 2 THEN 'Old dept' WHEN 3 THEN 'africa' WHEN 4 THEN 'nowhere' ELSE 'EUROPE' END"
NUMBER_SQL = "CASE WHEN o_orderkey % 7 > 0 THEN ' R-  ' || (o_custkey % 1300) || ' ' END"
OWN_SQL = "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END"


@query("job_fields_checked", f"""
    WITH jobs AS (SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 11 = 0 THEN 'Old dept' ELSE r_name END AS department, 'R- ' || (c_custkey % 1200) AS number FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    c AS (SELECT o_orderkey AS change_id, {OWN_SQL} AS job_id, o_orderkey % 9 > 0 AS sets, {DEPARTMENT_SQL} AS department, {NUMBER_SQL} AS raw, trim(regexp_replace({DEPARTMENT_SQL}, '\\s+', ' ', 'g')) AS t, trim(regexp_replace({NUMBER_SQL}, '\\s+', ' ', 'g')) AS number FROM orders),
    x AS (SELECT c.*, j.department AS own, r_name AS listed, r_regionkey <> 3 AS active, lo.id AS lo_id, lo.title AS lo_title, hi.id AS hi_id, hi.title AS hi_title FROM c LEFT JOIN jobs j ON j.id = c.job_id LEFT JOIN region ON lower(r_name) = lower(t)
      LEFT JOIN (SELECT number, min(id) AS lo, max(id) AS hi FROM jobs GROUP BY 1) k ON k.number = c.number LEFT JOIN jobs lo ON lo.id = k.lo LEFT JOIN jobs hi ON hi.id = k.hi),
    y AS (SELECT *, CASE WHEN NOT sets THEN NULL WHEN t = '' THEN 'A department is required.' WHEN listed IS NULL AND t = own THEN NULL
        WHEN listed IS NULL THEN '''' || t || ''' is not on the department list. Choose one from the list, or ask an admin to add it on the Team page.'
        WHEN NOT active AND listed IS DISTINCT FROM own THEN '''' || listed || ''' is turned off. Choose another department.' END AS wrong,
      CASE WHEN lo_id IS NULL THEN NULL WHEN job_id IS NULL OR lo_id <> job_id THEN lo_title WHEN hi_id <> job_id THEN hi_title END AS other FROM x)
    SELECT change_id, job_id, CASE WHEN sets THEN coalesce(listed, t) ELSE department END AS department, number AS requisition_number, CASE WHEN wrong IS NOT NULL THEN 422 WHEN other IS NOT NULL THEN 409 END AS status,
      coalesce(wrong, 'Requisition ' || number || ' is already used by ''' || other || '''.') AS detail FROM y""")
def job_fields_checked(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    jobs = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 11 == 0, "Old dept").otherwise(F.col("r_name")).alias("department"), F.concat(F.lit("R- "), F.col("c_custkey") % 1200).alias("requisition_number"),
    )
    sets = F.when(F.col("o_orderkey") % 9 > 0, F.array(F.lit("department"), F.lit("requisition_number"))).otherwise(F.array(F.lit("requisition_number")))
    changes = table(spark, d, "orders").select(F.col("o_orderkey").alias("change_id"), F.expr(OWN_SQL).alias("job_id"), sets.alias("fields"), F.expr(DEPARTMENT_SQL).alias("department"), F.expr(NUMBER_SQL).alias("requisition_number"))
    return lookup.checked_fields(changes, jobs, r.select(F.col("r_name").alias("name"), (F.col("r_regionkey") != 3).alias("active"))).drop("fields")
