"""De-identified rows, backfills and streams bound to the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.bindings import NOW, NOW_SQL, POSITION_SQL, STATUS_SQL, query
from talentgrid.operators import backfill, merging, privacy
from talentgrid.sources.tables import table
from talentgrid.streaming import audit, runs


# ---------------------------------------------------------------- de-identification
def parsed_rows(spark, d):
    """A nested row for each customer: personal data, the parts of each order, and notes that name the person."""
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    name = F.concat(F.lit("Ann-"), F.col("c_custkey"), F.lit(" (Annie) O'Neil"))
    parts = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_name")).alias("names"))
    lines = o.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    note = F.concat(F.lit("ANNIE o'neil, ann-"), F.col("c_custkey"), F.lit("x: a.o@mail.org or www.shop.org/a, (415) 555-0142; "), F.element_at("names", 1))
    entry = F.struct(F.col("o_orderkey").alias("id"), note.alias("note"), F.create_map(F.lit("Annie"), F.transform("names", lambda n: F.concat(n, F.lit(" by Annie")))).alias("by"))
    jobs = lines.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e"))), lambda a, b: F.signum(a["o_orderkey"] - b["o_orderkey"]).cast("int")).alias("jobs"))
    c = table(spark, d, "customer").join(jobs, "c_custkey", "left")
    info = F.struct(name.alias("name"), F.when(F.col("c_acctbal") > 0, "a.o@mail.org").alias("email"), F.lit("").alias("phone"), F.concat(F.lit("I am "), name, F.lit(".")).alias("summary"))
    return c.select("c_custkey", info.alias("personal_info"), F.transform("jobs", lambda j: j["e"]).alias("jobs"), F.lit("raw").alias("raw_text"), "c_mktsegment")


ANON_SQL = r"""
    WITH notes AS (SELECT c_custkey, o_orderkey, 'ANNIE o''neil, ann-' || c_custkey || 'x: a.o@mail.org or www.shop.org/a, (415) 555-0142; ' || min(p_name) AS note, count(DISTINCT p_name) AS parts
                   FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    clean AS (SELECT *, replace(replace(replace(replace(note, 'ANNIE o''neil, ', 'the candidate the candidate, '), 'a.o@mail.org', '[email removed]'), 'www.shop.org/a,', '[link removed]'), '(415) 555-0142', '[phone removed]') AS safe FROM notes)
    SELECT c.c_custkey, coalesce(string_agg(safe, '|' ORDER BY o_orderkey), '') AS notes, 'I am the candidate.' AS summary, 3 * count(note) + coalesce(sum(parts), 0)::BIGINT + 1 - count(note) AS name_mentions,
           count(note) AS emails, count(note) AS phones, count(note) AS links, CASE WHEN c_acctbal > 0 THEN 'name,email' ELSE 'name' END AS removed
    FROM customer c LEFT JOIN clean USING (c_custkey) GROUP BY c.c_custkey, c_acctbal"""


@query("anonymized_rows", ANON_SQL)
def anonymized_rows(spark, d):
    found = privacy.anonymized(parsed_rows(spark, d), "c_custkey")
    notes = F.array_join(F.transform("safe.jobs", lambda j: j["note"]), "|")
    long = lambda c: F.col(f"report.{c}").cast("long")
    return found.select(
        "c_custkey", F.coalesce(notes, F.lit("")).alias("notes"), F.col("safe.personal_info.summary").alias("summary"), long("name_mentions_scrubbed").alias("name_mentions"),
        long("emails_scrubbed").alias("emails"), long("phones_scrubbed").alias("phones"), long("links_scrubbed").alias("links"), F.array_join("report.identifying_fields_removed", ",").alias("removed"),
    )


@query("people_exchanged", """
    SELECT s_suppkey, 'Interviewer 1 met Interviewer 2 and Interviewer 1; Interviewer 2 (' || s_suppkey || ') ' || s_name AS text FROM supplier""")
def people_exchanged(spark, d):
    n = F.col("s_suppkey")
    people = F.array(*[F.struct(F.concat(F.lit(name), n).alias("name"), F.lit(to).alias("replacement")) for name, to in (("Ada Interviewer Lovelace", "Interviewer 1"), ("Bo Lovelace Li", "Interviewer 2"))])
    text = F.concat(F.lit("ada interviewer LOVELACE"), n, F.lit(" met bo lovelace Li"), n, F.lit(" and Ada; LI"), n, F.lit(" ("), n, F.lit(") "), F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", privacy.people_exchanged(text, people).alias("text"))


# ---------------------------------------------------------------- backfills
def backfill_tables(spark, d):
    """(applications, stages, rows): jobs are nations with three stages and, but for those of one region, a withdrawn one."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    status = F.when(F.col("o_orderstatus") == "F", "hired").when(F.col("o_orderpriority") == "1-URGENT", "withdrawn").when(F.col("o_orderstatus") == "O", "active").otherwise("rejected")
    person = F.when(F.col("c_mktsegment") == "BUILDING", "interviewing").when(F.col("c_mktsegment") == "MACHINERY", "rejected").when(F.col("c_mktsegment") == "FURNITURE", "screening")
    a = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("applied_at"), person.alias("candidate_status"))
    n = table(spark, d, "nation")
    kinds = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).alias("position")) for i, k in enumerate(("A", "N", "R", "withdrawn"), 1)])
    stages = n.select(F.col("n_nationkey").alias("job_id"), "n_regionkey", F.explode(kinds).alias("s")).where("s.key <> 'withdrawn' or n_regionkey <> 1")
    stages = stages.select((F.col("job_id") * 10 + F.col("s.position")).alias("id"), "job_id", "s.key", "s.position")
    li = table(spark, d, "lineitem").join(a, F.col("l_orderkey") == F.col("id"))
    rows = li.groupBy(F.col("l_orderkey").alias("application_id"), F.col("job_id"), F.col("l_returnflag").alias("key")).agg(F.max("l_shipdate").alias("completed_at"))
    return a, stages, rows.join(stages.select("job_id", "key", F.col("id").alias("stage_id")), ["job_id", "key"]).select("application_id", "stage_id", "completed_at")


BACKFILL_SQL = f"""
    WITH a AS (SELECT o_orderkey AS id, c_nationkey AS job_id, o_orderdate AS applied_at,
                      CASE WHEN o_orderstatus = 'F' THEN 'hired' WHEN o_orderpriority = '1-URGENT' THEN 'withdrawn' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'rejected' END AS status,
                      CASE c_mktsegment WHEN 'BUILDING' THEN 'interviewing' WHEN 'MACHINERY' THEN 'rejected' WHEN 'FURNITURE' THEN 'screening' END AS candidate_status FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT n_nationkey * 10 + position AS id, n_nationkey AS job_id, key, position FROM nation, (VALUES ('A', 1), ('N', 2), ('R', 3), ('withdrawn', 4)) k(key, position) WHERE key <> 'withdrawn' OR n_regionkey <> 1),
    r AS (SELECT l_orderkey AS application_id, s.id AS stage_id, max(l_shipdate) AS completed_at FROM lineitem JOIN a ON l_orderkey = a.id JOIN s ON s.job_id = a.job_id AND s.key = l_returnflag GROUP BY 1, 2)"""


@query("outcome_stages", BACKFILL_SQL + "SELECT job_id, 'withdrawn' AS key, 'Withdrawn' AS name, 'outcome' AS kind, max(position) + 1 AS position FROM s GROUP BY job_id HAVING bool_and(key <> 'withdrawn')")
def outcome_stages(spark, d):
    return backfill.with_outcome_stage(backfill_tables(spark, d)[1], "withdrawn", "Withdrawn")


@query("outcome_rows", BACKFILL_SQL + f"""
    SELECT a.id AS application_id, s.id AS stage_id, CASE WHEN a.status = 'withdrawn' THEN 'passed' WHEN a.status = 'active' THEN 'pending' ELSE 'skipped' END AS status,
           CASE WHEN a.status = 'withdrawn' THEN closed.at_ END AS started_at, CASE WHEN a.status = 'active' THEN NULL ELSE closed.at_ END AS completed_at
    FROM a JOIN s ON s.job_id = a.job_id AND s.key = 'withdrawn' JOIN LATERAL (SELECT coalesce(max(r.completed_at), a.applied_at, {NOW_SQL}) AS at_ FROM r WHERE r.application_id = a.id) closed ON true
    WHERE EXISTS (SELECT 1 FROM r WHERE r.application_id = a.id) AND NOT EXISTS (SELECT 1 FROM r WHERE r.application_id = a.id AND r.stage_id = s.id)""")
def outcome_rows(spark, d):
    return backfill.outcome_rows(*backfill_tables(spark, d), "withdrawn", NOW)


@query("snapshot_rows", BACKFILL_SQL + """,
    b AS (SELECT *, CASE WHEN status IN ('hired', 'rejected', 'declined', 'withdrawn') THEN status WHEN candidate_status IN ('hired', 'rejected', 'withdrawn') THEN candidate_status ELSE 'active' END AS derived,
                 CASE candidate_status WHEN 'screening' THEN 1 WHEN 'on_hold' THEN 1 WHEN 'interviewing' THEN 3 WHEN 'offered' THEN 7 ELSE 0 END AS place
          FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.application_id = a.id AND r.stage_id % 10 = 1)),
    n AS (SELECT s.*, row_number() OVER (PARTITION BY job_id ORDER BY position) - 1 AS i FROM s),
    t AS (SELECT b.id AS application_id, n.id AS stage_id, b.applied_at, derived,
                 CASE WHEN derived = 'hired' THEN 'passed' WHEN derived <> 'active' THEN CASE WHEN i = 0 THEN 'passed' WHEN i = 1 AND derived = 'rejected' THEN 'failed' ELSE 'skipped' END
                      WHEN i < place THEN 'passed' WHEN i = place THEN 'in_progress' ELSE 'pending' END AS status FROM b JOIN n USING (job_id))
    SELECT application_id, stage_id, status, CASE WHEN status <> 'pending' THEN applied_at END AS started_at, CASE WHEN status IN ('passed', 'failed', 'skipped') THEN applied_at END AS completed_at, derived AS application_status FROM t""")
def snapshot_rows(spark, d):
    """Applications that never came to the first stage get a row for each stage."""
    a, stages, rows = backfill_tables(spark, d)
    return backfill.snapshot_rows(a, stages, rows.where("stage_id % 10 = 1"))


# ---------------------------------------------------------------- streams
@query("quota_stream", """
    SELECT user_id AS who, strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS n FROM events, (SELECT max(ts) AS last FROM events) GROUP BY 1, ts::DATE, last
    HAVING count(*) > 5 AND ts::DATE + INTERVAL 1 DAY <= last - INTERVAL 1 DAY""")
def quota_stream(spark, d):
    """People with more than five events on a day, from the stream of events; a day counts once its lateness is over."""
    return runs.processed(spark, f"{d}/events.parquet", "ts", lambda events: audit.daily_quota(events, "user_id", "ts", 5).withColumn("day", F.col("day").cast("string")), "quota")


@query("events_once", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def events_once(spark, d):
    """Events that two sources deliver, each kept once."""
    found = runs.processed(spark, f"{d}/events.parquet", "ts", lambda events: audit.once(events.unionByName(events), "event_id", "ts").select("event_id", "event_type"), "once")
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# ---------------------------------------------------------------- merged documents
def stored_documents(spark, d):
    """A document for each event: what it says, a place, and a list that some events confirm anew."""
    doc = F.concat(F.lit('{"personal_info":'), "props", F.lit(',"skills":["'), "event_type", F.lit('",1],"zone":{"user":'), "user_id", F.lit(',"tags":[{"a":null}]}}'))
    return table(spark, d, "events").select("event_id", doc.alias("document"))


def confirmed_documents(spark, d):
    """Purchases confirm their skills and one deed, views a list of deeds, signups what is known of them."""
    kind = F.col("event_type")
    doc = (
        F.when(kind == "purchase", F.concat(F.lit('{"skills":["new",'), "user_id", F.lit('],"military":'), "props", F.lit(',"zone":0}')))
        .when(kind == "view", F.concat(F.lit('{"military":['), "props", F.lit(',2]}')))
        .when(kind == "signup", F.concat(F.lit('{"personal_info":{"k":'), "event_id", F.lit("}}")))
    )
    return table(spark, d, "events").select("event_id", doc.alias("document")).where("document is not null")


@query("documents_merged", r"""
    WITH s AS (SELECT event_id, event_type, '{"personal_info":' || props || ',"skills":["' || event_type || '",1],"zone":{"user":' || user_id || ',"tags":[{"a":null}]}}' AS document, props, user_id FROM events),
    c AS (SELECT *, CASE event_type WHEN 'purchase' THEN '{"skills":["new",' || user_id || '],"military":[' || props || ']}' WHEN 'view' THEN '{"military":[' || props || ',2]}'
                         WHEN 'signup' THEN '{"personal_info":{"k":' || event_id || '}}' ELSE '{}' END AS patch FROM s),
    m AS (SELECT *, json_merge_patch(document, patch) AS merged FROM c)
    SELECT event_id, merged ->> '$.personal_info.k' AS k, json(merged -> '$.skills')::VARCHAR AS skills, replace(json(merged -> '$.military')::VARCHAR, ' ', '') AS military, json(merged -> '$.zone.user')::VARCHAR AS zone_user,
           array_to_string(list_sort(json_keys(patch)), ',') AS replaced FROM m""")
def documents_merged(spark, d):
    found = merging.merged_documents(stored_documents(spark, d), confirmed_documents(spark, d), "event_id")
    part = lambda path: F.get_json_object("document", path)
    return found.select("event_id", part("$.personal_info.k").alias("k"), part("$.skills").alias("skills"), part("$.military").alias("military"), part("$.zone.user").alias("zone_user"), F.array_join("replaced", ",").alias("replaced"))
