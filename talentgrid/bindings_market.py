"""Operators on titles, skills and texts bound to the star-schema tables, with their SQL.

A job is a part: its title is name and type, its skills are its brand and the priorities of the orders that hold it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.bindings import query
from talentgrid.operators import market, nearmatch
from talentgrid.sources.tables import table


# ---------------------------------------------------------------- comparable jobs and market skills
def jobs(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"))


def titles(spark, d):
    """Every different title is asked for; it is its own id."""
    return jobs(spark, d).select(F.col("title").alias("wanted_id"), "title").distinct()


def job_skills(spark, d):
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    asked = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("job_id"), F.col("o_orderpriority").alias("skill")).distinct()
    return asked.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_brand").alias("skill")))


COMPARABLE_SQL = r"""
    WITH jobs AS (SELECT p_partkey AS job_id, p_name || ' ' || lower(p_type) AS title FROM part),
    words AS (SELECT job_id, title, list_distinct(list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}+#]+'), lambda w: w <> '')) AS w FROM jobs),
    titles AS (SELECT DISTINCT title, w FROM words),
    close AS (SELECT a.title AS wanted_id, b.title, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS similarity FROM titles a JOIN titles b
              ON 2 * len(list_intersect(a.w, b.w)) >= len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AND len(list_intersect(a.w, b.w)) > 0),
    comparable AS (SELECT wanted_id, job_id, similarity, row_number() OVER (PARTITION BY wanted_id ORDER BY similarity DESC, job_id) AS place FROM close JOIN jobs USING (title) QUALIFY place <= 8)"""


@query("comparable_jobs", COMPARABLE_SQL + "SELECT wanted_id, job_id, round(similarity, 6) AS similarity, place FROM comparable")
def comparable_jobs(spark, d):
    return market.comparable_jobs(jobs(spark, d), titles(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query("market_skills", COMPARABLE_SQL + r""",
    skills AS (SELECT l_partkey AS job_id, o_orderpriority AS skill FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT p_partkey, p_brand FROM part),
    plain AS (SELECT DISTINCT job_id, trim(regexp_replace(regexp_replace(lower(trim(skill)), '[^a-z0-9+#.\-_/ ]+', '', 'g'), '\s+', ' ', 'g')) AS skill FROM skills),
    counted AS (SELECT wanted_id, skill, count(*) AS jobs FROM comparable JOIN plain USING (job_id) WHERE skill <> '' GROUP BY 1, 2)
    SELECT wanted_id, skill, jobs, row_number() OVER (PARTITION BY wanted_id ORDER BY jobs DESC, length(skill), skill) AS place FROM counted""")
def market_skills(spark, d):
    return market.market_skills(market.comparable_jobs(jobs(spark, d), titles(spark, d)), job_skills(spark, d))


def market_candidates(spark, d):
    """Customers with what they bought as listed skills; their text is the document of the same number."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate_id"))
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" and ", "p_brand", "p_name").alias("skill"))
    bought = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("candidate_id").agg(F.collect_set("skill").alias("skills"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("candidate_id"), "text")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id")).join(bought, "candidate_id", "left").join(docs, "candidate_id", "left")


@query("market_alignment")
def market_alignment(spark, d):
    """Each customer against the market of the title of every part of their latest order."""
    wanted = titles(spark, d)
    markets = market.market_of(wanted, market.comparable_jobs(jobs(spark, d), wanted), job_skills(spark, d)).withColumnRenamed("wanted_id", "title")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("l_orderkey"))
    last = o.join(table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("job_id")), "l_orderkey").join(jobs(spark, d), "job_id")
    pairs = last.select(F.col("o_custkey").alias("candidate_id"), "title")
    found = market.aligned(pairs, market_candidates(spark, d), markets)
    lists = ("market_skills", "candidate_skills", "matching_skills", "missing_skills")
    return found.select("candidate_id", "title", "overlap_ratio", *[F.array_join(c, ", ").alias(c) for c in lists])


@query("near_terms")
def near_terms(spark, d):
    """Long words of the benchmark that documents spell nearly so: term, spelling, its ratio and the number of documents."""
    words = lambda t: F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{8,})"), F.lit(1))))
    docs = table(spark, d, "documents").select("doc_id", words("text").alias("text")).groupBy("text").agg(F.count("*").alias("documents"))
    terms = table(spark, d, "benchmark").select(words("text").alias("entry")).distinct()
    found = nearmatch.near_matches(docs, terms)
    return found.join(docs, "text").select(F.col("entry").alias("term"), F.col("text").alias("spelling"), F.round("ratio", 6).alias("ratio"), "documents")
