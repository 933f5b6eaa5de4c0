"""Requirements, pair scores, stage edits, dates, bullets and feedback on small tables of cases."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from talentgrid.functions import dates as D
from talentgrid.functions import profiles as P
from talentgrid.functions import requirements as Q
from talentgrid.operators import listing, matching, ranking, stages, transitions


def values(spark, cases, f, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}").select("i", f(F.col("c")).alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ({"must_have_skills": ["Python", " python ", "SQL", ""], "min_years": 3}, (["Python", "SQL"], [], 3, None, None)),
        ({"must_have_skills": "Go,  Rust , go"}, (["Go", "Rust"], [], None, None, None)),
        ({"min_education": "master"}, ([], [], None, None, "master")),
        ({"min_education": "none"}, None), ({}, None), ({"min_years": 9, "max_years": 3}, None), ({"min_years": 51}, None), ({"min_years": 2.5}, None),
        ({"min_education": "diploma"}, None), ({"must_have_skills": ["a"], "nice_to_have_skills": ["A"]}, None), ({"must_have_skills": ["x" * 61]}, None),
        ({"must_have_skills": [f"s{k}" for k in range(21)]}, None),
    ],
)
def test_requirements(spark, raw, want):
    got = values(spark, [json.dumps(raw)], Q.parsed)[0]
    assert (tuple(got) if got else None) == want


def test_broken_requirements(spark):
    assert values(spark, [None, "", "{", "[1]", "not json"], Q.parsed) == [None] * 5


def jobs(spark, **requirements):
    row = (1, "Senior Data Scientist", "", ["Python", "SQL"], json.dumps(requirements) if requirements else None)
    return spark.createDataFrame([row], "job_id int, title string, text string, wanted array<string>, requirements string")


def people(spark):
    rows = [(1, "Data Scientist", ["python", "sql"], 10.0, ["BSc"], 0.9), (2, "Sales Manager", ["excel"], None, None, 0.9), (3, "Senior Data Scientist", ["Python"], 1.0, ["High School Diploma"], 1.0)]
    return spark.createDataFrame(rows, "id int, position string, skills array<string>, years double, degrees array<string>, similarity double")


def test_pairs(spark):
    got = {r.id: r for r in matching.best_candidates(jobs(spark), people(spark), 0.0).collect()}
    assert [got[i].rank for i in (1, 3, 2)] == [1, 2, 3] and got[2].tier == "severe_role_mismatch" and got[2].relationship == "highly_incompatible" and got[1].limit is None
    asked = jobs(spark, must_have_skills=["SQL", "Spark"], nice_to_have_skills=["Python"], min_years=4, min_education="bachelor")
    got = {r.id: r for r in matching.best_candidates(asked, people(spark), 0.0).collect()}
    assert (got[1].reasons, got[1].limit) == (["must-have skill Spark"], 70.0) and got[1].match_score == 70.0
    assert got[3].reasons == ["must-have skill SQL", "must-have skill Spark", "at least 4 years of experience", "a bachelor's degree"] and got[3].limit == 50.0
    assert got[1].explanation.endswith("Missing must-have skills: Spark. Has 1 of 1 nice-to-have skills. Score capped at 70 because one requirement is missing")
    assert "About 1 years of recorded experience against a minimum of 4. No degree recorded, and the job asks for a bachelor's degree" in got[3].explanation
    assert [(r.id, r["rank"]) for r in matching.trace(asked, people(spark), 2).collect()] == [(2, 3)]
    assert [r.job_id for r in matching.best_jobs(people(spark), asked, 60.0).collect()] == [1]
    applied = spark.createDataFrame([(1, 3), (1, 3)], "job_id int, candidate_id int")
    assert [r.match_score for r in matching.applicants(applied, asked, people(spark)).collect()] == [got[3].match_score]
    assert matching.best_candidates(asked.limit(0), people(spark)).count() == matching.best_candidates(asked, people(spark).limit(0)).count() == 0


def test_profiles(spark):
    spans = spark.createDataFrame([(1, date(2016, 1, 1), date(2020, 1, 1))], "candidate_id int, start_date date, end_date date")
    degrees = spark.createDataFrame([(1, "BSc"), (1, None), (3, "MBA")], "candidate_id int, degree string")
    got = {r.id: (r.years, r.degrees) for r in matching.profiles(people(spark), spans, degrees, F.lit(date(2024, 1, 1))).collect()}
    assert got == {1: (4.0, ["BSc"]), 2: (None, None), 3: (None, ["MBA"])}


def test_dates(spark):
    today = F.lit(date(2025, 5, 6))
    assert values(spark, ["2018-2022", "2018", "05/2018", "May 2018", "2018-05", "a-b", "1-2-3", "", None], D.education_month) == ["2018-01", "2018-01", "2018-05", "2018-05", "2018-01", None, None, None, None]
    assert values(spark, ["Present", "Mar 2021", "03/2021", "2021", "x", None, "3-2020"], D.sort_key) == ["9999-99", "2021-03", "2021-03", "2021-00", "0000-00", "0000-00", "2020-03"]
    assert values(spark, ["current", "Jun 2012", "soon", "", None], D.service_date) == ["Present", "2012", "soon", None, None]
    assert [tuple(r) for r in values(spark, ["Mar 2021 - Mar 2023", "May 2024 - Present", "2020", ""], lambda c: D.date_range(c, today))] == [(date(2021, 3, 1), date(2023, 3, 1)), (date(2024, 5, 1), None), (date(2020, 1, 1), None), (None, None)]
    assert tuple(values(spark, ["now"], lambda c: D.education_months(F.lit("2019"), c, today))[0]) == ("2019-01", "2025-05")
    assert values(spark, ["Present", "2020"], lambda c: D.resume_date(c, today, open_end=True)) == [None, date(2020, 1, 1)]


def test_bullets(spark):
    assert values(spark, [" Led a team", "Done!", ""], P.ended) == ["Led a team.", "Done!", ""]
    assert values(spark, ["Grew sales by", "Grew sales...", "Grew sales", "by", "", None], P.completed) == ["Grew sales.", "Grew sales....", "Grew sales", "", "", ""]
    assert values(spark, [["- a", "* ", "•  b – c"]], P.points, "array<string>") == [["a", "b - c"]]
    assert values(spark, [["C++", "c++", "!!", "Go"]], P.tags, "array<string>") == [["cplusplus", "go"]]
    assert values(spark, ["a@b.co", "nope", None], P.valid_email) == ["a@b.co", None, None] and values(spark, ["555-0142", "12"], P.valid_phone) == ["555-0142", None]
    assert values(spark, ["ML Engineer", "Email marketer"], P.is_ai_role) == [True, False]
    entries = spark.createDataFrame([([("MIT", "BSc"), ("mit", "bsc"), ("MIT", None)],)], "e array<struct<institution string, degree string>>")
    assert [tuple(e) for e in entries.select(P.distinct_education(F.col("e"))).first()[0]] == [("MIT", "BSc"), ("MIT", None)]


def test_stage_edits(spark):
    own = transitions.default_stages(spark).select(F.lit(1).alias("job_id"), F.col("position").alias("id"), "key", "name", "kind", "position", F.lit(True).alias("enabled"))
    names = lambda text: [r.key for r in stages.resolved(own, text).collect()]
    assert names("technical") == ["technical_written", "technical_interview"] and names("the HR screen stage") == ["hr_screen"] and names("offered") == ["offer", "offer_accepted"] and names("") == [] and names("zzz") == []
    bad = spark.createDataFrame([(1, ["hm_review"])], "job_id int, keys array<string>")
    out = stages.reordered(own, bad)
    assert {r.refused for r in out.collect()} == {"the order must list every interview stage exactly once"} and [r.key for r in out.orderBy("position").collect()] == [r.key for r in own.orderBy("position").collect()]
    gone = spark.createDataFrame([(1, "custom_x")], "job_id int, key string")
    more = own.unionByName(spark.createDataFrame([(1, 99, "custom_x", "X", "round", 3, True)], own.schema))
    let_go = stages.without_stages(more, spark.createDataFrame([], "stage_id int, status string"), gone)
    assert let_go.first().refused is None and stages.removed(more, let_go).count() == 12


def test_feedback(spark):
    entries = spark.createDataFrame([(1, "hire", 4), (1, "no_hire", 2), (2, "strong_hire", 5), (3, None, None)], "id int, recommendation string, rating int")
    got = {r.id: (r.tally, r.split) for r in stages.tallies(entries, "id").collect()}
    assert got == {1: ("1 hire, 1 no hire, ratings from 2 to 4 of 5.", "The recommendations are split: 1 hire or strong hire, 1 against."), 2: ("1 strong hire, every rating 5 of 5.", None), 3: ("", None)}


def test_lists(spark):
    tags = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b")], "candidate_id int, tag string")
    assert [tuple(r) for r in listing.tag_counts(tags).collect()] == [("b", 2), ("a", 1)]
    whole = listing.export_of({"tags": (tags.withColumn("v", F.array(F.lit(1.0))), "candidate_id")}, tags.where("candidate_id = 2").select("candidate_id"))["tags"]
    assert [tuple(r) for r in whole.collect()] == [(2, "b")]
    assert [r.line for r in listing.rendered(whole, "tags", F.col("candidate_id")).collect()] == ["TAGS", "Candidate id: 2\nTag: b"]
    mails = spark.createDataFrame([("1", "t", "Hi", "a", 1, True), ("2", "t", "Re", "b", 2, False), ("3", "t", "Re", "a", 3, True), ("9", None, "X", "c", 5, True)], "id string, thread_id string, subject string, sender string, at int, is_read boolean")
    assert [tuple(r) for r in ranking.threads(mails).collect()] == [("9", "X", ["c"], 5, True, 1), ("t", "Hi", ["a", "b"], 3, False, 3)]
    scores = spark.createDataFrame([(k, k % 7 if k % 11 else None) for k in range(3000)], "k int, s int")
    want = sorted(range(3000), key=lambda k: (k % 11 == 0, -(k % 7) if k % 11 else 0, k))
    assert {r.k: r["rank"] for r in ranking.ranked(scores, None, "s", "k").collect()} == {k: i for i, k in enumerate(want, 1)}
    assert ranking.ranked(scores.limit(0), None, "s", "k").count() == 0


def test_written_feedback(spark):
    forms = spark.createDataFrame([(1, "u", "submit", 4, "hire", " ok "), (2, "u", "submit", None, "hire", ""), (3, "u", "draft", None, None, None), (4, "v", "draft", 3, "hire", "x")], "interview_id int, user_id string, action string, rating int, recommendation string, notes string")
    interviews = spark.createDataFrame([(k, "u", "passed", None) for k in (1, 2, 3, 4)], "interview_id int, interviewer_id string, stage_status string, status string")
    got = {r.interview_id: (r.refused, r.status, r.notes) for r in stages.feedback_written(forms, interviews, datetime(2025, 1, 1)).collect()}
    assert got == {1: (None, "submitted", "ok"), 2: ("a rating is from 1 to 5", None, None), 3: (None, "draft", None), 4: ("only the assigned interviewer can write", None, None)}
