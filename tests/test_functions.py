"""Text, labels, scoring and transitions on small tables of cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from talentgrid.functions import labels as L
from talentgrid.functions import requirements as Q
from talentgrid.functions import scoring as S
from talentgrid.functions import text as T
from talentgrid.operators import evaluation, governance, ranking, search, transitions
from talentgrid.sources.pages import pieces


def values(spark, cases, f):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", f(F.col("c")).alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


def test_tags(spark):
    assert values(spark, ["Relocation OK", "C++", "C# developer", "Señor engineer", "a" * 80, "", "!!!"], T.tag) == ["relocation-ok", "cplusplus", "csharp-developer", "senor-engineer", "a" * 50, None, None]


def test_degrees(spark):
    cases = ["B.Tech", "M.S. in Statistics", "Ph.D. Physics", "Doctor of Philosophy", "Associate of Science", "High School Diploma", "Certificate in Project Management", "Doctor of Medicine", "", None]
    assert values(spark, cases, T.degree_level) == ["bachelor", "master", "phd", "phd", "none", "none", None, None, None, None]


def test_stage_text_and_events(spark):
    assert values(spark, ["the hiring manager review stage", "Technical-Interview round"], T.stage_text) == ["hiring manager review", "technical interview"]
    kinds = spark.createDataFrame([("outcome", "hired", "passed"), ("outcome", "hired", "skipped"), ("round", "x", "failed")], "a string, b string, c string")
    assert [r[0] for r in kinds.select(L.event_kind(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["hired", None, "rejected"]


def test_scrub(spark):
    # names go first, so an address that begins with one leaves the words before the mark
    text = "Priya Raman, priya@x.com, p.r@x.com, (415) 555-0142, https://a.b/c, 2019-2023, Supriya"
    got = values(spark, [text], lambda c: T.scrubbed(c, ("Priya Raman", "Priya", "Raman")))[0]
    assert got == "the candidate, the [email removed], [email removed], [phone removed], [link removed] 2019-2023, Supriya"


def test_csv_guard_and_sources(spark):
    assert values(spark, ["=1+1", "-x", "ok", None], L.csv_cell) == ["'=1+1", "'-x", "ok", ""]
    assert values(spark, ["LinkedIn ", "direct", "", None, "radio"], L.source_key) == ["linkedin", "direct_application", "direct_application", "direct_application", "other"]
    assert values(spark, ["company_website", "unknown", "x"], L.source_label) == ["Company website", "Not recorded", "Other"]


def test_places():
    assert L.place_patterns("anywhere") == [] and L.place_patterns("the west coast") == ["%, CA%", "%, OR%", "%, WA%"] and L.place_patterns("anywhere in Austin") == ["%austin%"] and L.place_patterns(" Austin ") == ["%Austin%"]


def test_terms_and_bands(spark):
    assert [T.stems(t) for t in ("agencies", "flies", "classes", "glass", "scaling", "trained", "airlines", "use")] == [["agencies", "agency"], ["flies", "flie"], ["classes", "classe", "class"], ["glass"], ["scaling", "scal"], ["trained", "train"], ["airlines", "airline", "airlin"], ["use"]]
    assert T.terms_of("people who have worked in insurance") == ["insurance"] and T.terms_of("retail store managers") == ["retail", "store"] and T.terms_of("engineers") == []
    assert values(spark, ["someone strong in SQL and dbt"], T.query_terms) == [["sql", "dbt"]]
    hits = spark.createDataFrame([(1, "Airline analytics engineer", 0.60), (2, "Data Scientist", 0.755), (3, "Systems Engineer", 0.639)], "id int, position string, sim double")
    got = {r.id: (r.relevance, r.matched_on) for r in search.banded(hits, "commercial airline pilots", "sim", ["position"]).collect()}
    assert got == {1: ("moderate", ["airline"]), 2: ("strong", []), 3: ("weak", [])}


@pytest.mark.parametrize(("text", "want"), [("Senior Data Engineer", ("senior", 7)), ("Director", ("executive", 15)), ("3 years experience", ("mid", 3)), ("9 yrs of experience", ("lead", 9)), ("", ("mid", 4)), ("junior dev", ("mid", 4))])
def test_seniority(spark, text, want):
    assert tuple(values(spark, [text], S.seniority)[0]) == want


def test_scores(spark):
    arrays = spark.createDataFrame([(["Python", "SQL", "Go"], ["python", "sqlx"]), (["a"], []), (["x", "x"], ["x"])], "w array<string>, h array<string>")
    got = [round(r[0], 4) for r in arrays.select(S.skill_match(F.col("w"), F.col("h"))["score"]).collect()]
    assert got == [50.0, 30.0, 100.0]
    one = spark.range(1).select(S.role_match(F.lit("Data Scientist"), F.lit("Software Engineer II"), F.lit(0.8), *(S.role_category(S.plain_title(F.lit(t)), True) for t in ("Senior Data Scientist", "Software Engineer II"))).alias("r"), Q.cap(F.lit(2)).alias("c"), S.tier(F.lit(30.0))["name"].alias("t"))
    r = one.first()
    assert (round(r.r.score, 6), r.r.relationship, r.c, r.t) == (16.0, "moderately_incompatible", 50.0, "moderate_role_mismatch")


def test_years(spark):
    spans = spark.createDataFrame([("a", date(2016, 1, 1), date(2020, 1, 1)), ("a", date(2019, 1, 1), date(2021, 1, 1)), ("a", date(2023, 1, 1), None), ("a", None, date(2010, 1, 1))], "id string, start_date date, end_date date")
    assert abs(ranking.merged_years(spans, "id", F.lit(date(2026, 1, 1))).first().years - 8.0) <= 0.05


def machine(spark):
    rows = [(1, "active", k, kind, p, True, s) for p, (k, kind, s) in enumerate([("a", "round", "in_progress"), ("b", "round", "pending"), ("offer", "round", "pending"), ("hired", "outcome", "pending")], 1)]
    df = spark.createDataFrame(rows, "application_id int, application_status string, stage_key string, stage_kind string, position int, enabled boolean, status string")
    return df.withColumn("started_at", F.lit(None).cast("timestamp_ntz")).withColumn("completed_at", F.lit(None).cast("timestamp_ntz"))


@pytest.mark.parametrize(
    ("action", "states", "status", "refused"),
    [
        ("advance", ["passed", "in_progress", "pending", "pending"], "active", None),
        ("skip", ["skipped", "in_progress", "pending", "pending"], "active", None),
        ("reject", ["failed", "skipped", "skipped", "skipped"], "rejected", None),
        ("decline", ["in_progress", "pending", "pending", "pending"], "active", "only an offer can be declined"),
        ("withdraw", ["skipped", "skipped", "skipped", "skipped"], "withdrawn", None),
    ],
)
def test_transitions(spark, action, states, status, refused):
    commands = spark.createDataFrame([(1, action)], "application_id int, action string")
    got = transitions.applied(machine(spark), commands, datetime(2025, 1, 1)).orderBy("position").collect()
    assert [r.new_status for r in got] == states and got[0].new_application_status == status and got[0].refused == refused


def test_retention(spark):
    with pytest.raises(ValueError):
        governance.checked_days(29)
    activity = spark.createDataFrame([("stale", datetime(2020, 1, 1)), ("open", datetime(2020, 1, 1)), ("fresh", datetime(2025, 1, 1)), ("none", None)], "candidate_id string, last_activity timestamp_ntz")
    apps = spark.createDataFrame([("open", "active"), ("stale", "rejected")], "candidate_id string, status string")
    assert {r.candidate_id: r.held for r in governance.inactive(activity, apps, datetime(2024, 1, 1)).collect()} == {"none": "no recorded activity", "open": "open application", "stale": None}


def test_evaluation_and_pieces(spark):
    df = spark.createDataFrame([(["data engineer", "acme"], ["Data Engineer", "Acme Inc"])], "w array<string>, g array<string>")
    r = df.select(evaluation.set_f1(F.col("w"), F.col("g")), evaluation.recall(evaluation.keys(F.col("w")), evaluation.keys(F.col("g")))).first()
    assert tuple(r) == (1.0, 1.0)
    text = "word " * 700
    cut = pieces(text)
    assert all(len(p) <= 1000 for p in cut) and len(cut) > 3 and pieces("") == []


RESUME = """Ada Lovelace
London, UK | ada@engine.org | (415) 555-0142
linkedin.com/in/ada

Experience
Senior Engineer at Analytical Engines, Boston, MA  Jan 2019 - Present
- Built the first program
Analyst | Numbers Ltd 03/2015 - 12/2018
- Counted things

Education
Bachelor of Science, Mathematics
University of London - 2010 - 2014

Skills
Python, SQL, k8s
"""


def test_resume(spark):
    from talentgrid.functions import resume

    r = spark.createDataFrame([(RESUME,), (None,)], "t string").select(resume.parsed(F.col("t")).alias("p")).collect()
    p = r[0].p
    assert (p.name, p.email, p.phone, p.linkedin) == ("Ada Lovelace", "ada@engine.org", "(415) 555-0142", "linkedin.com/in/ada")
    assert [(j.title, j.start_date, j.end_date, j.description) for j in p.experience] == [("Senior Engineer", "2019-01", None, "Built the first program"), ("Analyst", "2015-03", "2018-12", "Counted things")]
    assert p.education[0].institution.startswith("University of London") and p.skills == ["Kubernetes", "Python", "SQL"] and r[1].p.email is None
    assert resume.json_object('x ```json\n{"a": [1, 2,], "b": "}"}\n``` {') == '{"a": [1, 2], "b": "}"}' and resume.json_object("no") is None
    assert values(spark, ["MARY o'brien", "john mcdonald iii"], resume.cased_name) == ["Mary O'Brien", "John McDonald III"]
    assert resume.skill_group("PostgreSQL") == "Data" and resume.skill_group("knitting") == "Other"


def test_phone_after_the_head():
    from talentgrid.functions import resume

    late = "\n".join(["Ada Lovelace", *(f"line {k}" for k in range(30)), "call (415) 555-0142", "Boston, MA"])
    p = resume.parse_one(late)
    assert p["phone"] == "(415) 555-0142" and p["location"] is None


def test_f1_normalises_each_list_once(spark):
    from talentgrid.operators import evaluation

    def searches(c):
        return spark.createDataFrame([(["a"], ["b"])], "w array<string>, g array<string>").select(c)._jdf.queryExecution().analyzed().toString().count("regexp_replace")

    w, g = F.col("w"), F.col("g")
    assert searches(evaluation.set_f1(w, g)) == searches(evaluation.keys(w)) + searches(evaluation.keys(g))
    rows = spark.createDataFrame([([], []), ([], ["b"]), (["B!", "c"], ["b c"]), (None, None), (["a"], None)], "w array<string>, g array<string>")
    assert [r[0] for r in rows.select(evaluation.set_f1(w, g)).collect()] == [1.0, 0.0, 1.0, 1.0, 0.0]


def test_equal_spans_are_of_one_island(spark):
    day = lambda m: date(2020, m, 1)
    rows = [(1, day(1), day(2))] + [(1, day(6), day(7))] * 3  # a gap that no order of the equal spans may close
    spans = spark.createDataFrame(rows, "id int, start_date date, end_date date")
    assert ranking.merged_years(spans, "id", F.lit(date(2021, 1, 1))).first().years == round((31 + 30) / 365.25, 1)


def test_long_texts_reach_a_worker_in_slices(spark, monkeypatch):
    import pyarrow as pa

    from talentgrid.sources import batches, pages, structs

    batch = pa.record_batch({"k": list(range(5)), "t": ["a" * (1 << 20), None, "b", "c" * (3 << 20), ""]})
    parts = list(batches.slices(batch, 1))
    assert [p.num_rows for p in parts] == [2, 1, 1, 1] and [k for p in parts for k in p.column(0).to_pylist()] == list(range(5))
    assert list(batches.slices(batch.slice(0, 0), 1)) == []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame([(1, "<p>x y</p>"), (2, None)], "page_id int, html string")
    for f in (lambda: pages.page_texts(df), lambda: structs.structs(df), lambda: pages.chunks(df, "html", "page_id")):
        spark.conf.set(name, 10000)
        rows = f().collect()
        assert int(spark.conf.get(name)) == batches.BATCH_ROWS and rows
