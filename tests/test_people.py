"""Exports, lookups and field checks against plain versions on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import exports, lookup

PEOPLE = [(1, "Ann Lee", bytearray(b"x"), True), (2, "Bob", None, None), (3, None, None, False)]
APPLIED = [(10, 1, 7, "active", "t"), (11, 1, None, "", None), (12, 9, 7, "lost", "t"), (13, None, 7, "lost", None)]
ROWS = [(100, 10, 1, "u1", [1, 2]), (101, 10, 5, None, None), (102, 11, None, "gone", []), (103, 12, 1, "u1", None)]


def sections(spark):
    people = spark.createDataFrame(PEOPLE, "id long, full_name string, photo binary, remote boolean")
    applied = spark.createDataFrame(APPLIED, "id long, candidate_id long, job_id long, status string, token string")
    rows = spark.createDataFrame(ROWS, "id long, application_id long, stage_id long, interviewer_id string, scores array<int>").withColumn("vector", F.array(F.lit(1.0)))
    return [exports.Section("candidates", "Profile", people), exports.Section("apps", "Applications", applied, hidden={"token": "credential"}), exports.Section("rows", "Stages", rows, "application_id", "apps")]


def names(spark):
    return {"jobs": spark.createDataFrame([(7, "Chef")], "id long, name string"), "stages": spark.createDataFrame([(1, "Call")], "id long, name string"), "staff": spark.createDataFrame([("u1", "Una")], "id string, name string")}


def test_records_follow_parents(spark):
    got = {(r.candidate_id, r.section, r.id): json.loads(r.body) for r in exports.records(sections(spark)).collect()}
    assert set(got) == {(1, "candidates", 1), (2, "candidates", 2), (3, "candidates", 3), (1, "apps", 10), (1, "apps", 11), (1, "rows", 100), (1, "rows", 101), (1, "rows", 102)}
    assert got[1, "apps", 11] == {"id": 11, "candidate_id": 1, "job_id": None, "status": ""}
    assert got[1, "rows", 100] == {"id": 100, "application_id": 10, "stage_id": 1, "interviewer_id": "u1", "scores": [1, 2]}
    with pytest.raises(ValueError, match="before its parent"):
        exports.records([sections(spark)[0], sections(spark)[2]])


def test_omissions_and_references(spark):
    got = {(r.candidate_id, r.section, r.column): (r.reason, r.held) for r in exports.omissions(sections(spark)).collect()}
    assert got[1, "apps", "token"] == ("credential", 1) and got[1, "rows", "vector"] == (exports.VECTOR, 3)
    assert got[1, "candidates", "photo"] == (exports.BINARY, 1) and got[2, "candidates", "photo"][1] == 0
    known = {tuple(r) for r in exports.references(sections(spark), names(spark)).collect()}
    assert known == {(1, "jobs", "7", "Chef"), (1, "stages", "1", "Call"), (1, "staff", "u1", "Una")}
    bare = [exports.Section("candidates", "Profile", sections(spark)[0].rows.drop("photo"))]
    assert exports.omissions(bare).count() == exports.references(bare, names(spark)).count() == 0


def test_references_of_lean_rows(spark):
    """Whole numbers are made texts after each is there once, dealt by number of tasks; two columns of a kind give a reference once."""
    twice = spark.createDataFrame([(5, 1, "u1", None), (6, 1, "u1", "u1"), (7, 2, None, "u1"), (8, 2, "u1", "nobody")], "id long, candidate_id long, author_id string, user_id string")
    own = [*sections(spark), exports.Section("notes", "Notes", twice)]
    got = sorted(tuple(r) for r in exports.references(own, names(spark)).collect())
    assert got == [(1, "jobs", "7", "Chef"), (1, "staff", "u1", "Una"), (1, "stages", "1", "Call"), (2, "staff", "u1", "Una")]
    plan = exports.references(sections(spark), names(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [candidate_id" in plan and "Aggregate" not in plan


def test_lines_read_as_a_document(spark):
    rows = exports.lines(sections(spark), names(spark)).orderBy("candidate_id", "place", "id", "position").collect()
    told = {c: [r.line for r in rows if r.candidate_id == c] for c in (1, 2, 3)}
    assert told[1] == [
        "Record id: 1", "Full name: Ann Lee", "Remote: yes", "Record id: 10", "Job: Chef (#7)", "Status: active", "Record id: 11",
        "Record id: 100", "Application id: 10", "Stage: Call", "Interviewer: Una", "Scores: [1,2]", "Record id: 101", "Application id: 10", "Stage: #5",
        "Record id: 102", "Application id: 11", "Interviewer: a former staff account", "Scores: []",
    ]
    assert told[2] == ["Record id: 2", "Full name: Bob", exports.NOTHING, exports.NOTHING]
    assert told[3] == ["Record id: 3", "Remote: no", exports.NOTHING, exports.NOTHING]


def test_candidates_asked_equal_plain_search(spark):
    people = [(1, "Ann Lee"), (2, "ann_lee"), (3, None), (4, ""), (5, "100% Bob"), (6, "Zoë Straße"), (7, "7 Up"), (70, "1"), (8, "Ann Lee")]
    asks = [None, "", "  ", "1", "7", "lee", "LEE", "n_l", "0%", "%", "_", "ë", "zo", "STRASSE", "straße", "nobody", "ann lee", " Ann Lee ", "70", "b", "'"]
    got = {r.k: r for r in lookup.candidates_asked(spark.createDataFrame(list(enumerate(asks)), "k int, ask string"), spark.createDataFrame(people, "id long, name string")).collect()}
    assert len(got) == len(asks)
    for k, ask in enumerate(asks):
        t = (ask or "").strip()
        want = next((i for i, _ in people if str(i) == t), None) or min((i for i, n in people if t and n and t.lower() in n.lower()), default=None)
        error = "No candidate was named" if not t else None if want else f"No candidate found matching '{t}'"
        assert (got[k].id, got[k].error) == (want, error)


def test_summaries_resumes_and_saved_jobs(spark):
    people = spark.createDataFrame([(1, "A", 7), (2, "B", 8), (3, None, None)], "id long, name string, job_id long")
    skills = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "x")], "candidate_id long, skill_name string")
    jobs = spark.createDataFrame([(7, "Chef", "open", "D", None, " a ,b,"), (9, "Cook", "open", None, "L", None)], "id long, title string, status string, department string, location string, skills string")
    resumes = spark.createDataFrame([(1, 1, "old"), (5, 1, "x" * 6001), (2, 2, "text"), (3, 2, ""), (4, None, "y")], "id long, candidate_id long, parsed_content string")
    got = {r.id: r for r in lookup.candidate_summaries(people, skills, jobs, resumes).collect()}
    assert got[1].skills == ["a", "b"] and tuple(got[1].applied_job) == (7, "Chef", "open") and got[1].has_resume
    assert got[2].skills == [] and got[2].applied_job is None and not got[3].has_resume
    latest = {r.candidate_id: r for r in lookup.latest_resumes(people, resumes).collect()}
    assert latest[1].resume_id == 5 and latest[1].parsed_content == "x" * 6000 + lookup.CUT and latest[1].error is None
    assert latest[2].error == "No parsed resume on file for B" and latest[3].error == "No parsed resume on file for "
    assert {r.id: r.skills for r in lookup.job_summaries(jobs).collect()} == {7: ["a", "b", ""], 9: []}
    saved = spark.createDataFrame([(1, 1, 7, None, None), (2, 1, 99, None, "n"), (3, None, 9, None, "n")], "id long, candidate_id long, job_id long, saved_at timestamp, notes string")
    assert {(r.id, r.job_title, r.job_location) for r in lookup.saved_jobs(saved, jobs).collect()} == {(1, "Chef", None), (3, "Cook", "L")}


def test_checked_fields(spark):
    jobs = spark.createDataFrame([(1, "Chef", "Off", "R 1"), (2, "Cook", "Gone", "R 1"), (3, "Maid", "On", None)], "id long, title string, department string, requisition_number string")
    listed = spark.createDataFrame([("On", True), ("Off", False)], "name string, active boolean")
    both = ["department", "requisition_number"]
    cases = [
        (None, both, " on ", " ", ("On", None, None, None)),
        (None, both, None, "R 9", ("", "R 9", 422, "A department is required.")),
        (1, both, "OFF", "R  1", ("Off", "R 1", 409, "Requisition R 1 is already used by 'Cook'.")),
        (2, both, "Gone", "R 1", ("Gone", "R 1", 409, "Requisition R 1 is already used by 'Chef'.")),
        (3, both, "Off", "R 1", ("Off", "R 1", 422, "'Off' is turned off. Choose another department.")),
        (2, ["department"], "Gone", " R 1 ", ("Gone", " R 1 ", None, None)),
        (3, ["requisition_number"], " nowhere ", None, (" nowhere ", None, None, None)),
        (3, None, " x ", "R 1", (" x ", "R 1", None, None)),
        (99, ["department"], "Gone", None, ("Gone", None, 422, "'Gone' is not on the department list. Choose one from the list, or ask an admin to add it on the Team page.")),
    ]
    changes = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, job_id long, fields array<string>, department string, requisition_number string")
    got = {r.k: (r.department, r.requisition_number, r.status, r.detail) for r in lookup.checked_fields(changes, jobs, listed).collect()}
    assert got == {k: c[4] for k, c in enumerate(cases)}


def test_names_asked_for_are_not_broadcast(spark):
    asks, people = spark.createDataFrame([("ann",)], "ask string"), spark.createDataFrame([(1, "Joann")], "id long, name string")
    plan = lookup.candidates_asked(asks, people)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Contains" in line or "_part" in line and "Join" in line)
    assert "SortMergeJoin" in join
