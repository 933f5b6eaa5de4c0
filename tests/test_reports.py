"""Reports against values worked out by hand for four applications of one job."""

import random
import statistics
from datetime import datetime as D

import pytest

from talentgrid.functions.vocabulary import DEFAULT_STAGES
from talentgrid.operators import ranking
from talentgrid.operators import reports as R

NOW = D(2025, 11, 20, 12)


def at(month, day):
    return D(2025, month, day)


@pytest.fixture(scope="module")
def tables(spark):
    stages = [(p, 1, k, n, kind, p, True) for p, (k, n, kind) in enumerate(DEFAULT_STAGES, 1)]
    place = {k: p for p, (k, *_) in enumerate(DEFAULT_STAGES, 1)}
    apps = [("A", "referral", "active", at(11, 1)), ("B", "linkedin", "active", at(11, 10)), ("C", "referral", "hired", at(9, 1)), ("D", "", "rejected", at(6, 1))]
    days = [at(9, d) for d in (12, 13, 14, 15, 16, 17)]
    told = {
        1: [("resume_submitted", "passed", at(11, 1), at(11, 2)), ("hm_review", "passed", at(11, 2), at(11, 4)), ("technical_written", "in_progress", at(11, 4), None)],
        2: [("resume_submitted", "passed", at(11, 10), at(11, 13)), ("hm_review", "in_progress", at(11, 17), None)],
        3: [("resume_submitted", "passed", at(9, 1), at(9, 2)), ("hm_review", "passed", at(9, 2), at(9, 12))]
        + [(k, "passed", days[i], days[i + 1]) for i, k in enumerate(("technical_written", "technical_interview", "problem_solving", "case_study", "hr_screen"))]
        + [("offer", "passed", at(9, 17), at(9, 18)), ("offer_accepted", "passed", at(9, 18), at(10, 5)), ("offer_declined", "skipped", None, at(10, 5)), ("hired", "passed", at(10, 5), at(10, 5))],
        4: [("resume_submitted", "passed", at(6, 1), at(6, 2)), ("hm_review", "failed", at(6, 2), at(9, 25))],
    }
    rows = [(i * 100 + place[k], i, place[k], s, b, e, None) for i, own in told.items() for k, s, b, e in own]
    a = spark.createDataFrame([(i, 1, c, st, so, ap) for i, (c, so, st, ap) in enumerate(apps, 1)], "id int, job_id int, candidate_id string, status string, source string, applied_at timestamp_ntz")
    s = spark.createDataFrame(stages, "id int, job_id int, key string, name string, kind string, position int, enabled boolean")
    r = spark.createDataFrame(rows, "id int, application_id int, stage_id int, status string, started_at timestamp_ntz, completed_at timestamp_ntz, changed_by string")
    return a, R.spine(a, s, r)


def test_funnel(tables):
    got = {r.stage_key: (r.ever, r.here, r.share) for r in R.funnel(tables[1]).collect()}
    assert got["resume_submitted"] == (4, 0, 1.0) and got["hm_review"] == (4, 1, 1.0) and got["technical_written"] == (2, 1, 0.5) and got["offer_accepted"] == (1, 0, 0.25)


def test_medians(tables):
    got = {r.stage_key: (r.median_days, r.n) for r in R.time_in_stage(tables[1]).collect()}
    assert got["resume_submitted"] == (1.0, 4) and got["hm_review"] == (10.0, 3) and got["offer_accepted"] == (17.0, 1)


def test_outcomes(tables):
    decided = R.outcomes(tables[1])
    assert tuple(R.time_to_outcome(decided).first()) == (34.0, 1, 116.0, 1)
    assert tuple(R.time_to_outcome(decided.limit(0)).first()) == (None, 0, None, 0)
    assert tuple(R.outcomes_between(decided, *R.quarter(NOW)).first()) == ("Q4 2025", 1, 0)
    assert tuple(R.outcomes_between(decided, *R.quarter(NOW, -1)).first()) == ("Q3 2025", 0, 1)


def test_waiting(tables):
    assert [(r.candidate_id, r.days_waiting) for r in R.no_movement(tables[1], NOW, 7).collect()] == [("A", 16)]
    assert [r.candidate_id for r in R.no_movement(tables[1], D(2025, 11, 24, 12), 7).collect()] == ["A", "B"][:2]


def test_sources_and_activity(tables):
    apps, spine = tables
    assert [tuple(r) for r in R.source_mix(apps).collect()] == [("referral", 2, 1), ("linkedin", 1, 0), ("unknown", 1, 0)]
    got = [(r.application_id, r.event) for r in R.activity(spine, apps, 8).collect()]
    assert got == [(2, "passed"), (2, "applied"), (1, "passed"), (1, "passed"), (1, "applied"), (3, "hired"), (4, "rejected"), (3, "passed")]


def test_medians_of_many(spark):
    dice = random.Random(4)
    rows = [(g, round(dice.expovariate(0.1), 6)) for g in ("a", None) for _ in range(dice.randint(20_000, 20_001))] + [("b", v) for v in (3.0, 1.0)] + [("c", 5.0)] * 4 + [("d", None), ("c", None)]
    rows += [("e", float(v % 3)) for v in range(30_001)] + [("f", 2.0)] * 9_999 + [("f", 7.0)] * 9_999
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    got = {r.g: (r["median"], r.n) for r in R.medians(df, ("g",), "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[g][0] - statistics.median(v)) <= 0.0051 and got[g][1] == len(v) for g, v in want.items())
    one = R.medians(df, (), "v").collect()
    assert abs(one[0]["median"] - statistics.median(v for own in want.values() for v in own)) <= 0.0051
    assert R.medians(df.limit(0), ("g",), "v").count() == R.medians(df.limit(0), (), "v").count() == 0


def test_rank_of_nulls(spark):
    rows = [(i, None if i % 3 else float(i % 50)) for i in range(4000)]
    got = {r.i: r["rank"] for r in ranking.ranked(spark.createDataFrame(rows, "i int, v double"), None, "v", "i").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}


def test_funnel_counts_by_a_sort(spark):
    cols = "application_id long, stage_key string, stage_kind string, status string, application_status string, position int, stage_name string"
    data = [(1, "a", "round", "passed", "active", 2, "B"), (1, "a", "round", "in_progress", "active", 1, "C"), (1, "a", "other", "passed", "active", 0, "A"), (2, "a", "round", "pending", "active", 3, None),
            (2, "b", "other", "passed", "active", 0, "x"), (None, "a", "round", "passed", "active", 4, "D"), (3, "c", "round", "in_progress", "hired", 5, "E"), (None, "d", "round", "passed", "active", 6, "F")]
    found = R.funnel(spark.createDataFrame(data, cols))
    assert [(r.stage_key, r.position, r.ever, r.here, r.share) for r in found.collect()] == [("a", 1, 1, 1, 0.333), ("c", 5, 1, 0, 0.333), ("d", 6, 0, 0, 0.0)]
    assert R.funnel(spark.createDataFrame(data[:0], cols)).count() == 0
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_left_behind_moves_lean_rows(spark):
    """What a stage row's columns say is spelled out behind the join, and the states of an application are counted in one row."""
    from talentgrid.bindings import QUERIES

    plan = QUERIES["rows_left_behind"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join "):]
    assert "in_progress" not in below and "round" not in below
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(grouped) == 1 and "Aggregate [application_id" in grouped[0] and "new_status" not in grouped[0].split("]")[0]
