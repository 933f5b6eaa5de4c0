"""Nested de-identification against a plain walk, backfills that add nothing when run twice, streams with late and repeated rows."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import backfill, merging, privacy
from talentgrid.functions import vocabulary as V
from talentgrid.streaming import audit, runs


# ---------------------------------------------------------------- de-identification
def plain_parts(name):
    name = (name or "").strip()
    parts = [name] if name else []
    return parts + [p for p in (re.sub(r"^[()'\"]+|[()'\"]+$", "", x) for x in re.split(r"[\s,.]+", name)) if len(p) >= 2]


def plain_scrub(value, name, counts):
    if isinstance(value, str):
        parts = sorted(set(plain_parts(name)), key=len, reverse=True)
        rules = [("names", r"(?i)\b(?:" + "|".join(map(re.escape, parts)) + r")\b", V.NAME_GONE)] if parts else []
        for key, pattern, mark in (*rules, ("emails", V.EMAIL, V.EMAIL_GONE), ("links", V.LINK, V.LINK_GONE), ("phones", V.PHONE, V.PHONE_GONE)):
            value, n = re.subn(pattern, mark, value)
            counts[key] += n
        return value
    if isinstance(value, list):
        return [plain_scrub(v, name, counts) for v in value]
    if isinstance(value, dict):
        return {k: plain_scrub(v, name, counts) for k, v in value.items()}
    return value


ROWS = [
    (1, {"name": "Priya (PJ) Raman", "email": "p@x.com", "phone": "", "summary": "Priya Raman, PJ; Supriya"}, [{"note": "call priya at 415-555-0142 or p.r@x.com", "tags": {"Raman": ["see www.x.com/a", None, "RAMAN"]}, "n": 3}], ["https://a.b", None], "raw Priya"),
    (2, {"name": None, "email": None, "phone": "1", "summary": None}, None, [], None),
    (3, None, [{"note": None, "tags": None, "n": None}, None], ["a@b.co a@b.co"], "x"),
    (4, {"name": "A.*+ C++ [x]", "email": "", "phone": None, "summary": "C++ and [x] A.*+ C++ [x] C"}, [], ["C++ (x)"], ""),
    (5, {"name": "  ", "email": "e", "phone": "2", "summary": "Ann $1 \\d " * 400}, [{"note": "", "tags": {}, "n": 0}], ["José É"], ""),
]
SCHEMA = "id int, personal_info struct<name: string, email: string, phone: string, summary: string>, jobs array<struct<note: string, tags: map<string, array<string>>, n: int>>, extra array<string>, raw_text string"


def as_plain(v):
    if hasattr(v, "asDict"):
        return {k: as_plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: as_plain(x) for k, x in v.items()}
    return [as_plain(x) for x in v] if isinstance(v, list) else v


def test_anonymized(spark):
    got = {r.id: r for r in privacy.anonymized(spark.createDataFrame(ROWS, SCHEMA), "id").collect()}
    for i, info, jobs, extra, _ in ROWS:
        counts = dict.fromkeys(("names", "emails", "links", "phones"), 0)
        info = info or {}
        want = plain_scrub({"jobs": jobs, "extra": extra, "personal_info": {"summary": info.get("summary")}}, info.get("name"), counts)
        assert as_plain(got[i].safe) == want
        report = got[i].report.asDict()
        assert report.pop("identifying_fields_removed") == [f for f in privacy.IDENTIFYING if info.get(f)]
        assert report == {"name_mentions_scrubbed": counts["names"], "emails_scrubbed": counts["emails"], "phones_scrubbed": counts["phones"], "links_scrubbed": counts["links"]}
    assert privacy.anonymized(spark.createDataFrame([], SCHEMA), "id").count() == 0


def test_people_exchanged(spark):
    people = [("Ada Lovelace", "Interviewer 1"), ("Bob Interviewer", "Interviewer 2"), ("Ada Byron", "Interviewer 3"), (None, "x"), ("", "y")]
    cases = {"ada and ADA LOVELACE, Adam": "Interviewer 1 and Interviewer 1, Adam", "Bob, interviewer; Byron": "Interviewer 2, Interviewer 2; Interviewer 3", "": "", "nobody": "nobody", None: None}
    df = spark.createDataFrame([(t, [dict(zip(("name", "replacement"), p)) for p in people]) for t in cases], "t string, people array<struct<name: string, replacement: string>>")
    assert {r[0]: r[1] for r in df.select("t", privacy.people_exchanged(F.col("t"), F.col("people"))).collect()} == cases
    assert df.select(privacy.people_exchanged(F.col("t"), F.slice("people", 4, 2))).first()[0] == "ada and ADA LOVELACE, Adam"


# ---------------------------------------------------------------- backfills
def test_backfills_twice(spark):
    now, day = datetime(2026, 1, 1), lambda n: datetime(2025, 1, n)
    stages = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "b", 2), (3, 1, "offer_declined", 3), (4, 2, "a", 1), (5, 2, "withdrawn", 2)], "id int, job_id int, key string, position int")
    added = backfill.with_outcome_stage(stages, "withdrawn", "Withdrawn")
    assert [(r.job_id, r.position) for r in added.collect()] == [(1, 4)]
    stages = stages.unionByName(added.select(F.lit(9).alias("id"), "job_id", "key", "position"))
    assert backfill.with_outcome_stage(stages, "withdrawn", "Withdrawn").count() == 0

    a = spark.createDataFrame([
        (10, 1, "withdrawn", day(1), "active"), (11, 1, "active", day(2), "screening"), (12, 2, "hired", None, None), (13, 1, "active", day(3), "interviewing"), (14, 1, "hired", day(4), "hired"),
        (15, 1, "rejected", day(5), "active"), (16, 2, "active", None, "withdrawn"), (17, 3, "active", day(6), "active"), (18, 1, None, day(7), "odd"),
    ], "id int, job_id int, status string, applied_at timestamp, candidate_status string")
    rows = spark.createDataFrame([(10, 1, day(8)), (10, 2, day(9)), (11, 1, None), (12, 4, None)], "application_id int, stage_id int, completed_at timestamp")
    new = backfill.outcome_rows(a, stages, rows, "withdrawn", now)
    assert {tuple(r) for r in new.collect()} == {(10, 9, "passed", day(9), day(9)), (11, 9, "pending", None, None), (12, 5, "skipped", None, now)}
    rows = rows.unionByName(new.select("application_id", "stage_id", "completed_at"))
    assert backfill.outcome_rows(a, stages, rows, "withdrawn", now).count() == 0

    new = backfill.snapshot_rows(a, stages, rows)
    got = {}
    for r in new.orderBy("application_id", "stage_id").collect():
        got.setdefault((r.application_id, r.application_status), []).append((r.stage_id, r.status))
    assert got == {
        (13, "active"): [(1, "passed"), (2, "passed"), (3, "passed"), (9, "in_progress")], (14, "hired"): [(1, "passed"), (2, "passed"), (3, "skipped"), (9, "passed")],
        (15, "rejected"): [(1, "passed"), (2, "failed"), (3, "skipped"), (9, "skipped")], (16, "withdrawn"): [(4, "passed"), (5, "skipped")],
        (18, "active"): [(1, "in_progress"), (2, "pending"), (3, "pending"), (9, "pending")],
    }
    assert backfill.snapshot_rows(a, stages, rows.unionByName(new.select("application_id", "stage_id", "completed_at"))).count() == 0


# ---------------------------------------------------------------- streams
def test_quota_over_runs(spark, tmp_path):
    def arrive(name, rows):
        spark.createDataFrame([(i, u, datetime.fromisoformat(t)) for i, u, t in rows], "event_id int, who string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        stream = audit.daily_quota(audit.once(runs.arriving(spark, f"{tmp_path}/in", "ts"), "event_id", "ts", "1 day"), "who", "ts", 2, late=None)
        found = runs.run(stream.select("who", "day", "n"), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted((r.who, str(r.day), r.n) for r in found.collect())

    arrive("a", [(1, "x", "2025-01-01 01:00"), (2, "x", "2025-01-01 02:00"), (3, "y", "2025-01-01 03:00"), (1, "x", "2025-01-01 01:00")])
    assert go() == []
    # a late but timely row, a repeated one, and rows that move the watermark over the first day
    arrive("b", [(4, "x", "2025-01-01 23:00"), (2, "x", "2025-01-01 02:00"), (5, "y", "2025-01-05 00:00")])
    assert go() == [("x", "2025-01-01", 3)]
    assert go() == [("x", "2025-01-01", 3)]  # nothing new: a restart changes nothing
    # too late to count; another day is over
    arrive("c", [(6, "y", "2025-01-01 05:00"), (7, "y", "2025-01-01 06:00"), (8, "z", "2025-01-05 01:00"), (9, "z", "2025-01-05 02:00"), (10, "z", "2025-01-05 03:00")])
    go()
    arrive("d", [(11, "w", "2025-01-12 00:00")])
    assert go() == [("x", "2025-01-01", 3), ("z", "2025-01-05", 3)]


class _Settings:
    def __init__(self, found):
        self.found = found

    def get(self, *_):
        return self.found


class _Session:
    def __init__(self, master, found=None):
        self.conf, self.sparkContext = _Settings(found), type("Context", (), {"master": master})


def test_folder():
    assert runs.folder(_Session("yarn", "hdfs://x/"), "n").startswith("hdfs://x/n-") and runs.folder(_Session("yarn"), "n", "/shared").startswith("/shared/n-")
    assert runs.folder(_Session("local[2]"), "n").startswith("file://")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            runs.folder(_Session(master), "n")


# ---------------------------------------------------------------- merged documents
def test_merged_documents(spark):
    import json

    stored = {1: '{"skills":["a"],"x":{"b":1,"a":[1,{"z":null}]},"military":null}', 2: None, 3: "[1]", 4: '{"education":[1.5,"é"],"skills":null}', 5: "bad{", 6: '{"military":{"kept":1}}', 7: "", 8: '{"a":' * 60 + "1" + "}" * 60}
    confirmed = {1: '{"skills":["n"],"military":{"r":"c"},"other":5}', 2: '{"military":null,"personal_info":{"name":"A"}}', 3: '{"military":[{"a":1}]}', 4: '{"education":null,"military":"x"}', 7: None, 9: '{"skills":1}'}

    def parsed(text):
        try:
            value = json.loads(text or "")
        except ValueError:
            value = None
        return value if isinstance(value, dict) else {}

    want = {}
    for i, text in stored.items():
        new = {k: v for k, v in parsed(confirmed.get(i)).items() if k in merging.SECTIONS}
        if "military" in new:
            new["military"] = [] if new["military"] is None else new["military"] if isinstance(new["military"], list) else [new["military"]]
        want[i] = (parsed(text) | new, sorted(new))
    side = lambda rows: spark.createDataFrame([(i, t, "clash") for i, t in rows.items()], "id int, document string, old string")
    twice = side(confirmed).unionByName(side({1: ""}))
    got = {r.id: (json.loads(r.document), r.replaced) for r in merging.merged_documents(side(stored), twice, "id").collect()}
    assert got == want
    assert merging.merged_documents(side(stored).limit(0), side(confirmed), "id").count() == 0


def test_each_string_is_searched_once(spark):
    rows = [(f"The Candidate{x} the candidate [email removed] a@b.co [phone removed] 415-555-0142, www.a.b [link removed] [link removed]",) for x in ("", " Ann", " ann's anne")] + [("",), (None,), ("ANN" * 3,), ("Ann-Ann",)]
    df = spark.createDataFrame(rows, "s string")
    for names in (["Ann"], ["the candidate"], None):
        pattern = privacy.names_pattern(F.array(*map(F.lit, names))) if names else F.lit(None).cast("string")
        for r in df.select("s", privacy.scrub(F.col("s"), pattern).alias("x")).collect():
            counts = dict.fromkeys(("names", "emails", "links", "phones"), 0)
            want = r.s
            for key, what, mark in (*([("names", r"(?i)\b" + names[0] + r"\b", V.NAME_GONE)] if names else []), ("emails", V.EMAIL, V.EMAIL_GONE), ("links", V.LINK, V.LINK_GONE), ("phones", V.PHONE, V.PHONE_GONE)):
                want, counts[key] = re.subn(what, mark, want) if want is not None else (None, 0)
            assert r.x is None if r.s is None else (r.x.text, {k: r.x[k] for k in counts}) == (want, counts)
