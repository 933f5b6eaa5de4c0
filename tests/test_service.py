"""Service entries against a plain version."""

import re

from talentgrid.functions import service as S
from talentgrid.sources.tables import table


def named(text, names):
    return next((n for n, p in names.items() if re.search(p, text, re.I)), None)


def matches(text, patterns):
    return [m[0] for p in patterns if (m := re.search(p, text, re.I))]


def distinct(items):
    out = {}
    for x in items:
        if x.strip():
            out.setdefault(x.strip().lower(), x.strip())
    return list(out.values())


def year(s):
    s = (s or "").strip()
    found = re.search(r"\d{4}", s)
    return "Present" if s.lower() in ("present", "current", "now") else found[0] if found else s.lower() or None


def plain_entry(b):
    dates = next((m for p in S.DATES if (m := re.search(p, b, re.I))), None)
    unit = re.search(S.UNIT, b)
    place = named(b, {n: rf"\b{n}\b" for n in S.BASES}) or next((m[1] for p in (r"\b([A-Z][a-z]+,\s*[A-Z]{2})\b", r"\b([A-Z][a-z]+\s+[A-Z]{2})\b") if (m := re.search(p, b))), None)
    tasks = [t.strip() for t in re.findall(r"(?m)^(?:[-•*]\s+|\d+\.\s+)(.+)$", b) if len(t.strip()) > 3]
    clear = [re.sub("(?i)" + p, to, x) for x in matches(b, S.CLEARANCES) for p, to in ((r"ts\s*/\s*sci|(?!)", "TS/SCI"),)]
    clear = [re.sub(r"(?i)public\s*trust", "Public Trust", re.sub(r"(?i)top\s*secret", "Top Secret", x)) for x in clear]
    e = {
        "branch": named(b, S.BRANCHES), "rank": named(b, S.RANKS), "unit": unit[1].strip() if unit else None, "start_date": year(dates[1]) if dates else None, "end_date": year(dates[2]) if dates else None, "location": place,
        "responsibilities": distinct(tasks), "deployments": distinct(re.findall(S.DEPLOYED, b, re.I)), "awards": distinct(matches(b, S.AWARDS)), "clearances": distinct(clear),
        "training": distinct(re.findall(r"\b\d{2}[A-Z]{1,2}\b", b) + matches(b, S.TRAINING)),
    }
    points = 40 * bool(e["branch"]) + 20 * bool(e["rank"]) + 20 * bool(dates) + 10 * (len(e["responsibilities"]) > 1) + 10 * bool(unit) + 5 * bool(e["clearances"]) + 5 * bool(e["awards"])
    return e | {"confidence": min(100, points) / 100}


def plain(text):
    text = text or ""
    parts, inside, blocks = [p.strip() for p in re.split(r"\n\s*\n", text)], False, []
    for p in parts:
        opens = re.search(S.HEADING, p, re.I) and not re.match(r"^[A-Z\s]{3,40}\s*\d{1,3}$", p)
        inside = True if opens else False if re.search(r"(?m)^\s*[A-Z][A-Z\s&]{3,}$", p) else inside
        if inside:
            blocks.append(p[re.search(S.HEADING, p, re.I).end() :].strip() if opens else p)
    long = lambda bs: [b for b in bs if len(b) > S.SHORTEST_BLOCK]
    accepted = lambda bs: [e for e in map(plain_entry, bs) if e["confidence"] >= S.ACCEPTED]
    found = accepted(long(blocks) or long(parts))
    found = found or accepted([x.strip() for x in re.split(r"\r\n|[\n\r]", text) if named(x, S.BRANCHES) and named(x, S.RANKS)]) or (accepted([text]) if text else [])
    out = {}
    for e in found:
        out.setdefault(tuple((e[k] or "").lower() for k in ("branch", "unit", "start_date", "end_date")), e)
    return list(out.values())


CASES = [
    None, "", "nothing of the kind in here", "MILITARY SERVICE\nU.S. Army, Sergeant\nJan 2003 – Mar 2007\nFort Bragg\n- led a team of nine\n- kept the stores\n82nd Airborne Division\nTS / SCI and top  secret, medal, Medal",
    "Summary of a life\n\nUSMC captain 2001-2005, Columbus, OH\n\nusmc CAPTAIN 2001 - 2005\n\nNavy 11B 11B airborne", "short\nUSN sgt\nx", "CONTENTS SERVICE 12\n\nEDUCATION\nthe army of one 1999 to now",
    "Active duty: Space Force colonel, deployed to Guam; operation blue sky. 1. did this and that\n\nOTHER THINGS\n\nArmy general 2000 - present", "army " * 3000, "Training\r\nnavy seal\r\n\r\nColumbus OH\r\n", "Military record 5\n\nguard duty of the night 2010-05 — 2011-06\n* aaaa\n* AAAA\n* bbbb",
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(CASES)], "doc_id int, text string, entries string")
    got = {r.doc_id: [e.asDict() for e in r.entries] for r in S.service_entries(df).collect()}
    for i, text in enumerate(CASES):
        assert got[i] == plain(text), (i, text)
    assert [len(got[i]) for i in range(5)] == [0, 0, 0, 1, 2] and got[3][0]["confidence"] == 1.0
    assert S.service_entries(df.limit(0)).count() == 0


def test_of_tables(spark):
    from talentgrid import bindings_text as B

    d = "/root/testdata/sf0.001"
    want = {}
    for r in B.served(spark, d).collect():
        for k, e in enumerate(plain(r.text)):
            want[r.doc_id, k] = {n: "|".join(v) if isinstance(v, list) else v for n, v in e.items()}
    got = {(r.doc_id, r.place): {k: v for k, v in r.asDict().items() if k not in ("doc_id", "place")} for r in B.QUERIES["service_entries"](spark, d).collect()}
    assert got == want and len(got) > table(spark, d, "documents").count() / 2


def test_entries_are_computed_once(spark):
    from talentgrid import bindings_text as B

    plan = B.QUERIES["service_entries"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("Generate") :]  # a filter below the rows would run the whole cascade again


def test_patterns_are_only_skipped_where_they_have_no_match(spark):
    """Every character that (?iU) takes for a letter becomes that letter; every alternative of a pattern needs a string of its own."""
    from pyspark.sql import functions as F

    letters = "abcdefghijklmnopqrstuvwxyz"
    chars = spark.createDataFrame([(chr(k),) for k in range(128, 0x20000) if not 0xD800 <= k < 0xE000], "c string")
    taken = chars.select("c", F.array(*[F.when(F.rlike("c", F.lit(f"(?iU)^{x}$")), x) for x in letters]).alias("x"), S.lowered(F.col("c")).alias("low"))
    found = taken.select("c", F.explode("x").alias("x"), "low").where("x IS NOT NULL").collect()
    assert {r.c for r in found} == set("ſKıİ") and all(r.low == r.x for r in found)
    assert S.needed(r"u\.?s\.?\s*army|\busa\b|ts/sci|1st\s+lieutenant|\bFort Bragg\b") == ("army", "usa", "ts/sci", "lieutenant", "fort bragg")
    every = [*S.BRANCHES.values(), *S.RANKS.values(), *S.CLEARANCES, *S.AWARDS, *S.TRAINING]
    assert not any(re.search(r"[(\[{]|\w[?*+{]", re.sub(r"\\.[*+?]?", "", p)) for p in every)  # what ``needed`` takes for granted
    odd = ["uſ army of one, 2001-2003", "NATIONAL İNDUSTRY AİR  FORCE SERİOUS", "marınes TOP ſECRET tſ/sci", "AİRBORNE KEEPERS usmc sgt", "service\n\n  army captain  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id int, text string")
    got = {r.doc_id: [e.branch for e in r.entries] for r in S.service_entries(df).collect()}
    assert got[0] == ["Army"] and got[1] == ["Air Force"] and got[2] == ["Marines"] and got[3] == ["Marines"]


def test_rows_are_dealt_to_tasks(spark):
    """A file's row group of texts is read by one task, but its texts are searched by many."""
    from talentgrid import bindings_text as B

    d = "/root/testdata/sf0.001"
    assert table(spark, d, "documents").rdd.getNumPartitions() == 1 < B.served(spark, d).rdd.getNumPartitions()
    assert "RepartitionByExpression" in B.QUERIES["service_entries"](spark, d)._jdf.queryExecution().optimizedPlan().toString()


def test_equal_names_anywhere(spark):
    """Entries and tasks are there once, the first of equal ones in any case, also in texts of very many."""
    blocks = [f"Army sergeant {1900 + k % 90}-{1990 + k % 7}\n- task {k % 5} one\n- TASK {k % 5} ONE\n- other {k}" for k in range(700)]
    df = spark.createDataFrame([(0, "\n\n".join(["MILITARY SERVICE", *blocks]))], "doc_id int, text string")
    got = [e.asDict() for e in S.service_entries(df).first().entries]
    assert got == plain("\n\n".join(["MILITARY SERVICE", *blocks])) and len(got) == 630
