"""Comparable jobs, near matches and alignment against plain versions."""

import difflib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentgrid.functions import vocabulary as V
from talentgrid.operators import market, nearmatch


# ---------------------------------------------------------------- near matches
@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=24), st.lists(st.tuples(st.integers(0, 23), st.sampled_from(["", "a", "c", "x"])), max_size=4))
def test_near_strings_share_a_key(text, edits):
    other = text
    for at, put in edits:
        other = other[:at] + put + other[at + 1 :]
    if other and nearmatch.ratio(other, text) >= nearmatch.LEAST:
        assert nearmatch.keys(text, nearmatch.LEAST) & nearmatch.keys(other, nearmatch.LEAST)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdeé", min_size=1, max_size=14), st.lists(st.tuples(st.integers(0, 14), st.sampled_from("abz")), max_size=2))
def test_near_strings_have_like_marks(text, edits):
    other = text
    for at, c in edits:
        other = other[:at] + c + other[at + 1 :]
    bits = bin((nearmatch.mark(text) ^ nearmatch.mark(other)) & (1 << 64) - 1).count("1")
    same = 2 * sum((Counter(text) & Counter(other)).values())
    assert bits <= len(text) + len(other) - same
    if nearmatch.ratio(other, text) >= nearmatch.LEAST:
        assert bits <= (1 - nearmatch.LEAST) * (len(text) + len(other)) + 1e-9


def test_unlike_strings_leave_the_join(spark):
    """All share a gram and a length; the join itself drops them, before pairs are made distinct."""
    texts = spark.createDataFrame([(f"abc{'defghijk'[i:]}{'qrstuvwx'[:i]}",) for i in range(9)], "text string")
    found = nearmatch.near_matches(texts, spark.createDataFrame([("abcdefghijk",)], "entry string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join " in line)
    assert "bit_count" in join and {r.text for r in found.collect()} == {"abcdefghijk", "abcefghijkq"}


def test_near_matches(spark):
    texts = ["machine learning", "machine-learning", "machin lerning", "kubernetes", "kubernets", "sql", "sq", "a", "", None, "postgre sql", "abcdefg", "abcdefgh" * 40]
    entries = ["machine learning", "kubernetes", "sql", "a", "postgresql", "bcdefga", "abcdefg", "abcdefgh" * 38, "", None, "machine learning"]
    got = {(r.text, r.entry): r.ratio for r in nearmatch.near_matches(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(e,) for e in entries], "entry string")).collect()}
    want = {(t, e): nearmatch.ratio(e, t) for t in texts if t for e in entries if e}
    assert got == {k: v for k, v in want.items() if v >= nearmatch.LEAST}
    assert nearmatch.near_matches(spark.createDataFrame([], "text string"), spark.createDataFrame([], "entry string")).count() == 0


# ---------------------------------------------------------------- comparable jobs
def plain_comparable(jobs, wanted, least, limit):
    words = lambda t: {w for w in re.split(r"[^\w+#]+|_", (t or "").lower()) if w}
    out = set()
    for w, title in wanted:
        own, found = words(title), []
        for j, t in dict(jobs).items():
            other = words(t)
            if own and other and len(own & other) >= least * len(own | other) - 1e-9:
                found.append((-len(own & other) / len(own | other), j))
        out |= {(w, j, round(-s, 9), k + 1) for k, (s, j) in enumerate(sorted(found)[:limit])}
    return out


def test_comparable_jobs(spark):
    names = ["data engineer", "Senior Data Engineer", "engineer (data)", "data scientist", "store manager", "manager", "C++ developer", "c developer", None, "--", "data data engineer", "ingénieur data"]
    jobs = [(i, names[i % len(names)]) for i in range(200)] + [(i, "data engineer") for i in range(300, 400)]  # one title has a third of all jobs
    wanted = [(k, n) for k, n in enumerate([*names, "unknown words"])] + [(99, "data engineer")]
    df, asked = spark.createDataFrame(jobs, "job_id int, title string"), spark.createDataFrame(wanted, "wanted_id int, title string")
    for least in (0.5, 0.6, 1.0):
        got = {(r.wanted_id, r.job_id, round(r.similarity, 9), r.place) for r in market.comparable_jobs(df, asked, least).collect()}
        assert got == plain_comparable(jobs, wanted, least, market.COMPARABLE)
    assert market.comparable_jobs(df.limit(0), asked).count() == market.comparable_jobs(df, asked.limit(0)).count() == 0


def test_market_of(spark):
    comparable = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12)], "wanted_id int, job_id int")
    skills = spark.createDataFrame([(10, "SQL"), (10, "sql "), (10, "Power  BI!"), (11, "sql"), (11, "R"), (11, "dbt"), (11, "go"), (12, "x"), (12, None), (12, "?")], "job_id int, skill string")
    ranked = {(r.wanted_id, r.skill): (r.jobs, r.place) for r in market.market_skills(comparable, skills).collect()}
    assert ranked[1, "sql"] == (2, 1) and ranked[1, "r"] == (1, 2) and ranked[1, "go"] == (1, 3) and ranked[1, "power bi"] == (1, 5) and (3, "") not in ranked
    wanted = spark.createDataFrame([(1, "analyst"), (2, "Data Analyst"), (4, None)], "wanted_id int, title string")
    got = {r.wanted_id: r.skills for r in market.market_of(wanted, comparable, skills).collect()}
    assert got[1] == ["sql", "r", "go", "dbt", "power bi"] and got[2] == list(V.ROLE_SKILLS[2][1]) and got[4] == list(V.ROLE_SKILLS[3][1])


# ---------------------------------------------------------------- alignment
def plain_alignment(title, skills, text, listed):
    def canonical(s):
        s = re.sub(r"\s+", " ", re.sub(r"[./,+_]+", " ", (s or "").lower())).strip()
        return V.SKILL_NAMES.get(s, s)

    asked = list(dict.fromkeys(c for c in map(canonical, listed or []) if c))[:30]
    whole = lambda p, s: re.search(r"(?<![a-z0-9])(?:" + p + r")(?![a-z0-9])", s) is not None
    own, expanded = {c for c in map(canonical, skills or []) if c}, set()
    for s in skills or []:
        for part in filter(None, (p.strip() for p in re.split(V.SKILL_BREAKS, canonical(s)))):
            expanded |= {m for m in asked if whole(re.escape(m), part)} | set(difflib.get_close_matches(part, asked, n=1, cutoff=0.85))
    own, text = expanded or own, canonical(text)
    for m in asked:
        words = [re.escape(w) for w in re.split(r"[/\-\s_]+", m) if w] or [re.escape(m)]
        if whole(r"[\s\-/_]+".join(words) + "s?|" + "".join(words) + "s?", text) or (m in V.SKILLS_IN_TEXT and re.search(V.SKILLS_IN_TEXT[m], text)):
            own = own | {m}
    own = own | {m for m in asked if m in V.SKILL_ALIASES and any(re.search(V.SKILL_ALIASES[m], s) for s in own)}
    both = own & set(asked)
    share = len(both) / max(1, len(own | set(asked)))
    if re.search(r"(?i)\b(" + "|".join(V.AI_WORDS) + r")\b", title):
        share += min(0.3, 0.1 * len(both & set(V.CORE_AI_SKILLS)))
    return sorted(asked), sorted(own), sorted(both), sorted(set(asked) - own), min(1.0, share)


def test_alignment(spark):
    markets = {
        "ML engineer": ["Python", "machine learning", "K8s", "CI/CD", "rest-api", "sql", "Node.js", "computer vision", "python", "", None],
        "Data Analyst": ["SQL", "Power BI", "Excel", "statistics", "tableau", "postgres"],
        "Gen AI lead": list(V.ROLE_SKILLS[0][1]),
        "Nothing": [],
        "Unknown": None,
    }
    people = {
        1: (["Python and SQL", "hands-on with Kubernets", "kubernetess", "REST"], "Built CI-CD pipelines; used node js and power-bis."),
        2: (["Excell", "Tableu", "Statistic", "cooking"], None),
        3: ([], "Machine Learning with PyTorch on GitHub, GCP. cicd"),
        4: (None, ""),
        5: (["C\\E(", "GitHub Actions", "MySQL", "RESTful services", "deep learning for computer vision", ""], "x" * 5000 + " excels"),
        6: (["restful api"] * 50, "sql server " * 300),
    }
    candidates = spark.createDataFrame([(i, s, t, "clash") for i, (s, t) in people.items()], "candidate_id int, skills array<string>, text string, title string")
    df = spark.createDataFrame([(t, s) for t, s in markets.items()], "title string, skills array<string>")
    pairs = candidates.select("candidate_id").crossJoin(df.select("title"))
    got = {(r.candidate_id, r.title): r for r in market.aligned(pairs.unionByName(pairs), candidates, df).collect()}
    assert len(got) == len(people) * len(markets)
    for (i, title), r in got.items():
        want = plain_alignment(title, *people[i], markets[title])
        assert (r.market_skills, r.candidate_skills, r.matching_skills, r.missing_skills) == want[:4], (i, title)
        assert abs(r.overlap_ratio - want[4]) <= 5.1e-5
    assert got[1, "ML engineer"].matching_skills == ["ci/cd", "kubernetes", "python", "rest api", "sql"]
    assert got[2, "Data Analyst"].matching_skills == ["excel", "statistics", "tableau"]
    assert market.aligned(pairs.limit(0), candidates, df).count() == 0


def test_alignment_of_tables(spark):
    from talentgrid import bindings_market as B

    d = "/root/testdata/sf0.001"
    people = {r.candidate_id: (r.skills, r.text) for r in B.market_candidates(spark, d).collect()}
    wanted = B.titles(spark, d)
    lists = {r.wanted_id: r.skills for r in market.market_of(wanted, market.comparable_jobs(B.jobs(spark, d), wanted), B.job_skills(spark, d)).collect()}
    rows = B.market_alignment(spark, d).collect()
    assert len(rows) > 500
    for r in rows:
        want = plain_alignment(r.title, *people[r.candidate_id], lists[r.title])
        assert (r.market_skills, r.candidate_skills, r.matching_skills, r.missing_skills) == tuple(", ".join(x) for x in want[:4])
        assert abs(r.overlap_ratio - want[4]) <= 5.1e-5


def test_near_terms_of_tables(spark):
    from talentgrid.bindings import QUERIES
    from talentgrid.sources.tables import table

    d = "/root/testdata/sf0.001"
    words = lambda t: set(re.findall(r"[^\W\d_]{8,}", (t or "").lower()))
    docs = [words(r.text) for r in table(spark, d, "documents").collect()]
    terms = set().union(*[words(r.text) for r in table(spark, d, "benchmark").collect()])
    want = {(t, w) for w in set().union(*docs) for t in difflib.get_close_matches(w, terms, n=len(terms), cutoff=0.85)}
    got = QUERIES["near_terms"](spark, d).collect()
    assert len(got) == len(want) and {(r.term, r.spelling) for r in got} == want
    assert all(r.documents == sum(r.spelling in own for own in docs) for r in got)


def test_patterns_are_made_only_where_their_string_is(spark):
    from talentgrid.operators import market

    asked = spark.createDataFrame([(1, "t")], "candidate_id int, title string")
    people = spark.createDataFrame([(1, ["machine tools", "c plus"], "we dye blue - green, and red.")], "candidate_id int, skills array<string>, text string")
    wanted = spark.createDataFrame([("t", ["machine", "blue green", "achin", "rust"])], "title string, skills array<string>")
    found = market.aligned(asked, people, wanted).first()
    assert found.matching_skills == ["blue green", "machine"] and found.missing_skills == ["achin", "rust"]
    words = spark.createDataFrame([("node-js",), ("- ",)], "s string").select(market.words_of(F.col("s")))
    assert [r[0] for r in words.collect()] == [["node", "js"], ["- "]]


def test_texts_and_pieces_meet_no_title(spark):
    """A candidate's text and pieces go through no join that also carries titles, so they aren't multiplied by these."""
    asked = spark.createDataFrame([(1, "t"), (1, "u"), (2, "t"), (2, "u")], "candidate_id int, title string")
    people = spark.createDataFrame([(1, ["rust and go"], "rust, and blue-green"), (2, ["bakng"], "rust")], "candidate_id int, skills array<string>, text string")
    wanted = spark.createDataFrame([("t", ["rust", "blue green"]), ("u", ["baking", "go"])], "title string, skills array<string>")
    found = market.aligned(asked, people, wanted)

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    joins = [n for n in nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    names = [{n.output().apply(i).name() for i in range(n.output().size())} for n in joins]
    assert names and not any("title" in own and own & {"text", "haystack", "skills", "parts", "part"} for own in names)
    got = sorted((r.candidate_id, r.title, r.matching_skills) for r in found.collect())
    assert got == [(1, "t", ["blue green", "rust"]), (1, "u", ["go"]), (2, "t", ["rust"]), (2, "u", ["baking"])]
