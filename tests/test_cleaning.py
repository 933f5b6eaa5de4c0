"""Deep cleaning step by step against the same rules run one after the other in Python."""

import re

from pyspark.sql import functions as F

from talentgrid.functions import cleaning as C


def plain(text, deep=True):
    changes = {}
    for name, rules, words in C.STEPS:
        if name == "deep" and not deep:
            continue
        changes[name] = 0
        if text is None:
            continue
        for pattern, put in [*rules, *((rf"(?i)\b{a}\b", b) for a, b in sorted((words or {}).items(), key=lambda w: -len(w[0])))]:
            text_before = text
            put = put.replace(r"\$", "\0").replace("\\\\", "\\")
            text, n = re.subn(pattern, lambda m, put=put: re.sub(r"\$(\d)", lambda g: m[int(g[1])], put).replace("\0", "$"), text)
            changes[name] += n if text != text_before else 0
    return text, changes


CASES = [
    None, "", "nothing to do here", "39.9Minrevenueimpactthroughstrategichires.Developandexecuteenterprise-widetalentacquisitionprograms",
    "Managedendtoend recruitingManager,teamLead at GoogleInc|MicrosoftCorporation", "a\x00b\\u0000c\x07d\ttab", "enterprisewidetalentacquisitionprogramsmaintaining75 of TALENTACQUISITION talentacquisitionprograms",
    "generating12.5Mrevenue and $4 M of $39.9   K,12M in revenue 5Minrevenue", "spendfromapproximately programsthroughstrategic HIRESD", "12Reduced 7Growth ABCDcorp a$5 $x 2019Present 20182020 SeattleWA",
    "MyexperienceWas yoursKillsx\n\n\n \n\r\n•one\n3.Second\r\n  trailing  \n\n", "jo . doe @ example . com  www . house . org linkedin . com / profile / me http . x . edu", "programmanager realTime naïveÉcole élanVital2024",
    "machinelearning-deeplearning_clientfacing CLIENTFACING", "x" * 20_000 + "39.9Min " * 500,
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(CASES)], "doc_id int, text string, cleaned string")
    for deep in (True, False):
        for r in C.cleaned(df, deep=deep).collect():
            assert r.original == CASES[r.doc_id] and (r.cleaned, r.changes.asDict()) == plain(CASES[r.doc_id], deep), r.doc_id
    assert C.cleaned(df.limit(0)).count() == 0


def test_known_result(spark):
    df = spark.createDataFrame([(1, CASES[3])], "doc_id int, text string")
    r = C.cleaned(df).select("cleaned", C.quality(F.col("original"), F.col("cleaned")).alias("q")).first()
    assert r.cleaned.startswith("$39.9M in revenue impact through strategic hires. Develop and execute enterprise")
    assert r.q.revenue_pattern_fixed and r.q.professional_terms_separated and r.q.improvement_score == 55


def test_quality(spark):
    rows = [("a\0" + "b" * 30, "a" + "b" * 30), ("same", "same"), ("one two  three", "one two three"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.q for r in df.select(C.quality(F.col("a"), F.col("b")).alias("q")).collect()]
    assert [q.improvement_score for q in got] == [45, 0, 25, 0] and (got[2].word_count_original, got[2].char_reduction) == (3, 1) and got[3].original_length is None


def test_of_tables(spark):
    from talentgrid import bindings_text as B

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in B.spoiled(spark, d).collect()}
    got = {r.doc_id: r for r in B.QUERIES["clean_report"](spark, d).collect()}
    assert set(got) == set(texts)
    seen = dict.fromkeys(n for n, *_ in C.STEPS)
    for i, text in texts.items():
        clean, changes = plain(text)
        assert {n: got[i][n] for n in changes} == changes and (got[i].original_length, got[i].cleaned_length) == (len(text), len(clean))
        assert (got[i].word_count_original, got[i].word_count_cleaned) == (len(text.split()), len(clean.split()))
        seen = {n: (seen[n] or 0) + changes[n] for n in seen}
    assert all(seen[n] for n in ("financial", "merged", "terms", "phrases", "deep", "normal"))  # merged words are split before companies are looked for


def test_strings_that_rules_need(spark):
    from functools import reduce

    texts = ["DEVELOPandexecute", "BUİLTAND deveſignedand buıltand maİntaıning75", "ſpendfrom Kelvin xſKillſy mysKillsy", "hireſD hİresd", "éskıllsé xskıllsy", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    state = lambda rule: C._ruled(F.struct(F.col("text"), F.lit(0).alias("n"), C.lowered(F.col("text")).alias("low")), *rule, rule[0] in C.NEEDED_LOW, True)
    for rule in [r for _, rules, _ in C.STEPS for r in rules if r[0] in C.NEEDED_LOW]:
        java = C.unicode(rule[0])
        for r in df.select("text", state(rule).alias("s"), F.regexp_replace("text", java, rule[1]).alias("put"), F.regexp_count("text", F.lit(java)).alias("n")).collect():
            assert r.s.text == r.put and (r.text is None or r.s.n == r.n), (rule, r.text)
    odd = spark.range(128, 0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c")).where(F.col("c").rlike("(?iU)^[a-z]$"))
    assert {r.c for r in odd.collect()} == set(C.ALSO_ASCII)
    assert all(reduce(lambda a, b: a + b, [p in t for t in (C.NEEDED, C.NEEDED_LOW)]) < 2 for _, rules, _ in C.STEPS for p, _ in rules)


def test_texts_of_one_row_group_are_many_tasks(spark):
    from talentgrid import bindings_text as B

    assert B.spoiled(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
