"""Sections and blocks of texts against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from talentgrid.functions import sections as S
from talentgrid.sources.tables import table


def plain_type(heading):
    return next((n for n, words in S.SECTION_WORDS.items() if any(w in heading.lower() for w in words)), S.GENERAL)


def plain_sections(text):
    if not text:
        return {"general": ""}
    clean = re.sub(r" {2,}", " ", re.sub(r"\r\n|\r", "\n", text.replace("\0", " ")))
    clean = re.sub(rf"^({S.CAPITAL_HEADINGS})\s*$", r"## \1", clean, flags=re.M)
    lines, found, seen = clean.split("\n"), [], set()
    for i, line in enumerate(lines):
        plain = re.match(r"(?i)\s*(" + "|".join(sorted(S.PLAIN_HEADINGS, key=len, reverse=True)) + r")\s*[:\-–—]*\s*$", line)
        kind, rest = (plain_type(plain[1]) if plain else None), ""
        for name, pattern in S.MARKED_HEADINGS.items():
            if not kind and (m := re.match(rf"(?i)\s*##\s*(?:{pattern})(?:\s*:|\s*$)", line)):
                kind, rest = name, line[m.end() :]
        if kind and kind not in seen:
            seen.add(kind)
            found.append((i, kind, rest))
    out = {}
    for (i, kind, rest), stop in zip(found, [f[0] for f in found[1:]] + [len(lines)]):
        if content := "\n".join([rest, *lines[i + 1 : stop]]).strip():
            out[kind] = content
    if not out:
        now, held = S.GENERAL, []
        for line in filter(None, map(str.strip, lines)):
            if (line.isupper() and 3 <= len(line) <= 50) or (len(line) <= 50 and any(w in line.lower() for w in S.LOOSE_WORDS)):
                if held:
                    out[now] = "\n".join(held)
                now, held = plain_type(line), []
            else:
                held.append(line)
        if held:
            out[now] = "\n".join(held)
    if sum(bool(re.search(p, out.get("summary", ""))) for p in S.CONTACT_SIGNS) >= 2:
        out["contact"] = out.pop("summary")
        for p in S.SUMMARY_LIKE:
            if (m := re.search(p, text)) and len(m[1].strip()) > 50:
                out["summary"] = m[1].strip()
                break
    return out | {"full_text": text}


def plain_blocks(text):
    out, now = {}, None
    for line in (text or "").splitlines():
        name = next((n for n, p in S.BLOCK_HEADINGS.items() if re.match(p, line)), None)
        if name:
            now = name
            out.setdefault(now, [])
        elif now:
            out[now].append(line)
    return {k: "\n".join(v) for k, v in out.items()}


CASES = [
    None, "", "\n", "no headings at all\nin two lines",
    "Jane Doe\njane@x.com\n\nSUMMARY\nBuilds things.\n\nWork Experience:\nAcme  Corp\n2019 - 2021\n\n## SKILLS: Python, SQL\nmore\n EDUCATION \nMIT\nskills\nrepeated is content",
    "## Professional Summary\nCall 415-555-0142 or a@b.com, linkedin.com/in/x\n## Profile\nStrategic leader with more than ten years of experience in building and running teams.\n## Experience\nx",
    "SUMMARY\n415.555.0142 me@here.org\nEDUCATION\nState",
    "Experienced engineer who has many years of experience in the building of things for people.\nSUMMARY\n4155550142 me@here.org github.com/x\nSKILLS\nall\n## END",
    "MY LIFE\nfirst\nMY EDUCATION\nschool\nOTHER PLACES\nsecond\nwork skills i have\nthird\n\nÉCOLE\nquatre",
    "HEADER ONLY", "## EXPERIENCE\n## EDUCATION\n\nCONTACT\nsomewhere\nContact\nhere", "a\r\nSkills —\r\nb\rLanguages\r\n\x00c", "Skills and tools\nx\n\tEmployment history\ny\nSKILL\nz\n\nArmed forces of the state\nw\n",
    "education\neducation\n", "EXPERIENCE\n" + "line of a very long text\n" * 3000 + "Skills\n" + "y\n" * 10,
]


@pytest.mark.parametrize("f, plain", [(S.sections, plain_sections), (S.blocks, plain_blocks)])
def test_cases(spark, f, plain):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, text string")
    for r in df.select("i", f(F.col("text")).alias("found")).collect():
        assert r.found == plain(CASES[r.i]), r.i


def test_of_tables(spark):
    from talentgrid import bindings_text as B

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in B.resumes(spark, d).collect()}
    assert len(texts) == table(spark, d, "documents").count()
    for name, plain in (("document_sections", plain_sections), ("document_blocks", plain_blocks)):
        got = {}
        for r in B.QUERIES[name](spark, d).collect():
            got.setdefault(r.doc_id, {})[r.section] = r.content
        assert got == {i: w for i, w in ((i, plain(t)) for i, t in texts.items()) if w}
        assert sum(len(v) > 2 for v in got.values()) > 50


def test_page_sections(spark):
    from talentgrid import bindings_text as B
    from talentgrid.sources import pages as P

    d = "/root/testdata/sf0.001"
    texts = {r.page_id: r.text for r in P.page_texts(table(spark, d, "pages")).collect()}
    got = {}
    for r in B.QUERIES["page_sections"](spark, d).collect():
        got.setdefault(r.page_id, {})[r.section] = r.content
    assert got == {i: {k: v for k, v in plain_sections(t).items() if k != "full_text"} for i, t in texts.items() if set(plain_sections(t)) - {"full_text"}}
