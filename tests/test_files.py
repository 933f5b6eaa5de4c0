"""Files, education and small helpers against plain versions."""

import io
import re
import zipfile

from pyspark.sql import functions as F

from talentgrid.functions import education as E
from talentgrid.functions import resume
from talentgrid.operators import search
from talentgrid.sources import office, tables

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs, header=None):
    body = "".join(f"<w:p><w:r>{''.join(f'<w:t>{t}</w:t>' if t not in ('TAB', 'BR') else f'<w:{t.lower()}/>' for t in p)}</w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
        if header:
            z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{WORD}"><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>')
    return out.getvalue()


def test_texts_of_files(spark, tmp_path):
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("a.txt", "x")
    files = {
        "a.docx": docx([["Ann", " &amp; Zoë"], ["x", "TAB", "y", "BR", "z"], []], "Page head"), "b.txt": "café\n".encode() + b"\xff ok", "c.pdf": b"%PDF-1.7 x", "d.pdf": b"nothing", "e.pdf": b"",
        "f.docx": b"PK broken", "g.docx": other.getvalue(), "h.doc": b"\xd0\xcf", "i.exe": b"MZ", "j.docx": docx([]), "k.docx": b"",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    assert office.docx_text(b"") is None and office.docx_text(None) is None
    got = {r.path.rpartition("/")[2]: r for r in office.resume_texts(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Page head\n\nAnn & Zoë\n\nx\ty\nz" and got["a.docx"].message is None
    assert not {"e.pdf", "k.docx"} & set(got)  # no bytes, no row
    assert got["b.txt"].text == "café\n ok" and got["j.docx"].text == "" and got["j.docx"].message is None
    assert {n for n, r in got.items() if r.message == "not a readable document"} == {"f.docx", "g.docx"}
    assert {n for n, r in got.items() if r.message == "needs a converter"} == {"c.pdf", "d.pdf", "h.doc"} and got["i.exe"].message == "unsupported file type"
    pdfs = {r.path.rpartition("/")[2]: (r.ok, r.message) for r in tables.checked_pdfs(spark, str(tmp_path / "*.pdf")).collect()}
    assert pdfs == {"c.pdf": (True, "ok"), "d.pdf": (False, "not a PDF")}


def plain_education(text):
    text = text or ""
    head = re.search(E.HEADING, text, re.I)
    if head:
        rest = text[head.end() :]
        end = re.search(E.NEXT_HEADING, rest, re.M)
        text = rest[: end.start()] if end else rest
    lines = [x.strip() for x in re.split(r"\r\n|[\n\r]", text.strip(" "))]
    out = {}
    for one, after in zip(lines, [*lines[1:], ""]):
        s, d, s2, d2 = (re.search(p, x, re.I) for x in (one, after) for p in (E.SCHOOL, E.DEGREE))
        use = (s, d) if s and d else (s2, d) if d and s2 else (s, d2) if s and d2 else None
        if use:
            at, degree = re.sub(E.PLACE, "", use[0][0].strip()).strip(), use[1][0].strip()
            if at:
                out.setdefault((at.lower(), degree.lower()), (at, degree))
    return list(out.values())


def test_education_equals_plain_version(spark):
    texts = [
        None, "", "   ", "Education:\nB.S. Physics, Stanford University - San Jose\nUniversity of California, Berkeley\nPhD\n\nEXPERIENCE\nMaster at Other College",
        "Work\nMBA, MIT\nmba, mit\r\nBachelor's\r\nSome (Old) School of Art | New York", "no heading here\nDiploma\nnothing\nAcademy", "EDUCATION\n\nMaster\n\nKing's College London\n", "Zoë's Université College\nM.A. ",
        "Qualifications - Certificate, Uni\nSKILLS & MORE\nB.A. UCLA", "education " * 50 + "\nMIT PhD" + "\nNYU\nM.S." * 3,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: [tuple(e) for e in r.e] for r in docs.select("k", E.entries(F.col("text")).alias("e")).collect()}
    assert got == {k: plain_education(t) for k, t in enumerate(texts)}
    assert got[3][0][1] == "B.S" and len(got[4]) == 2
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: [tuple(e) for e in r.e] for r in small.select("doc_id", E.entries(F.col("text")).alias("e")).collect()}
    assert found == {r.doc_id: plain_education(r.text) for r in small.collect()}


def test_groups_and_order_by_fit(spark):
    skills = spark.createDataFrame([("Python",), (" sql ",), ("Apache Spark 3",), ("Team leadership",), ("cooking",), (None,), ("",)], "s string")
    assert [r[0] for r in skills.select(resume.skill_groups("s")).collect()] == ["Programming", "Data", "Data", "Soft Skills", "Other", "Other", "Other"]
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0), (4, 5.0)], "id int, score double")
    assert [r.id for r in search.by_fit(rows, "score", "id").collect()] == [3, 1, 4, 2]
    assert [r.id for r in search.by_fit(rows, "score", "id", descending=False).collect()] == [1, 4, 3, 2]
