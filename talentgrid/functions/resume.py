"""Resume text to structure: sections, contact data, education, experience and skills, as one struct per text.

Line rules need the lines around them, so the work is one pandas UDF over a column of texts; all
outputs are plain structs and arrays that Columns take further.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from talentgrid.functions import vocabulary as V

#: Headings of each section (fixed values).
HEADINGS = {
    "experience": ("experience", "work experience", "professional experience", "employment", "employment history", "work history", "career history"),
    "education": ("education", "academic background", "education and training", "qualifications"),
    "skills": ("skills", "technical skills", "core skills", "core competencies", "technologies", "expertise"),
    "summary": ("summary", "professional summary", "profile", "objective", "about", "about me"),
    "projects": ("projects", "personal projects"),
    "certifications": ("certifications", "certificates", "licenses"),
    "military": ("military", "military service", "military experience"),
    "languages": ("languages",),
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{4}|\d{1,2}/\d{4}|\d{4}-\d{2}|\d{4})"
SPAN = re.compile(rf"({DATE})\s*(?:-|–|—|to)\s*({DATE}|present|current|now)", re.I)
PLACE = re.compile(r"\b([A-Z][A-Za-z.]+(?: [A-Z][A-Za-z.]+)*, [A-Z]{2})\b")
SCHOOL = re.compile(r"\b(university|college|institute|school|academy)\b", re.I)
DEGREE = re.compile(r"\b(ph\.?d|doctor|master|bachelor|associate|b\.?s\.?c?|m\.?s\.?c?|b\.?a|m\.?a|mba|b\.?tech|m\.?tech)\b", re.I)
BRANCHES = ("army", "navy", "air force", "marine corps", "marines", "coast guard", "national guard", "space force")
#: What a skill is called in one word, and how it is grouped (fixed values).
SKILL_NAMES = {"js": "JavaScript", "ts": "TypeScript", "py": "Python", "k8s": "Kubernetes", "postgres": "PostgreSQL", "golang": "Go", "ml": "Machine Learning", "nodejs": "Node.js"}
SKILL_GROUPS = {
    "Programming": ("python", "java", "javascript", "typescript", "go", "rust", "scala", "ruby", "php", "c++", "c#", "kotlin", "swift", "r"),
    "Data": ("sql", "postgresql", "mysql", "spark", "hadoop", "kafka", "airflow", "dbt", "snowflake", "pandas", "tableau"),
    "Cloud": ("aws", "gcp", "azure", "docker", "kubernetes", "terraform", "linux", "jenkins"),
    "Machine Learning": ("machine learning", "pytorch", "tensorflow", "scikit-learn", "nlp", "deep learning"),
    "Web": ("react", "angular", "vue", "html", "css", "node.js", "django", "flask"),
    "Soft Skills": ("leadership", "communication", "teamwork", "mentoring", "negotiation"),
}

TEXT = Ty.StringType()
SHAPE = Ty.StructType([
    Ty.StructField("name", TEXT), Ty.StructField("email", TEXT), Ty.StructField("phone", TEXT), Ty.StructField("location", TEXT), Ty.StructField("linkedin", TEXT),
    Ty.StructField("education", Ty.ArrayType(Ty.StructType([Ty.StructField(k, TEXT) for k in ("institution", "degree", "start_date", "end_date")]))),
    Ty.StructField("experience", Ty.ArrayType(Ty.StructType([Ty.StructField(k, TEXT) for k in ("title", "company", "start_date", "end_date", "location", "description")]))),
    Ty.StructField("skills", Ty.ArrayType(TEXT)), Ty.StructField("military", Ty.ArrayType(TEXT)), Ty.StructField("sections", Ty.MapType(TEXT, TEXT)),
])


def heading_of(line: str) -> str | None:
    plain = re.sub(r"[^a-z ]", "", line.lower().strip()).strip()
    return next((name for name, words in HEADINGS.items() if plain in words), None) if len(line) < 50 else None


def sections(text: str) -> dict[str, str]:
    """Section -> its lines; what stands before the first heading is the contact section, and a repeated heading adds to the first."""
    out: dict[str, list[str]] = {"contact": []}
    now = "contact"
    for line in text.splitlines():
        name = heading_of(line)
        if name:
            now = name
            out.setdefault(now, [])
        else:
            out[now].append(line)
    return {k: "\n".join(v).strip() for k, v in out.items()}


def iso_month(s: str | None) -> str | None:
    """yyyy-MM of a date in a span; null for the present."""
    s = (s or "").lower().strip()
    year = re.search(r"(19|20)\d{2}", s)
    if not year:
        return None
    month = next((k for k, m in enumerate(MONTHS, 1) if s.startswith(m)), None)
    number = re.match(r"(\d{1,2})/\d{4}$", s) or re.match(r"\d{4}-(\d{2})$", s)
    return f"{year[0]}-{month or (int(number[1]) if number else 1):02d}"


def skill_name(raw: str) -> str:
    low = raw.strip().lower()
    return SKILL_NAMES.get(low) or (raw.strip().upper() if len(low) <= 4 and low.isalpha() and not re.search("[aeiou]", low[1:3]) else raw.strip())


def skill_group(skill: str) -> str:
    low = skill.lower().strip()
    exact = next((g for g, words in SKILL_GROUPS.items() if low in words), None)
    return exact or next((g for g, words in SKILL_GROUPS.items() if any(w in low for w in words if len(w) > 3)), "Other")


def parse_one(text: str | None) -> dict:
    text = text or ""
    found = sections(text)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    first = lambda p, s: (m[0] if (m := re.search(p, s)) else None)
    head = "\n".join(lines[:20])
    place = PLACE.search(head)
    name = next((x for x in lines[:5] if re.fullmatch(r"[A-Z][\w'.-]+(?: [A-Z][\w'.-]*){1,3}", x) and not heading_of(x)), None)
    jobs, schools = [], []
    block: dict | None = None
    previous = ""
    for line in (x.strip() for x in found.get("experience", "").splitlines()):
        span = SPAN.search(line)
        if span:
            rest = (line[: span.start()] + line[span.end() :]).strip(" |,-–—()") or previous
            title, _, company = (p.strip() for p in re.sub(r"\s+(?:at|@|\||-|–|—)\s+", "\0", rest, count=1).partition("\0"))
            at = PLACE.search(rest)
            block = {"title": title, "company": (company.replace(at[1], "") if at else company).strip(" |,-") or None, "start_date": iso_month(span[1]), "end_date": iso_month(span[2]), "location": at[1] if at else None, "description": ""}
            jobs.append(block)
        elif block is not None and line:
            block["description"] = (block["description"] + "\n" + re.sub(r"^[•*\-·]\s*", "", line)).strip()
        previous = line or previous
    rows = [x.strip() for x in found.get("education", "").splitlines() if x.strip()]
    for k, line in enumerate(rows):
        if DEGREE.search(line):
            near = [line, *rows[k + 1 : k + 2], *rows[max(0, k - 1) : k]]
            school = next((re.split(r"\s+[|–—-]\s+|, (?=[A-Z]{2}\b)", x)[0] for x in near if SCHOOL.search(x)), None)
            span = next((m for x in near if (m := SPAN.search(x))), None)
            schools.append({"institution": school, "degree": re.split(r",|\s[|–—-]\s", line)[0].strip(), "start_date": iso_month(span[1]) if span else None, "end_date": iso_month(span[2]) if span else None})
    skills = [skill_name(s) for s in re.split(r"[,;|•\n]", re.sub(r"(?m)^[^:\n]{1,30}:", "", found.get("skills", ""))) if 1 < len(s.strip()) <= 40]
    linkedin = first(r"(?i)linkedin\.com/in/[\w-]+", text)
    return {
        "name": name, "email": first(V.EMAIL, text), "phone": first(V.PHONE, text), "location": place[1] if place else None, "linkedin": linkedin,
        "education": schools, "experience": jobs, "skills": sorted(dict.fromkeys(skills)), "military": [b for b in BRANCHES if b in found.get("military", "").lower()], "sections": found,
    }


@F.pandas_udf(SHAPE)
def parsed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_one(t) for t in texts], columns=SHAPE.fieldNames())


@F.pandas_udf(TEXT)
def skill_groups(skills: pd.Series) -> pd.Series:
    return skills.map(lambda s: skill_group(s or ""))


# ---------------------------------------------------------------- names and documents in answers
def cased_name(c: Column) -> Column:
    """A name in title case; parts after an apostrophe or Mc are capital too, numerals stay capitals."""
    words = F.transform(F.split(F.initcap(F.lower(F.trim(c))), " "), lambda w: F.when(F.lower(w).isin("ii", "iii", "iv"), F.upper(w)).otherwise(w))
    joined = F.array_join(words, " ")
    for lead in ("Mc", "O'"):
        for letter in "abcdefghijklmnopqrstuvwxyz":
            joined = F.replace(joined, F.lit(lead + letter), F.lit(lead + letter.upper()))
    return joined


def json_object(text: str | None) -> str | None:
    """The longest JSON object in a text, fences and trailing commas put right; null where there is none."""
    text = re.sub(r"```(?:json)?", "", text or "")
    best = None
    for at in (m.start() for m in re.finditer(r"\{", text)):
        depth, quoted, escaped = 0, False, False
        for k in range(at, len(text)):
            ch = text[k]
            if quoted:
                escaped, quoted = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
            elif ch == '"':
                quoted = True
            else:
                depth += (ch == "{") - (ch == "}")
                if not depth:
                    body = re.sub(r",\s*([}\]])", r"\1", text[at : k + 1])
                    try:
                        json.loads(body)
                    except ValueError:
                        break
                    best = body if best is None or len(body) > len(best) else best
                    break
        if best and len(best) > len(text) - at:
            break
    return best


@F.pandas_udf(TEXT)
def json_objects(texts: pd.Series) -> pd.Series:
    return texts.map(json_object)
