"""Deep cleaning of extracted text: an ordered table of rewrite rules folded into Columns, with the changes of each step counted.

A step's rules run one after the other on the text that the rule before left. Each text is bound once and counted only where a
rule changed it: by the growth of the text where every match adds as many characters, else by a second search. A rule that
needs a string runs only on texts that hold it, for finding a string is far cheaper than a pattern. A dictionary of whole words
is one rule: the text is split at its words, and what stands between the pieces is looked up.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.sections import let

# ---------------------------------------------------------------- fixed values: (pattern, replacement), in the order they run; $1 is a group
CHARACTERS = (
    (r"\x00|\\u0000", ""),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
)
FINANCIAL = (
    (r"(?i)39\.9M?in?revenue?impact?through?strategic?(?:hires?|hiring?)", r"\$39.9M in revenue impact through strategic hires"),
    (r"39\.9Minrevenue", r"\$39.9M in revenue"),
    (r"39\.9Min", r"\$39.9M in"),
    (r"39\.9M([a-z])", r"\$39.9M $1"),
    (r"(?i)(\d+\.?\d*)M?in?revenue", r"\$$1M in revenue"),
    (r"(?i)generating(\d+\.?\d*)M", r"generating \$$1M"),
    (r"(\$?\d+\.?\d*)Mrevenue", r"$1M in revenue"),
    (r"\$(\d+\.?\d*)\s+([MKB])", r"\$$1$2"),
)
MERGED = (
    (r"([a-z])([A-Z][a-z])", "$1 $2"),
    (r"(\d)([A-Za-z])", "$1 $2"),
    (r"([a-z])(\d)", "$1 $2"),
    (r"(\.)([A-Z][a-z])", "$1 $2"),
    (r"(,)([A-Za-z])", "$1 $2"),
    (r"([a-z])(\$)", "$1 $2"),
    (r"(\$)([a-z])", "$1 $2"),
    (r"([A-Z]{3,})([a-z])", "$1 $2"),
    *((rf"(\d+)\s+{word}", f"$1% {word}") for word in ("Reduced", "Improvement", "Increase", "Decrease", "Growth", "Change", "Management")),
    (r"([.!?,:;])([A-Za-z])", "$1 $2"),
)
COMPOUND_TERMS = (
    ("enterprisewidetalentacquisitionprograms", "enterprise-wide talent acquisition programs"),
    ("talentacquisitionprogramsmaintaining", "talent acquisition programs, maintaining"),
    ("widetalentacquisitionprograms", "wide talent acquisition programs"),
    ("enterprisewidetalentacquisition", "enterprise-wide talent acquisition"),
)
#: Merged words and how they are written; upper or lower case, whole words only.
TERMS = {w.replace(" ", "").replace("-", ""): w for w in (
    "talent acquisition", "revenue impact", "strategic hires", "strategic hiring", "talent acquisition programs", "program management", "business development", "market research",
    "data analysis", "performance metrics", "key performance indicators", "stakeholder management", "process improvement", "quality assurance",
    "program manager", "program lead", "project lead", "project manager", "team lead", "team leader", "executive recruiter", "technical recruiter", "global recruiting",
    "senior recruiter", "recruiting manager",
    "enterprise-wide", "cross-functional", "full-cycle", "end-to-end", "client-facing", "cost-effective", "time-to-market", "real-time", "best practices", "thought leadership",
    "machine learning", "artificial intelligence", "deep learning", "natural language", "cloud computing", "software development", "web development", "mobile development",
    "database management", "systems architecture",
)}
COMPANIES = (
    ("Fractal.aiPost", "Fractal.ai (Post-"), ("Fractal.ai|", "Fractal.ai | "), ("NealAnalytics", "Neal Analytics"), ("ICPABangkok", "ICPA Bangkok"),
    ("FractalaiBellevue", "Fractal.ai | Bellevue"), ("MicrosoftCorporation", "Microsoft Corporation"), ("GoogleInc", "Google Inc."), ("AmazonCom", "Amazon.com"),
    ("FacebookInc", "Facebook Inc."), ("AppleInc", "Apple Inc."), ("IBMCorp", "IBM Corp."), ("OracleCorp", "Oracle Corp."), ("SalesforceCom", "Salesforce.com"),
)
#: Merged phrases, in upper or lower case, anywhere.
PHRASES = (
    ("Developandexecute", "Develop and execute"), ("evelopandexecute", "evelop and execute"), ("executeenterprise", "execute enterprise"),
    ("executedenterprise", "executed enterprise"), ("Managedendtoend", "Managed end-to-end"), ("Leadcomprehensive", "Lead comprehensive"),
    ("Reducedagencyspend", "Reduced agency spend"), ("spendfrom", "spend from"), ("fromapproximately", "from approximately"), ("throughstructured", "through structured"),
    ("andimproved", "and improved"), ("capabilitiesGenerating", "capabilities. Generating"), ("programsthrough", "programs through"), ("throughstrategic", "through strategic"),
    ("hiresD", "hires. D"), ("programsmaintaining", "programs, maintaining"), ("maintaining75", "maintaining 75%"), ("Spearheadedthe", "Spearheaded the"),
    ("Implementedstrategic", "Implemented strategic"), ("Overseenthe", "Overseen the"), ("Coordinatedwith", "Coordinated with"), ("Collaboratedwith", "Collaborated with"),
    ("Optimizedfor", "Optimized for"), ("Analyzedand", "Analyzed and"), ("Designedand", "Designed and"), ("Builtand", "Built and"), ("Createdand", "Created and"),
)
SECTION_NAMES = (
    "Experience", "Education", "Skills", "Projects", "Certifications", "Achievements", "Publications", "References", "Summary", "Objective", "Professional", "Technical",
    "Leadership", "Management",
)
DEEP = (
    *((rf"(?i)([a-z])({name})([a-z])", "$1 $2 $3") for name in SECTION_NAMES),
    (r"(\d{4})Present", "$1-Present"),
    (r"(\d{4})(\d{4})", "$1-$2"),
    (r"([a-z])([A-Z]{2})\b", "$1, $2"),
    (r"•\s*", "• "),
    (r"(\d+)\.\s*([A-Z])", "$1. $2"),
)
NORMAL = (
    (r"(\w+)\s*\.\s*(\w+)\s*@\s*(\w+)\s*\.\s*(\w+)", "$1.$2@$3.$4"),
    (r"(www|https?)\s*\.\s*(\w+)\s*\.\s*(com|org|net|edu|gov)", "$1.$2.$3"),
    (r"linkedin\s*\.\s*com\s*/\s*profile\s*/\s*(\w+)", "linkedin.com/profile/$1"),
    (r"\r\n|\r", "\n"),
    (r"\n\s*\n\s*\n+", "\n\n"),
    (r"[ \t]+", " "),
    (r"\$(\d+\.?\d*)\s+([MKB])", r"\$$1$2"),
    (r"(?m)^\s+|\s+$", ""),  # every line trimmed, none empty
)


def literal(words: tuple[tuple[str, str], ...], flags: str = "") -> tuple[tuple[str, str], ...]:
    """Rules that put strings in place of strings."""
    return tuple((flags + re.escape(a), b.replace("\\", r"\\").replace("$", r"\$")) for a, b in words)


#: The steps in order: name, rules, whole words.
STEPS = (
    ("characters", CHARACTERS, None),
    ("financial", FINANCIAL, None),
    ("merged", MERGED, None),
    ("compounds", literal(COMPOUND_TERMS, "(?i)"), None),
    ("terms", (), TERMS),
    ("companies", literal(COMPANIES), None),
    ("phrases", literal(PHRASES, "(?i)"), None),
    ("deep", DEEP, None),
    ("normal", NORMAL, None),
)
#: Strings of which a text must hold one for the pattern to match, in the case given; those of literal rules are the rules themselves.
NEEDED = {
    r"\x00|\\u0000": ("\0", r"\u0000"),
    **{pattern: ("39.9",) for pattern, _ in FINANCIAL[:4]},
    r"(\$?\d+\.?\d*)Mrevenue": ("Mrevenue",),
    **dict.fromkeys((r"\$(\d+\.?\d*)\s+([MKB])", r"([a-z])(\$)", r"(\$)([a-z])"), ("$",)),
    **{pattern: (pattern.split("+")[-1],) for pattern, _ in MERGED if pattern.startswith(r"(\d+)\s+")},
    r"(\d{4})Present": ("Present",),
    r"•\s*": ("•",),
    r"(\w+)\s*\.\s*(\w+)\s*@\s*(\w+)\s*\.\s*(\w+)": ("@",),
    r"(www|https?)\s*\.\s*(\w+)\s*\.\s*(com|org|net|edu|gov)": ("www", "http"),
    r"linkedin\s*\.\s*com\s*/\s*profile\s*/\s*(\w+)": ("linkedin",),
    r"\r\n|\r": ("\r",),
    r"\n\s*\n\s*\n+": ("\n",),
    **{pattern: (word,) for pattern, word in zip((p for p, _ in literal(COMPANIES)), (w for w, _ in COMPANIES))},
}
#: The same in lower case, for patterns that take letters of both cases.
NEEDED_LOW = {
    **{pattern: word.lower() for pattern, word in zip((p for p, _ in literal(COMPOUND_TERMS + PHRASES, "(?i)")), (w for w, _ in COMPOUND_TERMS + PHRASES))},
    **{pattern: name.lower() for (pattern, _), name in zip(DEEP, SECTION_NAMES)},
}
#: Characters beyond ASCII that are a letter of ASCII in the other case; lower() alone doesn't make all of them that letter.
ALSO_ASCII = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
#: Rules that one Column folds; more go to the next one.
FOLD = 9


# ---------------------------------------------------------------- folding
def unicode(pattern: str) -> str:
    """The pattern with classes and cases of all of Unicode."""
    return pattern.replace("(?i)", "(?iU)").replace("(?m)", "(?mU)") if pattern.startswith("(?") else "(?U)" + pattern


def growth(pattern: str, replacement: str) -> int:
    """The characters that every match adds (or takes, below 0), where the pattern alone tells: a string, or groups one after the
    other that all stay; else 0."""
    bare = pattern.removeprefix("(?i)")
    groups = re.fullmatch(r"((?:\((?!\?)[^()|]*\))+)(?:\\b)?", bare)
    if groups:
        order = [str(i + 1) for i in range(bare.count("("))]
        return len(re.sub(r"\$\d", "", replacement)) if re.findall(r"\$(\d)", replacement) == order and "\\" not in replacement else 0
    word = re.sub(r"\\([^0-9A-Za-z])", r"\1", bare)
    return len(re.sub(r"\\(.)", r"\1", replacement)) - len(word) if re.escape(word) == bare and not re.search(r"(?<!\\)\$", replacement) else 0


def lowered(text: Column) -> Column:
    """The text in lower case, for finding strings of ASCII that a pattern would match in either case."""
    odd = lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(c)) for c in ALSO_ASCII))
    return F.lower(F.when((F.length(text) < F.octet_length(text)) & odd(text), F.translate(text, "".join(ALSO_ASCII), "".join(ALSO_ASCII.values()))).otherwise(text))


def _ruled(state: Column, pattern: str, replacement: str, low: bool, counts: bool) -> Column:
    """The struct (text, n and, where asked for, the text in lower case) after one rule; n grows by the places it changed."""
    more, java = growth(pattern, replacement), unicode(pattern)

    def places(x: Column, y: Column) -> Column:
        if not counts:
            return x["n"]
        return x["n"] + (((F.length(y) - F.length(x["text"])) / more).cast("int") if more else F.regexp_count(x["text"], F.lit(java)))

    def after(x: Column, y: Column) -> Column:
        changed = F.struct(y.alias("text"), places(x, y).alias("n"), *([lowered(y).alias("low")] if low else []))
        return F.when(y == x["text"], x).otherwise(changed)

    def ruled(x: Column) -> Column:
        out = let(F.regexp_replace(x["text"], java, replacement), lambda y: after(x, y))
        if pattern in NEEDED_LOW:
            held = F.contains(x["low"], F.lit(NEEDED_LOW[pattern]))
        elif pattern in NEEDED:
            held = reduce(lambda a, b: a | b, (F.contains(x["text"], F.lit(word)) for word in NEEDED[pattern]))
        else:
            return out
        return F.when(held, out).otherwise(x)

    return let(state, ruled)


def alternatives(words: list[str]) -> str:
    """A pattern for any of the words in which equal beginnings are looked at once; longer words come first."""
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[:1], []).append(word[1:])
    parts = [re.escape(head) + alternatives(rest) for head, rest in heads.items() if head] + ([""] if "" in heads else [])
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _looked_up(state: Column, words: dict[str, str]) -> Column:
    """The struct (text, n) with whole words of a dictionary exchanged, in one pass."""
    pattern = r"(?iU)\b" + alternatives(list(words)) + r"\b"
    names = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    put = lambda x, found: F.array_join(F.zip_with(F.split(x, pattern, -1), found, lambda gap, w: F.concat(gap, F.coalesce(names[F.lower(w)], F.lit("")))), "")
    exchanged = lambda x, found: F.when(F.size(found) > 0, F.struct(put(x["text"], found).alias("text"), (x["n"] + F.size(found)).alias("n"))).otherwise(x)
    return let(state, lambda x: let(F.regexp_extract_all(x["text"], F.lit(pattern), F.lit(0)), lambda found: exchanged(x, found)))


def cleaned(df: DataFrame, text: str = "text", key: str = "doc_id", deep: bool = True, counts: bool = True) -> DataFrame:
    """(key, original, cleaned, changes): the text after all steps, and how many places each step changed. ``deep=False`` leaves out
    the step of that name, ``counts=False`` the changes. Null stays null, without changes; an empty text stays empty."""
    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_original"), F.col(text).alias("_text"))
    names = []
    for name, rules, words in STEPS:
        if name == "deep" and not deep:
            continue
        names.append(name)
        kept = ["_key", "_original", *[f"_{n}" for n in names[:-1]], F.col("_state.text").alias("_text"), F.col("_state.n").alias(f"_{name}")]
        first = F.struct(F.col("_text").alias("text"), F.lit(0).alias("n"))
        if words:
            out = out.withColumn("_state", _looked_up(first, words)).select(*kept)
            continue
        out = out.withColumn(f"_{name}", F.lit(0))
        for i in range(0, len(rules), FOLD):
            fold = rules[i : i + FOLD]
            low = any(pattern in NEEDED_LOW for pattern, _ in fold)
            state = F.struct(F.col("_text").alias("text"), F.col(f"_{name}").alias("n"), *([lowered(F.col("_text")).alias("low")] if low else []))
            for pattern, replacement in fold:
                state = _ruled(state, pattern, replacement, low, counts)
            out = out.withColumn("_state", state).select(*kept)
    changes = F.struct(*[F.coalesce(F.col(f"_{n}"), F.lit(0)).alias(n) for n in names])
    return out.select(F.col("_key").alias(key), F.col("_original").alias("original"), F.col("_text").alias("cleaned"), *([changes.alias("changes")] if counts else []))


def quality(original: Column, clean: Column) -> Column:
    """Lengths, word counts and signs of success, with points for what cleaning achieved: 20 for removed NULs, 30 for the revenue
    phrase, 25 for separated terms, 25 for at most a tenth fewer characters."""
    words = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    less = F.length(original) - F.length(clean)
    had, gone = F.contains(original, F.lit("\0")), ~F.contains(clean, F.lit("\0"))
    revenue = F.contains(clean, F.lit("$39.9M in revenue impact"))
    terms = F.contains(clean, F.lit("talent acquisition")) | F.contains(clean, F.lit("strategic hires")) | F.contains(clean, F.lit("program manager"))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(had & gone, 20) + points(revenue, 30) + points(terms, 25) + points((less > 0) & (less < F.length(original) * 0.1), 25)
    return F.struct(
        F.length(original).alias("original_length"), F.length(clean).alias("cleaned_length"), less.alias("char_reduction"), words(original).alias("word_count_original"),
        words(clean).alias("word_count_cleaned"), had.alias("has_nul_chars"), gone.alias("nul_chars_removed"), revenue.alias("revenue_pattern_fixed"),
        terms.alias("professional_terms_separated"), score.alias("improvement_score"),
    )
