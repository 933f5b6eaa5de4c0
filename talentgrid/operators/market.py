"""What a job title asks for: comparable jobs, their skills, and how a candidate's skills and texts meet them.

Comparable jobs come from an inverted index of title words. Titles with the same words are one entry, and an entry is found
by its rarest words only (a title that shares enough words with another shares one of these), so frequent words join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions import profiles as P
from talentgrid.functions import text as T
from talentgrid.functions import vocabulary as V
from talentgrid.functions.sections import let
from talentgrid.operators.nearmatch import LEAST, near_matches

#: Comparable jobs of a title, market skills that count, and the fewest that need no list of the role.
COMPARABLE, MARKET, FEW = 8, 30, 5


# ---------------------------------------------------------------- comparable jobs
def title_words(c: Column) -> Column:
    """The distinct words of a title, sorted; letters, digits and what names of skills hold."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}+#]+"), lambda w: w != "")))


def _indexed(sets: DataFrame, counts: DataFrame, least: float, name: str) -> DataFrame:
    """(word, set) for the rarest words of each set: as many that any set which shares ``least`` of both has one of them."""
    size = F.size("words")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"])
    rare = sets.withColumn("word", F.explode("words")).join(counts, "word").groupBy("words").agg(ordered.alias("rare"))
    keep = size - F.ceil(F.lit(least) * size - 1e-9).cast("int") + 1
    return rare.withColumn("word", F.explode(F.slice("rare", F.lit(1), keep))).select("word", F.col("words").alias(name))


def comparable_titles(sets: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """(asked, words, similarity): pairs of word sets that share at least ``least`` of their words together."""
    counts = sets.unionByName(asked).withColumn("word", F.explode("words")).groupBy("word").agg(F.count("*").alias("n"))
    pairs = _indexed(asked, counts, least, "asked").join(_indexed(sets, counts, least, "words"), "word").select("asked", "words").distinct()
    both = F.size(F.array_intersect("asked", "words"))
    close = pairs.withColumn("similarity", both / (F.size("asked") + F.size("words") - both))
    return close.where(F.col("similarity") >= least - 1e-9)


def comparable_jobs(jobs: DataFrame, wanted: DataFrame, least: float = 0.5, limit: int = COMPARABLE) -> DataFrame:
    """(wanted_id, job_id, similarity, place): for each wanted title its ``limit`` closest jobs, the most similar and then the
    smallest id first. jobs: job_id, title; wanted: wanted_id, title. Titles without words have none."""
    jobs = jobs.select("job_id", title_words(F.col("title")).alias("words")).where(F.size("words") > 0)
    wanted = wanted.select("wanted_id", title_words(F.col("title")).alias("asked")).where(F.size("asked") > 0)
    first = Window.partitionBy("words").orderBy("job_id")
    own = jobs.distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit).drop("nth")  # no title needs more
    close = comparable_titles(own.select("words").distinct(), wanted.select(F.col("asked").alias("words")).distinct(), least)
    best = Window.partitionBy("asked").orderBy(F.desc("similarity"), "job_id")
    found = close.join(own, "words").withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= limit)
    return wanted.join(found, "asked").select("wanted_id", "job_id", "similarity", "place")


def market_skills(comparable: DataFrame, skills: DataFrame) -> DataFrame:
    """(wanted_id, skill, jobs, place): skills of the comparable jobs, each counted once a job; the most frequent first, then
    the shortest. skills: job_id, skill."""
    own = skills.select("job_id", T.skill_token(F.col("skill")).alias("skill")).where("skill <> ''").distinct()
    counted = comparable.select("wanted_id", "job_id").join(own, "job_id").groupBy("wanted_id", "skill").agg(F.count("*").alias("jobs"))
    order = Window.partitionBy("wanted_id").orderBy(F.desc("jobs"), F.length("skill"), "skill")
    return counted.withColumn("place", F.row_number().over(order).cast("long"))


def role_skills(title: Column) -> Column:
    """The skills that are known for a kind of role, where the market shows too few."""
    title, out = F.lower(F.coalesce(title, F.lit(""))), None
    for words, skills in V.ROLE_SKILLS:
        known = F.array(*[F.lit(s) for s in skills])
        hit = F.lit(not words)
        for w in words:
            hit = hit | title.contains(w)
        out = F.when(hit, known) if out is None else out.when(hit, known)
    return out


# ---------------------------------------------------------------- alignment
def canonical(c: Column) -> Column:
    """A skill for comparison: lower case, separators as spaces, one name for what has several."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[./,+_]+", " "), r"\s+", " "))
    names = F.create_map(*[F.lit(x) for pair in V.SKILL_NAMES.items() for x in pair])
    return let(plain, lambda p: F.coalesce(names[p], p))


def literal(c: Column) -> Column:
    """A string as the pattern that matches it alone."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def whole(pattern: Column) -> Column:
    return F.concat(F.lit("(?<![a-z0-9])(?:"), pattern, F.lit(")(?![a-z0-9])"))


def words_of(skill: Column) -> Column:
    """The words of a skill between separators; the skill itself where there are none."""
    words = F.filter(F.split(skill, r"[/\-\s_]+"), lambda w: w != "")
    return F.when(F.size(words) > 0, words).otherwise(F.array(skill))


def flexible(skill: Column) -> Column:
    """The pattern of a skill in running text: any separators between its words or none, a plural s."""
    words = F.transform(words_of(skill), literal)
    return whole(F.concat(F.array_join(words, r"[\s\-/_]+"), F.lit("s?|"), F.array_join(words, ""), F.lit("s?")))


def pieces_of(plain: Column) -> Column:
    """The pieces of canonical skills between separators and joining words."""
    pieces = F.flatten(F.transform(plain, lambda s: F.split(s, V.SKILL_BREAKS)))
    return F.array_distinct(F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != ""))


def parts_of(skills: Column) -> Column:
    """The pieces of listed skills."""
    return pieces_of(F.transform(skills, canonical))


def market_list(skills: Column, most: int = MARKET) -> Column:
    """The first ``most`` different canonical skills of a list."""
    own = F.array_distinct(F.filter(F.transform(skills, canonical), lambda s: s != ""))
    return F.slice(own, 1, most)


def aligned(pairs: DataFrame, candidates: DataFrame, markets: DataFrame, least: float = LEAST) -> DataFrame:
    """(candidate_id, title, market_skills, candidate_skills, matching_skills, missing_skills, overlap_ratio) for each row of pairs.

    pairs: candidate_id, title. candidates: candidate_id, skills (an array), text. markets: title, skills (an array, most
    frequent first). A skill of the market is found where a piece of a listed skill holds it as whole words or is nearly
    equal to it (one near match a piece, the closest), where the text names it, or by one of its other names. Nulls are
    empty lists and texts."""
    none = F.array().cast("array<string>")
    skills = F.coalesce("skills", none)
    wanted = markets.select("title", market_list(F.coalesce("skills", none)).alias("market"))
    rows = pairs.select("candidate_id", "title").distinct().join(wanted, "title")

    # near matches: distinct pieces against distinct market skills; a candidate gets those of each of its pieces, the closest first
    spelled = candidates.select(F.explode(skills).alias("skill")).distinct()
    near = near_matches(spelled.select(F.explode(parts_of(F.array("skill"))).alias("part")), wanted.select(F.explode("market").alias("skill")), least, "part", "skill")
    closest = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("ratio", "entry")))), lambda h: h["entry"])
    hits = near.groupBy(F.col("text").alias("part")).agg(closest.alias("hit"))
    asked = candidates.select("candidate_id", F.explode(parts_of(skills)).alias("part")).join(hits, "part")
    asked = asked.groupBy("candidate_id").agg(F.collect_set("hit").alias("hits"))

    # what a market may ask of a candidate is looked for once, whatever the titles: neither text nor pieces are joined to a title
    sought = rows.select("candidate_id", F.explode("market").alias("skill")).groupBy("candidate_id").agg(F.collect_set("skill").alias("sought"))
    plain = F.transform(skills, canonical)
    people = candidates.select("candidate_id", canonical(F.col("text")).alias("haystack"), plain.alias("plain"))
    people = people.join(sought, "candidate_id", "left").withColumn("sought", F.coalesce("sought", none)).withColumn("parts", pieces_of(F.col("plain")))
    # a pattern that differs from row to row is compiled each time, so it is only made where the string it needs is there
    held = lambda skill: F.exists("parts", lambda p: F.contains(p, skill) & F.rlike(p, whole(literal(skill))))
    told = lambda skill: F.contains(F.col("haystack"), F.get(words_of(skill), F.lit(0))) & F.rlike("haystack", flexible(skill))
    other_text = F.lit(False)
    named = lambda table, hit: lambda m: _any([(m == skill) & hit(pattern) for skill, pattern in table.items()], other_text)
    in_text = F.filter("sought", lambda m: told(m) | named(V.SKILLS_IN_TEXT, lambda p: F.rlike("haystack", F.lit(p)))(m))
    listed = F.array_distinct(F.filter("plain", lambda s: s != ""))
    people = people.select("candidate_id", listed.alias("listed"), F.filter("sought", held).alias("held"), in_text.alias("in_text"))
    people = people.join(asked, "candidate_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<array<string>>")))

    rows = rows.join(people, "candidate_id")
    nearest = F.transform("hits", lambda hit: F.get(F.filter(hit, lambda s: F.array_contains("market", s)), F.lit(0)))
    rows = rows.withColumn("near", F.filter(nearest, lambda s: s.isNotNull()))
    expanded = F.filter("market", lambda m: F.array_contains("near", m) | F.array_contains("held", m))
    rows = rows.withColumn("own", F.when(F.size(expanded) > 0, expanded).otherwise(F.col("listed")))
    rows = rows.withColumn("own", F.array_union("own", F.array_intersect("market", "in_text")))
    alias = F.filter("market", lambda m: named(V.SKILL_ALIASES, lambda p: F.exists("own", lambda s: F.rlike(s, F.lit(p))))(m))
    rows = rows.withColumn("own", F.array_union("own", alias))

    both = F.array_intersect("own", "market")
    share = F.size(both) / F.greatest(F.size(F.array_union("own", "market")), F.lit(1))
    core = F.size(F.array_intersect(both, F.array(*[F.lit(s) for s in V.CORE_AI_SKILLS])))
    bonus = F.when(P.is_ai_role(F.col("title")), F.least(F.lit(0.3), core * 0.1)).otherwise(F.lit(0.0))
    return rows.select(
        "candidate_id", "title", F.array_sort("market").alias("market_skills"), F.array_sort("own").alias("candidate_skills"), F.array_sort(both).alias("matching_skills"),
        F.array_sort(F.array_except("market", "own")).alias("missing_skills"), F.round(F.least(F.lit(1.0), share + bonus), 4).alias("overlap_ratio"),
    )


def _any(conditions: list[Column], start: Column) -> Column:
    for c in conditions:
        start = start | c
    return start


def market_of(wanted: DataFrame, comparable: DataFrame, skills: DataFrame, most: int = MARKET) -> DataFrame:
    """(wanted_id, skills): the market's skills of each wanted title in order, or those of its role where there are fewer than ``FEW``."""
    ranked = market_skills(comparable, skills).where(F.col("place") <= most)
    lists = ranked.groupBy("wanted_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "skill"))), lambda x: x["skill"]).alias("found"))
    enough = F.size("found") >= FEW
    return wanted.join(lists, "wanted_id", "left").select("wanted_id", F.when(enough, F.col("found")).otherwise(role_skills(F.col("title"))).alias("skills"))
