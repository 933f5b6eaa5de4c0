"""Written answers and the results behind them: entities and numbers of nested results, mentions as links, and checks.

A result is a JSON document of any depth. A text meets only the names of its own result, so both stand in one row and no word run is
shuffled. Within a row the word runs of a text are looked up among the words of the names: any number of names costs one pass over a text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions import text as T
from talentgrid.functions.sections import let

# ---------------------------------------------------------------- fixed values
LINK = r"\[([^\]\n]+)\]\(([^)\s]+)\)"
BOLD_LINK = r"\*\*([^*\n]*\[[^\]\n]+\]\([^)\s]+\)[^*\n]*)\*\*"
PROFILE = r"^/(candidates|jobs)/([A-Za-z0-9_-]*)$"
NUMBER = r"(?<![\w.$/,-])(\d{1,3}(?:,\d{3})+|\d+)(?![\w%-])(?!\.\d)"
#: Names of fewer characters aren't linked.
SHORTEST = 3
#: Keys whose values are ids, not counts.
ID_KEYS = ("id", "job_id", "candidate_id")

_LINK, _BOLD_LINK, _PROFILE, _WORD = re.compile(LINK), re.compile(BOLD_LINK), re.compile(PROFILE), re.compile(r"\w+")
ENTITY = "array<struct<kind: string, id: string, name: string>>"


# ---------------------------------------------------------------- nested results
def objects_of(value: object) -> Iterator[dict]:
    """All objects of a document, outer ones first; a stack, so depth costs no recursion."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            todo.extend(reversed(x.values()))
        elif isinstance(x, list):
            todo.extend(reversed(x))


def named_in(value: object) -> list[tuple[str, str, str]]:
    """(kind, id, name) of the candidates and jobs in a document; the last name of an id counts."""
    found: dict[tuple[str, str], str] = {}
    for x in objects_of(value):
        if "id" in x and isinstance(x.get("title"), str):
            found["jobs", str(x["id"])] = x["title"]
        elif "id" in x and isinstance(x.get("name"), str):
            found["candidates", str(x["id"])] = x["name"]
        for kind, key, name in (("jobs", "job_id", "job_title"), ("candidates", "candidate_id", "candidate")):
            if key in x and isinstance(x.get(name), str):
                found[kind, str(x[key])] = x[name]
    return [(*k, name) for k, name in found.items()]


def counts_in(value: object) -> set[int]:
    """The integers of a document, decimals rounded, but for values of id keys."""
    out: set[int] = set()
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo.extend(v for k, v in x.items() if k not in ID_KEYS)
        elif isinstance(x, list):
            todo.extend(x)
        elif isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 2**63:
            out.add(int(round(x)))
    return out


def described(results: DataFrame, key: str, document: str, *more: str) -> DataFrame:
    """(key, entities, numbers) of each row's JSON document, and the columns ``more`` as they are. Null, and what isn't JSON, has none."""
    kinds = dict(results.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc in batch.column(1).to_pylist():
                try:
                    value = json.loads(doc) if doc else None
                except (ValueError, RecursionError):
                    value = None
                rows.append((named_in(value), sorted(counts_in(value))))
            entity = pa.list_(pa.struct([("kind", pa.string()), ("id", pa.string()), ("name", pa.string())]))
            entities = pa.array([[dict(zip(("kind", "id", "name"), e)) for e in found] for found, _ in rows], entity)
            own = [batch.column(0), entities, pa.array([n for _, n in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns[2:]], [key, "entities", "numbers", *more])

    schema = ", ".join([f"`{key}` {kinds[key]}, entities {ENTITY}, numbers array<long>", *(f"`{c}` {kinds[c]}" for c in more)])
    return results.select(key, document, *more).mapInArrow(run, schema)


# ---------------------------------------------------------------- links
def plain_words(c: Column) -> Column:
    """Runs of ASCII letters and digits, without possessive endings."""
    return F.regexp_extract_all(F.replace(F.lower(c), F.lit("'s"), F.lit("")), F.lit(r"([a-z0-9]+)"), F.lit(1))


def repaired(text: str, known: dict[tuple[str, str], str | None]) -> str:
    """Links whose id no entity has, pointed at the one entity whose name has the label's words as a run; others stay."""
    words = lambda s: re.findall(r"[a-z0-9]+", s.lower().replace("'s", ""))
    names: dict[str, list[tuple[str, str]]] = {}

    def put(m: re.Match) -> str:
        path = _PROFILE.match(m[2])
        run = words(m[1])
        if not path or not run or (path[1], path[2]) in known:
            return m[0]
        if not names:
            for (kind, ident), name in known.items():
                names.setdefault(kind, []).append((ident, f" {' '.join(words(name or ''))} "))
        hits = [ident for ident, name in names.get(path[1], ()) if f" {' '.join(run)} " in name]
        return f"[{m[1]}](/{path[1]}/{hits[0]})" if len(hits) == 1 else m[0]

    return _LINK.sub(put, text)


def mentions(text: str, known: dict[tuple[str, str], str | None]) -> list[dict]:
    """Every whole-word mention of a name in upper or lower case: kind, id, name, start. Names without a letter or digit are mentioned nowhere."""
    runs: dict[str, list[tuple[str, str, str]]] = {}
    sizes: dict[str, set[int]] = {}  # how many words the names have that begin with a word
    for (kind, ident), name in known.items():
        own = [w.lower() for w in _WORD.findall(name or "")]
        if own and len(name) >= SHORTEST:
            runs.setdefault(" ".join(own), []).append((kind, ident, name))
            sizes.setdefault(own[0], set()).add(len(own))
    words = [(m.group().lower(), m.start()) for m in _WORD.finditer(text)]
    return [
        {"kind": kind, "id": ident, "name": name, "start": start}
        for i, (word, start) in enumerate(words) for n in sizes.get(word, ()) for kind, ident, name in runs.get(" ".join(w for w, _ in words[i : i + n]), ())
    ]


def choose(text: str, found: list[dict]) -> str:
    """The text with the first free mention of every entity as a link, longer names first; links that are there stay, and an entity
    that is linked already gets no second link. Bold marks around a link go."""
    taken = [m.span() for m in _LINK.finditer(text)]
    linked = {m[2] for m in _LINK.finditer(text)}
    chosen = []
    for x in sorted(found, key=lambda x: (-len(x["name"]), x["kind"], x["id"], x["start"])):
        href, name = f"/{x['kind']}/{x['id']}", x["name"]
        # the words agree; what stands between and around them has to as well
        lead = _WORD.search(name).start()
        a, b = x["start"] - lead, x["start"] - lead + len(name)
        whole = a >= 0 and text[a:b].lower() == name.lower() and not (a and _WORD.match(text[a - 1])) and not (b < len(text) and _WORD.match(text[b]))
        if href not in linked and whole and not any(a < stop and b > start for start, stop in taken):
            linked.add(href)
            taken.append((a, b))
            chosen.append((a, b, href))
    for a, b, href in sorted(chosen, reverse=True):
        text = f"{text[:a]}[{text[a:b]}]({href}){text[b:]}"
    return _BOLD_LINK.sub(r"\1", text)


def linked_rows(rows: DataFrame) -> DataFrame:
    """Rows with plain dashes in their ``text``, repaired links, and the first mention of each of their ``entities`` as a link; other
    columns stay. An id with several names goes by the first of them in order; entities without kind or id are none."""
    rows = rows.withColumn("text", T.plain_dashes(F.coalesce("text", F.lit(""))))
    names = rows.columns

    def rewrite(text: str, entities: list[dict] | None) -> str:
        known: dict[tuple[str, str], str | None] = {}
        for e in entities or ():
            if e["kind"] is not None and e["id"] is not None:
                k, name = (e["kind"], e["id"]), e["name"] and e["name"].strip(" ")
                old = known.setdefault(k, name)
                known[k] = name if old is None or name is not None and name < old else old
        text = repaired(text, known)
        return choose(text, mentions(text, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rewrite(*x) for x in zip(batch.column("text").to_pylist(), batch.column("entities").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes))


def linked(texts: DataFrame, entities: DataFrame, key: str = "key") -> DataFrame:
    """(key, text): every text as ``linked_rows`` leaves it.

    texts: key, text, one row a key; entities: key, kind, id, name, those that a text may name. Null texts are empty; a text without
    entities only loses its dashes."""
    own = entities.select(key, F.struct("kind", F.col("id").cast("string").alias("id"), "name").alias("e")).groupBy(key).agg(F.collect_list("e").alias("entities"))
    return linked_rows(texts.select(key, "text").join(own, key, "left")).select(key, "text")


# ---------------------------------------------------------------- checks
def _label_words(c: Column) -> Column:
    """Words of a label or name without leading articles."""
    return F.split(F.regexp_replace(F.array_join(plain_words(c), " "), r"^(?:(?:the|an|a)(?: |$))+", ""), " ")


def names_agree(label: Column, name: Column) -> Column:
    """Whether a label is the name, a run of its words, or the name and at most two words more."""

    def agree(w: Column) -> Column:
        x, y = (F.concat(F.lit(" "), F.array_join(w[side], " "), F.lit(" ")) for side in ("a", "b"))
        run = (F.size(w["a"]) < F.size(w["b"])) & F.contains(y, x)
        longer = F.startswith(x, y) & (F.size(w["a"]) - F.size(w["b"]) <= 2)
        return (F.trim(x) != "") & (F.trim(y) != "") & (run | longer)

    return let(F.struct(_label_words(label).alias("a"), _label_words(name).alias("b")), agree)


def failures(text: Column, entities: Column, numbers: Column, must_mention: tuple[str, ...] = (), must_match: tuple[str, ...] = (), must_not_match: tuple[str, ...] = (), numbers_from_results: bool = False, require_link: bool = False) -> Column:
    """What is wrong with an answer, in order; none where it passes.

    text: the answer. entities, numbers: what ``described`` found in its results. Every link has to be a profile path of an
    entity that was found, under a label that names it and no other one; with ``numbers_from_results`` every bare number has to be
    one of the results'."""
    text = F.coalesce(text, F.lit(""))
    say = lambda bad, *parts: F.when(bad, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    links = F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("label"), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("href"))

    def of_link(link: Column) -> Column:
        path = F.struct(link["label"].alias("label"), link["href"].alias("href"), F.regexp_extract(link["href"], PROFILE, 1).alias("kind"), F.regexp_extract(link["href"], PROFILE, 2).alias("id"))
        own = lambda x: F.get(F.filter(entities, lambda e: (e["kind"] == x["kind"]) & (e["id"] == x["id"])), F.lit(0))
        said = lambda c: F.array_join(_label_words(c), " ")
        return let(path, lambda x: let(F.struct(x.alias("x"), own(x).alias("own"), said(x["label"]).alias("said")), wrong_of))

    def wrong_of(y: Column) -> Column:
        x, name = y["x"], y["own"]["name"]
        other = F.exists(entities, lambda e: (e["kind"] == x["kind"]) & (e["id"] != x["id"]) & (F.array_join(_label_words(e["name"]), " ") == y["said"]))
        another = (y["said"] != F.array_join(_label_words(name), " ")) & other
        return F.coalesce(
            say((x["kind"] == "") | (x["id"] == ""), "link ", x["href"], " is not a profile path"),
            say(y["own"].isNull(), "link ", x["href"], " points at an id of no result"),
            say(~names_agree(x["label"], name), "label ", x["label"], " does not name ", name, " (", x["href"], ")"),
            say(another, "label ", x["label"], " names another than ", x["href"], ", which is ", name),
        )

    plain = F.regexp_replace(text, LINK, "$1")
    told = F.regexp_extract_all(plain, F.lit("(?U)" + NUMBER), F.lit(1))
    unknown = F.filter(told, lambda n: ~F.array_contains(numbers, F.replace(n, F.lit(","), F.lit("")).try_cast("long")))
    found = [F.array(say(F.rlike(text, F.lit("[—–]")), "the answer has an em or en dash"))]
    if require_link:
        found.append(F.array(say(F.size(links) == 0, "the answer has no profile link")))
    found.append(F.transform(links, of_link))
    found += [F.array(say(~F.contains(F.lower(text), F.lit(w.lower())), f"the answer does not mention {w}")) for w in must_mention]
    found += [F.array(say(~F.rlike(text, F.lit(f"(?iU){p}")), f"the answer does not match {p}")) for p in must_match]
    found += [F.array(say(F.rlike(text, F.lit(f"(?iU){p}")), f"the answer matches {p}")) for p in must_not_match]
    if numbers_from_results:
        found.append(F.transform(unknown, lambda n: F.concat(F.lit("number "), n, F.lit(" is in no result"))))
    return F.filter(F.concat(*found), lambda x: x.isNotNull())


def checked_rows(rows: DataFrame, name: str = "failures", **rules) -> DataFrame:
    """Rows with what is wrong with their ``text`` by their ``entities`` and ``numbers``; null ones are empty."""
    known = F.coalesce("entities", F.array().cast(ENTITY)), F.coalesce("numbers", F.array().cast("array<long>"))
    return rows.withColumn(name, failures(F.col("text"), *known, **rules))


def checked(answers: DataFrame, results: DataFrame, key: str = "key", document: str = "results", **rules) -> DataFrame:
    """(key, text, failures) of every answer against the results with its key; an answer without results has none behind it."""
    return checked_rows(answers.join(described(results, key, document), key, "left"), **rules).select(key, "text", "failures")
