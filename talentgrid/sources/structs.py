"""One struct a page: named fields, each the first element that one of its selectors finds, in the order of the selectors.

A selector is a chain of steps with blanks between them; a step is a tag, .class, #id and [attribute='value'] written together.
All selectors of all fields are matched in one pass over a page's tags, so a page costs its length once, however many fields.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from talentgrid.sources.batches import lean, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "template")
_STEP = re.compile(r"^(?P<tag>[a-zA-Z][\w-]*)?(?P<rest>(?:\.[\w-]+|#[\w-]+|\[[\w-]+(?:=(?:'[^']*'|\"[^\"]*\"|[^\]]*))?\])*)$")
_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=(?:'([^']*)'|\"([^\"]*)\"|([^\]]*)))?\]")


@dataclass(frozen=True)
class Field:
    """A field of a struct: its selectors, what it is where none finds anything, and whether all elements count or the first."""

    name: str
    selectors: tuple[str, ...]
    default: str | tuple[str, ...] | None = None
    many: bool = False


# ---------------------------------------------------------------- fixed values
JOB = (
    Field("title", ("h1.job-title", "h1.posting-title", "h1.position-title", ".job-header h1", "[data-qa='job-title']"), "Unknown Position"),
    Field("company", (".company-name", ".employer-name", "[data-qa='employer']", ".posting-company"), "Unknown Company"),
    Field("location", (".job-location", ".posting-location", "[data-qa='location']", ".company-location"), "Location Not Specified"),
    Field("description", (".job-description", ".posting-description", "[data-qa='description']", "#job-description"), ""),
    Field("requirements", (".job-requirements li", ".posting-requirements li", "[data-qa='requirements'] li", "#job-requirements li"), ("No specific requirements listed",), True),
    Field("salary", (".job-salary", ".posting-salary", "[data-qa='salary']", ".compensation")),
)
COMPANY = (
    Field("name", ("h1.company-name", ".org-name", "[data-qa='company-name']"), "Unknown Company"),
    Field("description", (".company-description", ".org-description", "[data-qa='company-description']"), ""),
    Field("industry", (".company-industry", ".org-industry", "[data-qa='industry']"), "Industry Not Specified"),
    Field("size", (".company-size", ".org-size", "[data-qa='company-size']"), "Size Not Specified"),
    Field("founded", (".company-founded", ".org-founded", "[data-qa='founded-year']")),
)


# ---------------------------------------------------------------- selectors
def step_of(text: str) -> tuple:
    """(tag or None, classes, id or None, attributes) of one step."""
    m = _STEP.match(text)
    if not m or not text:
        raise ValueError(f"not a selector step: {text!r}")
    classes, ident, attributes = set(), None, []
    for cls, name, key, *values in _PART.findall(m["rest"]):
        if cls:
            classes.add(cls)
        elif name:
            ident = name
        else:
            attributes.append((key.lower(), next((v for v in values if v), None)))
    return (m["tag"] or "").lower() or None, frozenset(classes), ident, tuple(attributes)


def fits(step: tuple, tag: str, attrs: dict[str, str]) -> bool:
    name, classes, ident, attributes = step
    if name and name != tag or (ident is not None and attrs.get("id") != ident) or (classes and not classes <= set(attrs.get("class", "").split())):
        return False
    return all(k in attrs and (v is None or attrs[k] == v) for k, v in attributes)


class _Reader(HTMLParser):
    """Follows the open elements of a page; for each selector, how many of its steps the open elements have met, in order."""

    def __init__(self, chains: list[tuple]):
        super().__init__(convert_charrefs=True)
        self.chains = chains
        self.open: list[tuple[str, tuple[int, ...]]] = []
        self.many: Counter[str] = Counter()  # open elements by tag
        self.silent = 0
        self.found: list[list[list[str]]] = [[] for _ in chains]  # the texts of matched elements, by selector
        self.listening: list[tuple[int, list[str]]] = []  # (depth, texts) of the matched elements that are open

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}
        met = list(self.open[-1][1]) if self.open else [0] * len(self.chains)
        texts: list[str] = []
        matched = False
        for i, chain in enumerate(self.chains):
            # the last step has to fit the element itself, those before it the elements around, greedily from outside
            if met[i] == len(chain) - 1:
                if fits(chain[-1], tag, own):
                    self.found[i].append(texts)
                    matched = True
            elif fits(chain[met[i]], tag, own):
                met[i] += 1
        if tag in VOID:
            return
        self.open.append((tag, tuple(met)))
        self.many[tag] += 1
        if matched:
            self.listening.append((len(self.open), texts))
        self.silent += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        if self.many[tag]:
            while True:
                last, _ = self.open.pop()
                self.many[last] -= 1
                self.silent -= last in SILENT
                while self.listening and self.listening[-1][0] > len(self.open):
                    self.listening.pop()
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for _, texts in self.listening:
                texts.append(data)


def read(html: str | None, fields: tuple[Field, ...]) -> dict[str, str | list[str] | None]:
    """The fields of one page. Texts are trimmed; an element that is found counts even if it is empty."""
    chains = [(f, tuple(step_of(s) for s in selector.split())) for f in fields for selector in f.selectors]
    reader = _Reader([c for _, c in chains])
    reader.feed(html or "")
    reader.close()
    out: dict[str, str | list[str] | None] = {}
    for (f, _), texts in zip(chains, reader.found):
        if texts and f.name not in out:
            out[f.name] = ["".join(t).strip() for t in texts] if f.many else "".join(texts[0]).strip()
    return {f.name: out.get(f.name, list(f.default or ()) if f.many else f.default) for f in fields}


def structs(pages: DataFrame, fields: tuple[Field, ...] = JOB, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, a column for each field) of every page. Null and empty pages have the defaults."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = [read(page, fields) for page in batch.column(1).to_pylist()]
            columns = [pa.array([r[f.name] for r in rows], pa.list_(pa.string()) if f.many else pa.string()) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *[f.name for f in fields]])

    lean(pages.sparkSession)

    kinds = ", ".join(f"`{f.name}` {'array<string>' if f.many else 'string'}" for f in fields)
    return pages.select(key, html).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, {kinds}")
