"""Web pages as rows: title, text without boilerplate elements, and overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.sources.batches import lean, slices

SKIPPED = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")
CHUNK, OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def page_texts(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, title, text) of each page, without scripts, navigation, headers and footers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for page in batch.column(1).to_pylist():
                reader = _Text()
                reader.feed(page or "")
                out.append("\n".join(reader.parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string())], [key, "title", "text"])

    lean(pages.sparkSession)
    return pages.select(key, html, title(F.col(html)).alias("title")).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, title string, text string")


def pieces(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the best separator in reach, each repeating the end of the one before."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            for mark in SEPARATORS:
                cut = text.rfind(mark, at + overlap + 1, end) if mark else end
                if cut > at + overlap:
                    end = cut + len(mark) if mark else cut
                    break
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def chunks(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, chunk_id, chunk, total) of each text. Pieces leave a worker slice by slice, so no column of lists is built."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            cut = [pieces(t or "") for t in batch.column(1).to_pylist()]
            owner = pa.array([i for i, ps in enumerate(cut) for _ in ps], pa.int32())
            numbers, totals = [i for ps in cut for i in range(len(ps))], [len(ps) for ps in cut for _ in ps]
            columns = [batch.column(0).take(owner), pa.array(numbers, pa.int32()), pa.array([p for ps in cut for p in ps], pa.string()), pa.array(totals, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [key, "chunk_id", "chunk", "total"])

    lean(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, chunk_id int, chunk string, total int")
