"""Approximate dictionary join: strings of one table against the entries of another, by the share of matching characters.

The ratio is that of ``difflib``: twice the characters in matching blocks over the characters of both strings. Two strings of
s characters in all whose ratio reaches ``least`` have a matching block of some length that s alone decides, so they share
a gram of that length: candidates come from an equi-join on grams, and only they are compared. Grams are taken as long as
the lengths allow, so no pair is lost and no pair of tables is crossed. A pair that shares a gram leaves the join only if its
characters differ by no more than the ratio allows, as far as 64 bits tell: that needs no pair to be shuffled or compared.
"""

from __future__ import annotations

import difflib
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.85
#: The longest gram that is used as a key.
LONGEST = 3


def ratio(entry: str, text: str) -> float:
    """2 * matching characters / all characters, as the blocks of entry against text give it."""
    return difflib.SequenceMatcher(None, entry, text).ratio()


@functools.lru_cache(maxsize=None)
def sure_block(total: int, least: float) -> int:
    """The length that the longest matching block has at least, where two strings of ``total`` characters reach ``least``;
    0 where they can't. With m matching characters, total - 2m are left over, and every further block needs one of these."""
    few = -int(-(least * total - 1e-9) // 2)
    found = [-(-m // (total - 2 * m + 1)) for m in range(max(1, few), total // 2 + 1)]
    return min(found, default=0)


def keys(text: str, least: float) -> set[str]:
    """The join keys of a string: for every total length that a partner can make, grams that both must share one of."""
    n, out = len(text), set()
    lengths = range(max(1, int(n * least / (2 - least))), int(n * (2 - least) / least) + 2)
    for size in {(sure_block(n + m, least), n + m) for m in lengths}:
        block, total = min(size[0], LONGEST), size[1]
        if not block:
            continue
        mark = "" if block == LONGEST else f"{total}:"  # short grams only meet for the total length that needs them
        out.update(f"{block}:{mark}{text[i : i + block]}" for i in range(n - block + 1))
    return out


def mark(text: str) -> int:
    """64 bits, one for each character with how often it stood before. Where two strings' marks differ in a bit, one of them has
    a character that matches nothing in the other, another one for each bit."""
    seen: dict[str, int] = {}
    out = 0
    for c in text:
        seen[c] = k = seen.get(c, -1) + 1
        out |= 1 << (ord(c) + 27 * k) % 64
    return out - (1 << 64) if out >> 63 else out


def near_matches(texts: DataFrame, entries: DataFrame, least: float = LEAST, text: str = "text", entry: str = "entry") -> DataFrame:
    """(text, entry, ratio) of all pairs of distinct strings whose ratio is at least ``least``. Null and empty strings match nothing."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, k, m) for s in batch.column(0).to_pylist() for m in [mark(s)] for k in keys(s, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["s", "key", "mark"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = difflib.SequenceMatcher(None)
        for batch in batches:
            found, last = [], None
            for t, e in sorted(zip(batch.column("text").to_pylist(), batch.column("entry").to_pylist())):
                if t != last:
                    matcher.set_seq2(t)
                    last = t
                matcher.set_seq1(e)
                if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (r := matcher.ratio()) >= least:
                    found.append((t, e, r))
            yield pa.RecordBatch.from_pylist([dict(zip(("text", "entry", "ratio"), x)) for x in found], pa.schema([("text", pa.string()), ("entry", pa.string()), ("ratio", pa.float64())]))

    def side(df: DataFrame, column: str, name: str) -> DataFrame:
        own = df.select(F.col(column).cast("string").alias("s")).where("s <> ''").distinct()
        return own.mapInArrow(keyed, "s string, key string, mark long").withColumnsRenamed({"s": name, "mark": f"{name}_mark"})

    total = F.length("text") + F.length("entry")
    lengths = F.least(F.length("text"), F.length("entry")) * 2 >= F.lit(least) * total - 1e-9
    alike = F.bit_count(F.col("text_mark").bitwiseXOR(F.col("entry_mark"))) <= F.lit(1 - least) * total + 1e-9
    met = side(texts, text, "text").join(side(entries, entry, "entry"), "key").where(lengths & alike)
    return met.select("text", "entry").distinct().mapInArrow(compared, "text string, entry string, ratio double")
