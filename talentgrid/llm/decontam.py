"""Benchmark decontamination with spaced seeds.

Fixed masks of kept and ignored places slide over the words of every benchmark item and of every
text; the kept words of a window are hashed together, so a window still matches where the ignored
words were substituted. The hashes of the test items are joined with those of the training texts.
Each hit names an alignment of an item with a text; there the words are compared place by place and
the longest stretch that holds enough equal words decides.

A stretch starts and ends on an equal word, at least ``SHARE`` of its words are equal, and it is as
long as ``LEAST`` words, or as the item where that is shorter; of equally long ones the first counts.
Items of fewer than ``WIDTH`` words are matched whole and exactly. Null and empty texts and items have
no words and match nothing. Ids may be of any type and null: items without an id contaminate, but are
in no list, and rows of docs that share a key, or have none, are judged together.
Every text is searched whole; benchmarks are joined in blocks of a fixed number of hashes, so what
is broadcast doesn't grow with them. Matching windows are gone through ``PAIRS`` at a time, so that
repeated words in a text and an item take time but no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from talentgrid.llm.common import WORD_PLACE, mixed, slices, word_hashes

#: The masks (fixed values): 1 keeps a word, 0 ignores it. A stretch is found if in one window of one mask all its
#: substituted words fall on ignored places. In every stretch that LEAST and SHARE accept, of whatever length, one of these
#: has such a window; tests prove it by going through all of them.
MASKS = ("111011", "111101", "1001111", "1101011", "1111001", "10100111", "11011001", "110100011")
WIDTH = 8
LEAST = 11
SHARE = 0.75
#: Hashes of a block of items that are broadcast at once (8 bytes and an item's place each).
BLOCK = 2_000_000
#: Pairs of matching windows that are held at once.
PAIRS = 1 << 20


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the kept words of every window of h."""
    n = max(0, len(h) - len(mask) + 1)
    out = np.zeros(n, np.uint64)
    for j, keep in enumerate(mask):
        if keep == "1":
            out += h[j : j + n] * WORD_PLACE[j]
    return mixed(out + np.uint64(len(mask) * 1000 + int(mask, 2)))


class Items:
    """One block of benchmark items: their words and a sorted table of the hashes of their windows."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        key, item, at = [], [], []
        for k, w in enumerate(words):
            for mask in MASKS:
                s = seeds(w, mask)
                key.append(s)
                item.append(np.full(len(s), k, np.int32))
                at.append(np.arange(len(s), dtype=np.int32))
        self.short = {w.tobytes(): k for k, w in reversed(list(enumerate(words))) if 0 < len(w) < WIDTH}
        keys = np.concatenate(key) if key else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int32)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int32)
        self.bits = 22
        self.may = np.zeros(1 << self.bits, bool)
        self.may[self.keys >> np.uint64(64 - self.bits)] = True

    def lines(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """All (row, item, place of the item's first word in h) with a window that hashes alike, once each, in order."""
        found = np.zeros(0, np.int64)
        most = max(map(len, self.words), default=0)  # an item can begin so many words before the text
        width = len(h) + most + 1
        for mask in MASKS:
            s = seeds(h, mask)
            p = np.flatnonzero(self.may[s >> np.uint64(64 - self.bits)])
            lo, hi = np.searchsorted(self.keys, s[p], "left"), np.searchsorted(self.keys, s[p], "right")
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(n)
            start = 0
            while start < len(p):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
                size = n[start:stop]
                row = np.repeat(lo[start:stop], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                where = np.repeat(p[start:stop], size)
                text = np.searchsorted(off, where, side="right") - 1
                new = (text * len(self.words) + self.item[row]) * width + where - self.at[row] + most  # one number for the three
                found = np.union1d(found, new)
                start = stop
        pair, place = np.divmod(found, width)
        return np.stack([*np.divmod(pair, max(1, len(self.words))), place - most], axis=1)


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the longest stretch that starts and ends on an equal word and holds at least
    SHARE of them; of equally long ones the first."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    # words i to j hold j - i + 1 equal ones of at[j] - at[i] + 1: enough if value[j] >= value[i] - (1 - SHARE)
    value = np.arange(len(at)) - SHARE * at
    best = np.maximum.accumulate(value[::-1])[::-1]  # from here on; falls
    last = np.searchsorted(-best, -(value - (1 - SHARE)), side="right") - 1
    i = int((at[last] - at).argmax())
    j = int(last[i])
    return int(at[i]), int(at[j]) + 1, j - i + 1


def overlaps(items: Items, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, place of the item, first word, words of the stretch, equal words) of every text and item that overlap enough."""
    h, off = word_hashes(texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, k, start in items.lines(h, off).tolist():
        w = items.words[k]
        a, b = max(start, int(off[r])), min(start + len(w), int(off[r + 1]))
        if a >= b:
            continue
        s, e, n = stretch(h[a:b] == w[a - start : b - start])
        if e - s >= min(LEAST, len(w)) and (e - s, n) > best.get((r, k), (0, 0, 0))[1:]:
            best[r, k] = (a + s - int(off[r]), e - s, n)
    if items.short:
        for r in range(len(off) - 1):
            w = h[off[r] : off[r + 1]]
            for n in {len(x) // 8 for x in items.short}:
                for a in range(len(w) - n + 1) if len(w) else ():
                    if (k := items.short.get(w[a : a + n].tobytes())) is not None:
                        best.setdefault((r, k), (a, n, n))
    for (r, k), (a, size, n) in sorted(best.items()):
        yield r, k, a, size, n


def blocks(benchmark: DataFrame, text: str, item: str) -> Iterator[Items]:
    """The benchmark's items in blocks of at most BLOCK hashes; the driver holds one block at a time."""
    ids, words, size = [], [], 0
    for one in benchmark.select(item, text).where(F.col(text).isNotNull()).orderBy(item).toLocalIterator():
        h, _ = word_hashes(pa.array([one[1]], pa.string()))
        if size + len(h) * len(MASKS) > BLOCK and ids:
            yield Items(ids, words)
            ids, words, size = [], [], 0
        ids.append(one[0])
        words.append(h)
        size += len(h) * len(MASKS)
    yield Items(ids, words)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, first_word, n_words, n_equal): the longest overlap of each text and item that overlap enough."""
    session, kinds, item_kind = docs.sparkSession, dict(docs.dtypes), dict(benchmark.dtypes)[item]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    item_type = benchmark.schema[item].dataType
    out = None
    for block in blocks(benchmark, item_text, item):
        shared = session.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            ids = pa.array(own.ids, to_arrow_type(item_type))
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(overlaps(own, part.column("text")))
                    r, k, a, size, n = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
                    yield pa.RecordBatch.from_pydict({"key": part.column("key").take(pa.array(r)), "item": ids.take(pa.array(k)), "first_word": pa.array(a), "n_words": pa.array(size), "n_equal": pa.array(n)})

        found = rows.mapInArrow(run, f"key {kinds[key]}, item {item_kind}, first_word long, n_words long, n_equal long")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "first_word", "n_words", "n_equal")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, contaminated, n_items, items (ids in order), longest (words of the longest overlap)."""
    item_kind = dict(benchmark.dtypes)["item_id"]
    found = leaks(docs, benchmark, text, key).groupBy(F.col(key).alias("found")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("n_words").alias("longest"))
    return docs.select(key).join(found, F.col(key).eqNullSafe(F.col("found")), "left").select(
        key,
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast(f"array<{item_kind}>")).alias("items"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
    )
