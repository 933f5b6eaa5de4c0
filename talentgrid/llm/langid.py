"""Language identification by prediction by partial matching.

For each language, a tree of byte contexts up to three bytes deep is counted from a bounded sample of
labelled texts and then frozen. A byte seen in its context has probability c / (T + U), T being the
context's count and U its number of distinct bytes; the escape U / (T + U) goes to the bytes not seen,
shared out as the next shorter context says, without those seen; below the empty context all bytes
are alike. The probabilities of each context add up to one, so the negative log is an exact code
length. A text's language is the one that codes the whole lower-cased text, byte by byte, in the fewest bits.

Texts without a letter, empty and null texts are ``und`` with score 0, whatever else they hold. Equal code
lengths go to the language that sorts first. Without any labelled text everything is ``und``. Texts may be of
any length: code lengths add up slice by slice of a batch. Each row, repeated ones too, gets a row of its own;
nothing is learned from a row whose key is null, and it counts as held out. Other columns of the input are
ignored unless ``keep`` names them, so names that clash with those of the result do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import offsets_of, slices

DEPTH = 3
#: About so many labelled texts of each language are learned from (a documented bound of the fit).
TRAIN_TEXTS = 400
UNDETERMINED = "und"


def prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the whole lower-cased texts, each with DEPTH spaces before it; null counts as empty."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    texts = pc.binary_join_element_wise(pa.scalar(" " * DEPTH), texts, pa.scalar(""))
    return offsets_of(texts)


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each byte behind its three predecessors as one number, offsets of each text)."""
    r = raw.astype(np.uint32)
    g = np.zeros(len(r), np.uint32)
    g[DEPTH:] = (r[:-3] << 24) | (r[1:-2] << 16) | (r[2:-1] << 8) | r[3:]
    inside = np.ones(len(r), bool)
    for k in range(DEPTH):
        inside[off[:-1] + k] = False
    return g[inside], off - DEPTH * np.arange(len(off))


class ContextTree:
    """The frozen statistics of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.order = []  # of each depth, from 0: keys, log2 of probability; contexts, log2 of what the rest is scaled by
        for depth in range(DEPTH + 1):
            k = keys & np.uint32((1 << (8 * (depth + 1))) - 1)
            key, back = np.unique(k, return_inverse=True)
            count = np.bincount(back, weights=counts)
            ctx, own = np.unique(key >> np.uint32(8), return_inverse=True)
            total, distinct = np.bincount(own, weights=count), np.bincount(own)
            p = count / (total + distinct)[own]
            shorter = 2.0 ** -self._bits(key & np.uint32((1 << (8 * depth)) - 1), depth - 1) if depth else np.full(len(key), 1 / 256)
            unseen = np.maximum(1 - np.bincount(own, weights=shorter), 1e-9)
            scale = distinct / (total + distinct) / unseen
            self.order.append((key, -np.log2(p), ctx, -np.log2(scale)))

    def _bits(self, key: np.ndarray, depth: int) -> np.ndarray:
        """Code length of the last byte of each key in its context of that depth."""
        if depth < 0:
            return np.full(len(key), 8.0)
        keys, bits, ctx, scale = self.order[depth]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        seen = keys[at] == key
        out = np.where(seen, bits[at], 0.0)
        miss = np.flatnonzero(~seen)
        if len(miss):
            k = key[miss]
            c = np.minimum(np.searchsorted(ctx, k >> np.uint32(8)), len(ctx) - 1)
            escape = np.where(ctx[c] == k >> np.uint32(8), scale[c], 0.0)
            out[miss] = escape + self._bits(k & np.uint32((1 << (8 * depth)) - 1), depth - 1)
        return out

    def bits(self, key: np.ndarray) -> np.ndarray:
        return self._bits(key, DEPTH)


class Model:
    """Code lengths of all languages for the byte strings that any of them knows."""

    #: Byte pairs with a row and column of their own in the lookup table.
    PAIRS = 4096

    def __init__(self, langs: list[str], keys: list[np.ndarray], counts: list[np.ndarray]):
        self.langs = langs
        self.trees = [ContextTree(k, c) for k, c in zip(keys, counts)]
        known = np.unique(np.concatenate(keys))
        n = np.zeros(65536, np.int64)
        for half in (known >> np.uint32(16), known & np.uint32(0xFFFF)):
            n += np.bincount(half, minlength=65536)
        pairs = np.argsort(-n, kind="stable")[: min(self.PAIRS - 1, int((n > 0).sum()))]
        self.pair = np.zeros(65536, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.width = len(pairs) + 1
        known = known[(self.pair[known >> np.uint32(16)] > 0) & (self.pair[known & np.uint32(0xFFFF)] > 0)]
        self.row = np.zeros(self.width * self.width, np.int32)
        self.row[self.pair[known >> np.uint32(16)] * self.width + self.pair[known & np.uint32(0xFFFF)]] = np.arange(1, len(known) + 1)
        self.cost = np.zeros((len(langs), len(known) + 1), np.float32)
        for k, tree in enumerate(self.trees):
            self.cost[k, 1:] = tree.bits(known)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code length in bits of each text in each language."""
        g, off = grams(*prepared(texts))
        out = np.zeros((len(texts), len(self.langs)))
        full = np.diff(off) > 0
        if not full.any():
            return out
        row = self.row[self.pair[g >> np.uint32(16)] * self.width + self.pair[g & np.uint32(0xFFFF)]]
        odd = np.flatnonzero(row == 0)
        new, back = np.unique(g[odd], return_inverse=True)
        row[odd] = self.cost.shape[1] + back
        for k, tree in enumerate(self.trees):
            cost = np.concatenate([self.cost[k], tree.bits(new).astype(np.float32)])
            out[full, k] = np.add.reduceat(cost[row], off[:-1][full], dtype=np.float64)
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts: int = TRAIN_TEXTS) -> Model | None:
    """Learn from about ``texts`` rows of each language, chosen by a hash of the key; rows without text or language don't count.
    Counting is distributed; the driver receives one number for each distinct byte string and language of the sample."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"))
    dice = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    sample = known.join(F.broadcast(sizes), "lang").where(dice * F.col("rows") < F.lit(texts * 1_000_000)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang")
                for one in pc.unique(langs).to_pylist():
                    g, _ = grams(*prepared(part.column("text").filter(pc.equal(langs, one))))
                    keys, n = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([one] * len(keys), pa.string()), "gram": pa.array(keys.astype(np.int64)), "n": pa.array(n)})

    rows = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(pc.unique(rows.column("lang")).to_pylist())
    if not langs:
        return None
    keys, counts = [], []
    for one in langs:
        part = rows.filter(pc.equal(rows.column("lang"), one))
        keys.append(part.column("gram").to_numpy().astype(np.uint32))
        counts.append(part.column("n").to_numpy().astype(np.float64))
    return Model(langs, keys, counts)


def predict(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, lang_pred, score, bits_per_byte) for each row; the score is the language's share of the likelihood."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, text):
                texts = pc.fill_null(part.column(text), "")
                has = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) & (own is not None)
                cols = {c: part.column(c) for c in (key, *keep)}
                if own is None:
                    names, score, rate = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts))
                else:
                    bits = own.lengths(texts)
                    best = bits.argmin(1)
                    least = bits[np.arange(len(bits)), best]
                    score = np.where(has, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0.0)
                    names = np.where(has, np.array(own.langs, object)[best], UNDETERMINED)
                    rate = np.where(has, least / np.maximum(pc.binary_length(texts).to_numpy(zero_copy_only=False), 1), 0.0)
                yield pa.RecordBatch.from_pydict(cols | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "bits_per_byte": pa.array(rate)})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", lang_pred string, score double, bits_per_byte double"
    return docs.select(key, *keep, text).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Rows that nothing may be learned from; those without a key are among them."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
