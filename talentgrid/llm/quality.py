"""Quality classification with supervised subword embeddings.

A text is a bag of features: its words, their character n-grams (three to five bytes, with marks at
the word's ends) and its repeated neighbouring words, all hashed into buckets, and one feature that
every text has. Each bucket has a learned vector; the average of a text's vectors goes through a
softmax over the two labels. Vectors and softmax are trained with stochastic gradient descent in
numpy on a bounded sample of labelled rows. Since the softmax's input is linear in the vectors, a
frozen model scores a text by adding one number for each feature.

Empty and null texts have only the common feature and so the score of its vector. Without labelled
rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import _BYTE, discard, hashes, lean, mixed, offsets_of, places, slices, stored, trim, words_of

BITS = 16
SIZES = (3, 4, 5)
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.4
#: About so many labelled rows are learned from (a documented bound of the fit).
TRAIN_ROWS = 5000
#: Parts in which the features of these rows come to the driver.
PARTS = 8
THRESHOLD = 0.3
ALWAYS, REPEAT = 0, 1  # buckets of the common feature and of repeated words


def bucket(h: np.ndarray) -> np.ndarray:
    return (2 + (h >> np.uint64(16)) % np.uint64((1 << BITS) - 2)).astype(np.int32)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' features, how many each word has): the word itself and its n-grams."""
    own = bucket(mixed(hashes(words) ^ np.uint64(0x5851F42D4C957F2D)))
    marked = pc.binary_join_element_wise(pa.scalar("<"), words, pa.scalar(">"), pa.scalar(""))
    raw, off = offsets_of(marked)
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), size)
    left = np.repeat(off[1:], size) - np.arange(len(raw))  # bytes from here to the word's end
    got, whose = [own], [np.arange(len(words))]
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h += _BYTE[raw[at + j]] * places(8)[j]
        got.append(bucket(mixed(h + np.uint64(n))))
        whose.append(owner[at])
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(got)[order], np.bincount(whose, minlength=len(words))


def bags(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, which word each token is, offsets of each text, repeats in each text)."""
    flat, off = words_of(texts, lower=False)
    coded = flat.dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    same = np.zeros(len(at) + 1, np.int64)
    if len(at) > 1:
        same[1:-1] = at[1:] == at[:-1]
        first = off[:-1][off[:-1] < len(at)]
        same[first] = 0
    upto = np.concatenate([[0], np.cumsum(same)])
    return coded.dictionary, at, off, upto[off[1:]] - upto[off[:-1]]


class Model:
    """Bucket vectors and softmax weights."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray):
        self.vectors, self.weights = vectors, weights
        self.margin = (vectors @ (weights[1] - weights[0])).astype(np.float64)  # of label 1 over label 0

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, at, off, repeats = bags(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        if len(at):
            features, n = word_features(words)
            ends = np.cumsum(n)
            of_word = np.add.reduceat(self.margin[features], ends - n)
            for values, into in ((of_word, total), (n, count)):
                upto = np.concatenate([[0.0], np.cumsum(values[at], dtype=np.float64)])
                into += upto[off[1:]] - upto[off[:-1]]
        total += self.margin[ALWAYS] + repeats * self.margin[REPEAT]
        return 1 / (1 + np.exp(-np.clip(total / (count + 1 + repeats), -700, 700)))


def features_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, share of each) for every text."""
    words, at, off, repeats = bags(texts)
    features, n = word_features(words) if len(at) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    ends = np.cumsum(n)
    for a, b, r in zip(off[:-1].tolist(), off[1:].tolist(), repeats.tolist()):
        w = at[a:b]
        size = n[w]
        own = features[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - (ends - n)[w], size)] if b > a else features[:0]
        key, count = np.unique(np.concatenate([own, np.full(r, REPEAT, np.int32), [np.int32(ALWAYS)]]), return_counts=True)
        yield key.astype(np.int32), (count / count.sum()).astype(np.float32)


def train(features: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent on the log loss, with a rate that falls to nothing."""
    dice = np.random.default_rng(seed)
    vectors = dice.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS))
    weights = np.zeros((2, DIMENSIONS))
    size, step, done, steps = len(labels), 16, 0, EPOCHS * len(labels)
    for _ in range(EPOCHS):
        order = dice.permutation(size)
        for k in range(0, size, step):
            rows = order[k : k + step]
            f = np.concatenate([features[i] for i in rows]).astype(np.int64)
            s = np.concatenate([shares[i] for i in rows])[:, None].astype(np.float64)
            n = np.array([len(features[i]) for i in rows])
            hidden = np.add.reduceat(vectors[f] * s, np.cumsum(n) - n, axis=0)
            z = hidden @ weights.T
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            rate = RATE * (1 - done / steps) * 4
            back = p @ weights
            weights -= rate / len(rows) * (p.T @ hidden) * 4
            change = np.repeat(back, n, axis=0) * s * -rate
            for d in range(DIMENSIONS):
                vectors[:, d] += np.bincount(f, weights=change[:, d], minlength=1 << BITS)
            done += len(rows)
    return Model(vectors, weights)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Learn from about ``rows`` labelled rows, chosen by a hash of the key. Features are made in the tasks; null labels
    don't count, and of several labels of one key the largest holds."""
    lean(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    total = known.count()
    dice = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    sample = known.where(dice * F.lit(total) < F.lit(rows * 1_000_000))
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = list(features_of(part.column("text")))
                yield pa.RecordBatch.from_pydict({
                    "key": part.column("key").cast(pa.string()),
                    "label": part.column("label").cast(pa.int32()),
                    "features": pa.array([f.astype(np.uint16).tobytes() for f, _ in got], pa.binary()),
                    "shares": pa.array([s.tobytes() for _, s in got], pa.binary()),
                })

    # written once, then brought to the driver part by part, so that only the features themselves are held there
    made = chosen.select("key", "label", "text").mapInArrow(make, "key string, label int, features binary, shares binary")
    made = stored(made.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS))), "features")
    rows = []
    for k in range(PARTS):
        part = made.where(F.col("part") == k).drop("part").toArrow()
        columns = (part.column(c).to_pylist() for c in ("key", "label", "features", "shares"))
        rows += [(key, label, np.frombuffer(f, np.uint16), np.frombuffer(s, np.float32)) for key, label, f, s in zip(*columns)]
        del part, columns
    discard(made)
    if not rows:
        return Model(np.zeros((1 << BITS, DIMENSIONS)), np.zeros((2, DIMENSIONS)))
    rows.sort(key=lambda r: r[0])
    model = train([r[2] for r in rows], [r[3] for r in rows], np.array([r[1] for r in rows], np.int64))
    del rows
    trim()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, name: str = "score") -> DataFrame:
    """All columns of docs but one of that name, then ``name`` and ``predicted``."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (name, "predicted")]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, text):
                p = own.scores(part.column(text))
                cols = [part.column(c) for c in kept] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, [*kept, name, "predicted"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{name}` double, predicted int"
    return docs.select(*kept).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Rows whose labels nothing may be learned from."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0
