"""Phrase collocations: suffix automata per shard count phrases, the counts are summed over all shards.

A shard is some hundred thousand words of a task's texts. Its automaton has the phrases of at most ``depth`` words; a state is a
class of phrases that end at the same places, a state's link leads to the class of its longest phrase's longest ending
that has more places. It is built level by level for all places at once: places whose last k words agree are one node,
and a node that has as many places as the one it grew from is the same state.

Every phrase of a frequent phrase is frequent. So the automata grow in rounds (words, then depths 3 and 5), and in each round only
runs of words are read whose phrases of the round before can be frequent. Frequent words are known exactly, frequent phrases
by a filter of bounded size that knows all of them and some others by accident: it saves work and never decides a result.
Pairs don't decide what the round of triples reads: how many of them are frequent grows faster than the corpus, and so would its rows.

Words are named by 64-bit hashes of language and word. All words of the corpus are counted by their text first, and where a
frequent name is shared by two words another seed is taken; so names are exact. In all that follows a frequent word is its place
among the sorted names, from 1, and a phrase is packed into as few longs as these places need, three words each below two million.

Defined results: null texts are empty, null languages are ``und``. Repeated rows count as often as they stand. Equal
scores rank by count, then by the phrase's bytes. An empty table, or one without frequent phrases, gives no rows.
Columns other than text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import BROADCAST_ROWS, discard, hashes, long_of, mixed, offsets_of, slices, stored

LEAST, TOP, LONGEST = 100, 2000, 5
#: Depths of the automata, round by round.
ROUNDS = (3, 5)
#: Words of a shard, and bytes of text that are cut into words at once.
SHARD_WORDS, TEXT_BYTES = 1 << 18, 2 << 20
#: Bits of the filter of frequent phrases, at most (8 MB), and bits for each phrase below that.
FILTER_BITS, BITS_EACH = 26, 32
NO_LANG = "und"

GAP, BREAK, WORD = 0, 1, 2
KIND = np.full(256, WORD, np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# ---------------------------------------------------------------- words of texts
class Words:
    """The words of a batch: a code for each word in order, whether a piece begins at it, distinct words and languages."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, off = offsets_of(pc.ascii_lower(pc.fill_null(texts, "")))
        kind = KIND[raw] if len(raw) else np.zeros(0, np.uint8)
        word = kind == WORD
        border = np.zeros(len(raw) + 1, bool)
        border[off] = True
        before = np.concatenate([[False], word[:-1]]) if len(raw) else word
        start = np.flatnonzero(word & (~before | border[:-1]))
        after = np.concatenate([word[1:], [False]]) if len(raw) else word
        stop = np.flatnonzero(word & (~after | border[1:])) + 1
        self.owner = np.searchsorted(off, start, "right") - 1
        breaks = np.cumsum(kind == BREAK) if len(raw) else np.zeros(0, np.int64)
        self.opens = np.ones(len(start), bool)
        self.opens[1:] = (self.owner[1:] != self.owner[:-1]) | (breaks[start[1:]] != breaks[start[:-1]])
        size = stop - start
        upto = np.cumsum(size)
        kept = raw[np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size - start, size)]
        flat = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], upto]).astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes()))
        coded, lang = flat.dictionary_encode(), pc.fill_null(langs, NO_LANG).dictionary_encode()
        self.lang_names = lang.dictionary
        self.lang = lang.indices.to_numpy()[self.owner]
        self.names, self.code = coded.dictionary, coded.indices.to_numpy()

    def symbols(self, vocabulary: np.ndarray, seed: int) -> np.ndarray:
        """The number of each word in its language, 0 for words that aren't frequent."""
        word, lang = hashes(self.names), hashes(self.lang_names)
        if len(word) * len(lang) > len(self.code):
            return numbers(named(word[self.code], lang[self.lang], seed), vocabulary)
        return numbers(named(word[None, :], lang[:, None], seed).ravel(), vocabulary)[self.lang.astype(np.int64) * len(word) + self.code]


def named(word: np.ndarray, lang: np.ndarray, seed: int) -> np.ndarray:
    return mixed(word * _MIX[0] + mixed(lang + np.uint64(seed)))


def numbers(names: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places of names in the sorted vocabulary, from 1; 0 for those it lacks."""
    at = np.minimum(np.searchsorted(vocabulary, names), max(0, len(vocabulary) - 1))
    return np.where(vocabulary[at] == names, at + 1, 0).astype(np.uint64) if len(vocabulary) else np.zeros(len(names), np.uint64)


def batches_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            yield Words(part.column("text"), part.column("lang"))


# ---------------------------------------------------------------- the automaton of a shard
class Automaton:
    """All phrases of up to ``depth`` symbols of a sequence, within its runs.

    ``levels[k - 1]`` has the phrases of k symbols: ``count`` places, ``link`` the phrase without its first symbol (on the
    level below), ``stem`` the phrase without its last one, ``last`` that symbol. ``deeper`` says that a phrase has the same
    places as a longer one, so that both are one state."""

    def __init__(self, symbols: np.ndarray, opens: np.ndarray, depth: int):
        self.alphabet, code = np.unique(symbols, return_inverse=True)
        at = np.arange(len(symbols))
        run = at - np.maximum.accumulate(np.where(opens, at, 0)) if len(at) else at  # words of the run before this one
        node = code.astype(np.int64)
        self.levels: list[dict[str, np.ndarray]] = []
        places, before = at, np.zeros(len(at), np.int64)
        size = len(self.alphabet)
        for k in range(1, depth + 1):
            if k == 1:
                count = np.bincount(node, minlength=size)
                level = {"count": count, "link": np.zeros(size, np.int64), "stem": np.zeros(size, np.int64), "last": np.arange(size)}
                place_node = node
            else:
                places = places[run[places] >= k - 1]
                # same last k - 1 symbols, same symbol before them
                key = before[places] * np.int64(len(self.alphabet)) + code[places - k + 1]
                key, first, own, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                example = places[first]
                level = {"count": count, "link": before[example], "stem": before[example - 1], "last": code[example]}
                place_node = own
            before = np.zeros(len(at), np.int64)
            before[places] = place_node
            level["deeper"] = np.zeros(len(level["count"]), bool)
            if k > 1:
                above = self.levels[-1]
                same = above["count"][level["link"]] == level["count"]
                above["deeper"][level["link"][same]] = True
            self.levels.append(level)

    def phrases(self, k: int) -> np.ndarray:
        """The symbols of all phrases of k symbols, one row each."""
        level, out = np.arange(len(self.levels[k - 1]["count"])), []
        for j in range(k, 0, -1):
            out.append(self.alphabet[self.levels[j - 1]["last"][level]])
            level = self.levels[j - 1]["stem"][level]
        return np.stack(out[::-1], 1)


# ---------------------------------------------------------------- phrases as longs
def width(size: int) -> int:
    """Bits of a word's number where there are ``size`` frequent words."""
    return max(1, int(size).bit_length())


def packed(rows: np.ndarray, bits: int, columns: int) -> list[np.ndarray]:
    """``columns`` longs for each phrase (a row of numbers); the first word is in the lowest bits, what a phrase lacks is 0."""
    each, out = 63 // bits, []
    for c in range(columns):
        total = np.zeros(len(rows), np.uint64)
        for j, number in enumerate(rows[:, c * each : (c + 1) * each].T):
            total |= number.astype(np.uint64) << np.uint64(j * bits)
        out.append(long_of(total))
    return out


def unpacked(names: list[str], bits: int, depth: int) -> Column:
    """The array of the numbers of a phrase that was packed into these columns."""
    each = 63 // bits
    number = lambda j: F.shiftright(names[j // each], j % each * bits).bitwiseAND((1 << bits) - 1)
    return F.filter(F.array(*map(number, range(depth))), lambda x: x != 0)


# ---------------------------------------------------------------- filters of frequent phrases
def bucket_keys(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k symbols, by where it begins."""
    n = max(0, len(symbols) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += symbols[j : j + n] * _MIX[j]
    return mixed(out)


class Filter:
    """A bitmap that holds all frequent phrases of k words."""

    def __init__(self, bits: np.ndarray, k: int):
        self.bits, self.k = bits, k
        self.mask = np.uint64(len(bits) * 64 - 1)

    def has(self, symbols: np.ndarray) -> np.ndarray:
        """Whether the phrase that begins at each place may be frequent."""
        slot = bucket_keys(symbols, self.k) & self.mask
        return (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def filter_of(frequent: DataFrame, k: int) -> Filter:
    """The filter of all phrases in ``frequent`` (arrays p of k numbers); it is put together by Spark and has a bounded size."""
    size = frequent.count()
    bits = min(FILTER_BITS, max(10, int(size * BITS_EACH).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column(0).flatten().to_numpy().view(np.uint64).reshape(-1, k)
            total = np.zeros(len(symbols), np.uint64)
            for j in range(k):
                total += symbols[:, j] * _MIX[j]
            slot = mixed(total) & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_pydict({"word": (slot >> np.uint64(6)).astype(np.int32), "bit": long_of(np.uint64(1) << (slot & np.uint64(63)))})

    words = frequent.select("p").mapInArrow(slots, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # 12 bytes for each 64 bits at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Filter(out, k)


def runs_of(words: Words, seed: int, vocabulary: np.ndarray, known: list[Filter]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, whether a run begins there) of the runs in which all words are frequent and all phrases may be that the last
    filter knows; runs that are no longer than its phrases (than one word) are left out, their counts are known."""
    symbols, opens = words.symbols(vocabulary, seed), words.opens
    for i in range(len(known) + 1):  # words clear most of the ground
        k = known[i - 1].k if i else 1
        n = len(symbols)
        if n < k:
            return symbols[:0], opens[:0]
        inside = np.ones(n - k + 1, bool)
        for j in range(1, k):
            inside &= ~opens[j : j + n - k + 1]
        good = np.zeros(n, bool)
        good[: n - k + 1] = inside & (known[i - 1].has(symbols) if i else symbols != 0)
        # a run is a stretch of places at which good phrases begin, and the k - 1 words behind it
        begins = good & (opens | ~np.concatenate([[False], good[:-1]]))
        ends = good & np.concatenate([opens[1:] | ~good[1:], [True]])
        start, size = np.flatnonzero(begins), np.flatnonzero(ends) - np.flatnonzero(begins) + k
        if i == len(known):
            start, size = start[size > k], size[size > k]
        total = np.cumsum(size)
        take = np.arange(total[-1] if len(total) else 0) - np.repeat(total - size - start, size)
        symbols = symbols[take]
        opens = np.zeros(len(symbols), bool)
        opens[total - size] = True
    return symbols, opens


# ---------------------------------------------------------------- counts
def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, w1, f) of every word of every language; w1 is its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in batches_of_words(batches):
            if not len(w.code):
                continue
            pair, count = np.unique(w.lang.astype(np.int64) * len(w.names) + w.code, return_counts=True)
            word, lang = w.names.take(pa.array(pair % len(w.names))), w.lang_names.take(pa.array(pair // len(w.names)))
            yield pa.RecordBatch.from_pydict({"lang": lang, "word": word, "w1": long_of(named(hashes(word), hashes(lang), seed)), "f": count.astype(np.int64)})

    return docs.mapInArrow(run, "lang string, word string, w1 long, f long").groupBy("lang", "word", "w1").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, seed: int, vocabulary: np.ndarray, known: list[Filter], depth: int) -> DataFrame:
    """(p, f): every phrase longer than the last filter's, of at most ``depth`` words, that can be frequent, with its count."""
    least = known[-1].k + 1 if known else 2
    bits = width(len(vocabulary))
    names = [f"p{c + 1}" for c in range(-(-depth // (63 // bits)))]

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        shard = Automaton(np.concatenate([s for s, _ in parts]), np.concatenate([o for _, o in parts]), depth)
        for k in range(least, depth + 1):
            rows, count = shard.phrases(k), shard.levels[k - 1]["count"]
            if len(rows):
                yield pa.RecordBatch.from_arrays([*map(pa.array, packed(rows, bits, len(names))), pa.array(count.astype(np.int64))], [*names, "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for w in batches_of_words(batches):
            waiting.append(runs_of(w, seed, vocabulary, known))
            held += len(waiting[-1][0])
            if held >= SHARD_WORDS:
                yield from counted(waiting)
                waiting, held = [], 0
        if held:
            yield from counted(waiting)

    rows = docs.mapInArrow(run, ", ".join(f"{p} long" for p in names) + ", f long")
    return rows.groupBy(*names).agg(F.sum("f").alias("f")).select(unpacked(names, bits, depth).alias("p"), "f")


def numbered(common: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The frequent words with their numbers as w1, and their sorted names: eight bytes for each go to the driver and to all tasks."""
    vocabulary = np.sort(common.select("w1").toArrow()["w1"].to_numpy().view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = numbers(batch.column("w1").to_numpy().view(np.uint64), vocabulary)
            yield batch.set_column(batch.schema.get_field_index("w1"), "w1", pa.array(long_of(number)))

    return common.mapInArrow(run, common.schema), vocabulary


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((lang, word, w1, f) of frequent words, (lang, n) of all words, (p, f) of all frequent phrases, p their names)."""
    seed = 0
    while True:
        words = stored(word_counts(docs, seed), "words")
        twice = words.groupBy("w1").agg(F.count("*").alias("own"), F.max("f").alias("f")).where(F.col("own") > 1)
        if twice.where(F.col("f") >= least).isEmpty():
            break
        seed += 1
        discard(words)
    sizes = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    named_words = stored(words.where(F.col("f") >= least), "named")
    discard(words)
    common, vocabulary = numbered(named_words)
    common = stored(common, "common")
    discard(named_words)
    found = [common.select(F.array("w1").alias("p"), "f")]
    known: list[Filter] = []
    for depth in sorted({min(d, longest) for d in ROUNDS}):
        counts = stored(phrase_counts(docs, seed, vocabulary, known, depth).where(F.col("f") >= least), f"phrases{depth}")
        found.append(counts)
        if depth < longest:
            known.append(filter_of(counts.where(F.size("p") == depth), depth))
    table = found[0]
    for more in found[1:]:
        table = table.unionByName(more)
    return common, sizes, table


# ---------------------------------------------------------------- scores
def subsumed(phrases: DataFrame) -> DataFrame:
    """(p, f) of phrases that are the ending or the beginning of a phrase one word longer with as many places. Counts never
    grow with a phrase, so a phrase inside any longer one with its count is inside one of these."""
    long = phrases.where(F.size("p") > 2)
    ending = long.select(F.expr("slice(p, 2, size(p) - 1)").alias("p"), "f")  # where the suffix link leads
    return ending.unionByName(long.select(F.expr("slice(p, 1, size(p) - 1)").alias("p"), "f")).distinct()


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words that occur ``least`` times,
    by the score of their weakest cut, 1000 * a * n / (l * r) rounded down; phrases inside a longer one of the same count are left out."""
    docs = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    common, sizes, table = frequent_phrases(docs, least, longest)
    phrases = table.where(F.size("p") > 1).withColumnRenamed("f", "a")
    kept = phrases.join(subsumed(table).withColumnRenamed("f", "a"), ["p", "a"], "left_anti")
    small = common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    first = common.select("lang", "word", "w1")
    first = F.broadcast(first) if small else first
    kept = kept.withColumn("w1", F.col("p")[0]).join(first.drop("word"), "w1").join(sizes, "lang").select("p", "a", "lang", "n")
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size(p) - 1)"))).withColumn("left", F.expr("slice(p, 1, k)")).withColumn("right", F.expr("slice(p, k + 1, size(p) - k)"))
    cuts = cuts.join(table.select(F.col("p").alias("left"), F.col("f").alias("l")), "left").join(table.select(F.col("p").alias("right"), F.col("f").alias("r")), "right")
    wide = "cast({} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(1000 * {wide.format('a')} as decimal(19, 0)) * {wide.format('n')} div ({wide.format('l')} * {wide.format('r')})"))
    scored = cuts.groupBy("p", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("p", "lang", "a", "n", "cut.score", "cut.l", "cut.r")
    spelled = scored.select("*", F.posexplode("p").alias("at", "w1")).join(first.drop("lang"), "w1")
    spelled = spelled.groupBy("p", "lang", "a", "n", "score", "l", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # every task keeps ``top`` rows a language before the shuffle
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
