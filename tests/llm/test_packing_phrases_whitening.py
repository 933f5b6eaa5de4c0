"""Packing against the smallest number of sequences, phrases against plain counting, whitening against plain linear algebra; odd rows for all."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from talentgrid.llm import packing, phrases, whitening

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, length long, part int"


# ---------------------------------------------------------------- packing
def fewest(items, limit):
    """The smallest number of sequences, by trying all ways."""
    items = sorted(items, reverse=True)

    def fits(rooms, i):
        if i == len(items):
            return True
        tried = set()
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in tried:
                tried.add(room)
                rooms[k] -= items[i]
                if fits(rooms, i + 1):
                    return True
                rooms[k] += items[i]
        return False

    n = 0
    while not fits([limit] * n, 0):
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.integers(8, 60).flatmap(lambda limit: st.tuples(st.just(limit), st.lists(st.integers(1, limit), max_size=10))))
def test_plan_is_smallest(case):
    limit, items = case
    counts = dict(Counter(items))
    plan = packing.planned(counts, limit)
    used = Counter()
    for filling, times in plan:
        assert sum(length * many for length, many in filling) <= limit and times > 0
        for length, many in filling:
            used[length] += many * times
    assert used == counts and packing.len_of(plan) == fewest(items, limit)
    assert packing.lower_bound(counts, limit) <= packing.len_of(plan) <= packing.len_of(packing.best_fit(counts, limit))


def test_plan_beats_best_fit():
    dice = np.random.default_rng(5)
    counts = dict(Counter(dice.integers(900, 2600, 20_000).tolist()))
    plan = packing.len_of(packing.planned(counts))
    assert packing.lower_bound(counts, 4096) <= plan < packing.len_of(packing.best_fit(counts, 4096))
    # as many steps whatever the corpus holds: a thousand times the pieces
    more = {length: 1000 * n for length, n in counts.items()}
    assert packing.len_of(packing.planned(more)) <= 1000 * plan


def test_pack(spark):
    dice = np.random.default_rng(7)
    word = ["river", "stone", "Café", "a", "unbelievable", "x9", "<|endoftext|>"]
    rows = [(i, " ".join(dice.choice(word, dice.integers(1, 60))), "en", 1, 2) for i in range(300)]
    rows += [(900 + i, rows[3][1], "en", 1, 2) for i in range(150)]  # copies: one length has a third of all rows
    rows += [(300, None, None, None, None), (301, "", "en", 0, 0), (302, " \n", "en", 0, 0), (None, "lost id", "en", 1, 1), (None, "lost id", "en", 1, 1), (5, "again", "en", 1, 1)]
    rows += [(400, "long " * 900, "en", 1, 1), (401, "x" * 5000, "en", 1, 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    limit = 256
    packed = packing.pack(df, WORD_BPE, limit, ids=True)
    got = packed.collect()
    coder = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, text, *_ in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), limit):
            piece = ids[k : k + limit]
            want[i, k // limit, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, r.ids))
    for own in by.values():
        at = 0
        for offset, length, ids in sorted(own):
            assert offset == at and length == len(ids)
            at += length
        assert at <= limit
    counts = dict(Counter(r.length for r in got))
    assert packing.lower_bound(counts, limit) <= len(by) == packing.len_of(packing.planned(counts, limit))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert {k: len(v) for k, v in whole.items()} == {k: sum(n for _, n, _ in own) for k, own in by.items()}
    assert all(whole[k] == [t for *_, ids in sorted(own) for t in ids] for k, own in by.items())


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), WORD_BPE).count() == 0


# ---------------------------------------------------------------- phrases
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least, top, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, l, r = min(((1000 * a * n[lang]) // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def phrase_rows():
    dice = np.random.default_rng(2)
    words = ["The", "cat", "sat", "on", "mat", "É", "é", "dog", "\x1ca", "new york", "x" * 40]
    rows = []
    for i in range(260):
        own = [" ".join(dice.choice(words, dice.integers(1, 9))) for _ in range(dice.integers(1, 6))]
        if i % 2:
            own.append("kick the old bucket now")
        rows.append((dice.choice([". ", "\n", "!?", "\t", ", "]).join(own), [None, "en", "de", "und", ""][i % 5]))
    rows += [(rows[0][0], "en")] * 30 + [(None, "en"), ("", None), ("  \t", "en"), (".,;", "fr"), ("a A a A a A a A a A a A", "fr"), ("lone", "en"), ("one two " * 3000, "en")]
    return rows


@pytest.mark.parametrize("shard, top", [(1 << 18, 2000), (50, 7)])
def test_collocations(spark, monkeypatch, shard, top):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "TEXT_BYTES", 3000)
    rows = phrase_rows()
    df = spark.createDataFrame([(i, t, g, 1, 2) for i, (t, g) in enumerate(rows)], DOCS).repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, least=8, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_collocations(rows, 8, top)


@pytest.mark.parametrize("bits", [25, 40])
def test_phrases_in_several_longs(spark, monkeypatch, bits):
    monkeypatch.setattr(phrases, "width", lambda size: bits)
    rows = phrase_rows()[:120]
    df = spark.createDataFrame([(i, t, g, 1, 2) for i, (t, g) in enumerate(rows)], DOCS)
    assert {tuple(r) for r in phrases.collocations(df, least=6).collect()} == plain_collocations(rows, 6, 2000)


def test_rows_of_a_round_grow_with_the_texts(spark, monkeypatch):
    """Nearly all pairs are frequent in the larger table and none in the smaller one; the rounds' rows are in proportion to the words."""
    made, real = {}, phrases.phrase_counts

    def counted(*args):
        found = real(*args)
        made.setdefault(args[-1], []).append(found.count())
        return found

    monkeypatch.setattr(phrases, "phrase_counts", counted)
    dice = np.random.default_rng(5)
    for size in (80, 400):
        texts = [" ".join(f"w{k}" for k in dice.integers(0, 40, 100)) for _ in range(size)]
        phrases.collocations(spark.createDataFrame([(i, t, "en", 1, 2) for i, t in enumerate(texts)], DOCS), least=20)
    assert made[3][1] > 20_000 and made[3][1] <= 6 * made[3][0], made


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "few words here", "en", 1, 1)], DOCS)).count() == 0


def test_shared_names_take_another_seed(spark, monkeypatch):
    real = phrases.named
    monkeypatch.setattr(phrases, "named", lambda word, lang, seed: real(word, lang, seed) & np.uint64(3) if seed == 0 else real(word, lang, seed))
    rows = phrase_rows()[:80]
    df = spark.createDataFrame([(i, t, g, 1, 2) for i, (t, g) in enumerate(rows)], DOCS)
    assert {tuple(r) for r in phrases.collocations(df, least=6).collect()} == plain_collocations(rows, 6, 2000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=6))
def test_automaton(runs):
    symbols = np.array([s for r in runs for s in r], np.uint64)
    opens = np.concatenate([[True] + [False] * (len(r) - 1) for r in runs])
    shard = phrases.Automaton(symbols, opens, 4)
    places = defaultdict(set)
    at = 0
    for r in runs:
        for i in range(len(r)):
            for k in range(1, min(4, i + 1) + 1):
                places[tuple(r[i - k + 1 : i + 1])].add(at + i)
        at += len(r)
    for k in range(1, 5):
        rows, level = [tuple(map(int, p)) for p in shard.phrases(k)], shard.levels[k - 1]
        assert dict(zip(rows, level["count"].tolist())) == {p: len(x) for p, x in places.items() if len(p) == k}
        below = [tuple(map(int, p)) for p in shard.phrases(k - 1)] if k > 1 else []
        for j, p in enumerate(rows):
            if k > 1:
                assert below[level["link"][j]] == p[1:] and below[level["stem"][j]] == p[:-1]
            # one state with a longer phrase exactly where some word stands before all places
            assert level["deeper"][j] == any(len(q) == k + 1 <= 4 and q[1:] == p and places[q] == places[p] for q in places)


# ---------------------------------------------------------------- whitening
VECTORS = "vec_id long, embedding array<float>, label int, component int"


def exact_x(v):
    return [int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v]


def test_whitening(spark):
    dice = np.random.default_rng(4)
    mix = dice.normal(size=(12, 12))
    rows = [(i, (dice.normal(size=12) @ mix * 3).tolist(), 0, 1) for i in range(500)]
    rows += [(900 + i, rows[0][1], 0, 1) for i in range(200)]  # copies
    good = list(rows)
    rows += [(1, None, 0, 1), (2, [], 0, 1), (3, [None] + [1.0] * 11, 0, 1), (4, [float("nan")] * 12, 0, 1), (5, [float("inf")] * 12, 0, 1), (6, [1.0] * 5, 0, 1), (7, [3e38] * 12, 0, 1)]
    rows += [(None, rows[1][1], None, None), (2008, rows[2][1], None, None), (2008, rows[2][1], None, None)]
    good += rows[-3:]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(13)).collect()
    x = [exact_x(v) for _, v, *_ in good]
    n, s = len(x), [sum(c) for c in zip(*x)]
    centred = np.array(x, float) - np.array(s, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    plain = centred @ vectors / np.sqrt(values)
    assert len(got) == n * 12 and max(r.identity_error for r in got) < 1e-8 and {r.n for r in got} == {n}
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    sign = {}
    for k, (i, *_ ) in enumerate(good):
        want = sum((n * a - b) ** 2 for a, b in zip(x[k], s))
        assert {(r.deviation, int(r.deviation_exact)) for r in by[i]} == {(want, want)}
        for r in by[i]:
            j = r.component - 1
            sign.setdefault(j, np.sign(r.whitened * plain[k, j]))
            assert abs(r.whitened - sign[j] * plain[k, j]) < 1e-6 and abs(r.explained / (values[j] / values.sum()) - 1) < 1e-9


def test_whitening_large_numbers(spark):
    rows = [(i, [float(2**40 * (i + 1)), float(i % 7)], 0, 1) for i in range(50)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).where("component = 1").collect()
    x = {i: exact_x(v) for i, v, *_ in rows}
    s = [sum(c) for c in zip(*x.values())]
    for r in got:
        want = sum((50 * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        assert int(r.deviation_exact) == want and r.deviation == (want if want < 2**63 else None)


def test_whitening_of_little(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0, 1)] * 3, VECTORS)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 5.0], 0, 1) for i in range(20)]  # one direction only
    got = whitening.whitened(spark.createDataFrame(flat, VECTORS)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20 and abs(got[0].explained - 1) < 1e-12
