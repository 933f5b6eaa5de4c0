"""The corpus pipeline, stage by stage and as a whole, against plain versions on a few hundred rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from talentgrid.llm import decontam, quality, secrets
from talentgrid.llm.common import _BYTE, hashes, mixed, places, word_hashes
from tests.llm.test_text_operators import brute_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with null, empty, long, tied and repeated rows, copies, leaks and secrets. Bad texts repeat a few words."""
    dice = random.Random(12)
    words = ["".join(dice.choices("abcdefghijkl", k=dice.randint(3, 8))) for _ in range(300)]
    items = [" ".join(dice.choices(words, k=24)) for _ in range(5)]
    texts, labels = [], []
    for i in range(260):
        good = dice.random() < 0.75
        own = dice.choices(words, k=dice.randint(30, 90)) if good else [dice.choice(("spam", "buy", "now"))] * dice.randint(5, 60)
        labels.append((i, int(good), 0))
        if good and dice.random() < 0.1:
            own[5:5] = dice.choice(items).split()
        if good and dice.random() < 0.1:
            own[9:9] = ["password", "=", "Zx9!kd03Qp"]
        if good and i > 20 and dice.random() < 0.2:
            own = texts[dice.choice([k for k in range(i) if labels[k][1]])].split()
            own[dice.randrange(len(own))] = dice.choice(words)
        texts.append(" ".join(own))
    rows = [(i, t, "en", None, len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, " ".join(words * 40), "en", "s", 9), (903, texts[0], "en", "s", 9), (5, texts[5], "en", None, 9), (None, texts[1], "en", "s", 9)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (900, None, 0), (None, 1, 0), (3, labels[3][1], 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (8, None), (9, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain_score(model, text):
    """Average the vectors of all features of a text one by one, then softmax."""
    bucket = lambda h: int(2 + (int(h) >> 16) % ((1 << quality.BITS) - 2))
    words, found = (text or "").split(), [quality.ALWAYS]
    for k, w in enumerate(words):
        found.append(bucket(mixed(hashes(pa.array([w])) ^ np.uint64(0x5851F42D4C957F2D))[0]))
        raw = f"<{w}>".encode()
        for n in quality.SIZES:
            for a in range(len(raw) - n + 1):
                found.append(bucket(mixed(np.array([sum(int(_BYTE[raw[a + j]]) * int(places(8)[j]) for j in range(n)) + n & (1 << 64) - 1], np.uint64))[0]))
        if k and w == words[k - 1]:
            found.append(quality.REPEAT)
    z = model.weights @ np.mean([model.vectors[f] for f in found], 0)
    return float(np.exp(z[1] - np.logaddexp(*z)))


def plain_leak(items, text):
    """Whether any alignment of an item with the text has a long enough stretch."""
    h = word_hashes(pa.array([text or ""]))[0]
    for item in items:
        w = word_hashes(pa.array([item or ""]))[0]
        for shift in range(1 - len(w), len(h)):
            equal = [k for k in range(len(w)) if 0 <= k + shift < len(h) and h[k + shift] == w[k]]
            for x, a in enumerate(equal):
                for y in range(x, len(equal)):
                    size = equal[y] - a + 1
                    if size >= min(decontam.LEAST, len(w)) and y - x + 1 >= decontam.SHARE * size:
                        return True
    return False


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near duplicates", "decontamination", "secrets", "tokens"]

    model = quality.fit(docs, labels.where(~quality.held_out(labels.doc_id)))
    want = [r for r in rows_of(docs) if plain_score(model, r[1]) >= quality.THRESHOLD]
    good = stages["quality"](spark, docs, folder)
    assert rows_of(good) == want and 100 < len(want) < docs.count() and good.columns == docs.columns

    named = sorted((r for r in want if r[0] is not None), key=lambda r: r[0])
    names = list(dict.fromkeys(r[0] for r in named))
    classes = brute_classes([next(r[1] for r in named if r[0] == i) for i in names])
    kept = {names[k] for k in range(len(names)) if classes[k][1] == k}
    single = stages["near duplicates"](spark, good, folder)
    assert {r[0] for r in rows_of(single)} == kept and single.count() == len(kept) < len(names) and single.columns == docs.columns

    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, single, folder)
    assert rows_of(clean) == [r for r in rows_of(single) if not plain_leak(items, r[1])] and clean.count() < single.count()

    scanner = secrets.fit(clean)
    free = stages["secrets"](spark, clean, folder)
    for before, after in zip(rows_of(clean), rows_of(free)):
        text = before[1]
        for _, a, b in reversed(secrets.joined((r, a, b) for r, a, b, s in scanner.scan([text]) if s >= secrets.THRESHOLD)):
            text = text[:a] + "[secret]" + text[b:]
        assert after == (before[0], text, before[2], before[3], None if text is None else len(text))
        assert "Zx9!kd03Qp" not in (after[1] or "")

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: list(r.ids) for r in stages["tokens"](spark, free, folder).collect()}
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows_of(free)}
    assert got == want and {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_folder():
    from talentgrid.llm.common import scratch

    def session(master, found=None):
        settings = type("Settings", (), {"get": lambda self, *_: found})()
        return type("Session", (), {"conf": settings, "sparkContext": type("Context", (), {"master": master})})

    assert scratch(session("yarn", "hdfs://x/"), "n").startswith("hdfs://x/n-") and scratch(session("local[2]"), "n").startswith("file://")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            scratch(session(master), "n")
