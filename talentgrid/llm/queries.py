"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm import bpe, decontam, html, jaccard, langid, neardup, packing, phrases, quality, secrets, substrings, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.findings(docs, secrets.fit(docs))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "embeddings"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, model, keep=("held_out",))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    scored = quality.score(docs.withColumn("held_out", quality.held_out(F.col("doc_id"))), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: op12 in DuckDB. Only A-Z are lower-cased; a phrase's text is its words joined by a space, which no word holds.
PHRASES_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
found AS (SELECT lang, k, w[i : i + k - 1] AS p FROM places, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, p, count(*) AS f FROM found GROUP BY ALL HAVING count(*) >= 100),
sizes AS (SELECT lang, count(*) AS n FROM places GROUP BY 1),
gone AS (SELECT lang, p[2:] AS p, f FROM counts WHERE k > 2 UNION SELECT lang, p[: k - 1], f FROM counts WHERE k > 2),
kept AS (SELECT c.* FROM counts c WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = c.lang AND g.p = c.p AND g.f = c.f)),
cuts AS (
  SELECT c.lang, c.k, c.p, c.f AS a, x.f AS l, y.f AS r, n, j, (1000 * c.f::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c JOIN sizes USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.p = c.p[:j] JOIN counts y ON y.lang = c.lang AND y.p = c.p[j + 1 :]),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_phrases": PHRASES_SQL}
