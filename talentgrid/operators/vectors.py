"""Vector search over array columns: exact top-k by cosine or distance, embeddings and their fallback."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is missing or zero, or where the lengths differ."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in vector))


def top_k(df: DataFrame, query: Column, key: str, limit: int, vector: str = "embedding", floor: float = 0.0, metric: str = "cosine") -> DataFrame:
    """The nearest rows of one query vector. A floor of zero filters nothing; similarities are shown between 0 and 1."""
    if metric == "l2":
        return df.where(F.col(vector).isNotNull()).withColumn("distance", distance(F.col(vector), query)).orderBy("distance", key).limit(limit)
    scored = df.where(F.col(vector).isNotNull()).withColumn("raw", cosine(F.col(vector), query)).where("raw is not null")
    if floor:
        scored = scored.where(F.col("raw") >= floor)
    return scored.orderBy(F.desc("raw"), key).limit(limit).withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw")))).drop("raw")


def similar_to(df: DataFrame, key: str, value: int, limit: int, vector: str = "embedding") -> DataFrame:
    """The rows nearest to one row of the same table, itself left out; the one row is broadcast."""
    one = df.where(F.col(key) == value).select(F.col(vector).alias("_query")).limit(1)
    return top_k(df.where(F.col(key) != value).join(F.broadcast(one)), F.col("_query"), key, limit, vector).drop("_query")


def embedding_text(*parts: Column) -> Column:
    """What is embedded: the parts that aren't empty, between bars."""
    return F.concat_ws(" | ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def placeholder_vector(text: str, size: int) -> list[float]:
    """A unit vector that depends on the text alone, for when no embedding service answers."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).normal(size=size)
    return (v / np.linalg.norm(v)).tolist()


def embedded(df: DataFrame, text: str, embed, size: int, out: str = "embedding") -> DataFrame:
    """Adds an embedding and whether it is a placeholder. Each distinct text is embedded once; ``embed`` takes a list of texts
    and may fail, in which case placeholders are used and marked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].tolist()
            try:
                vectors, degraded = embed(texts), False
                if any(len(v) != size for v in vectors):
                    raise ValueError("an embedding has another size")
            except Exception:  # noqa: BLE001  whatever the service raises, the rows go on, marked
                vectors, degraded = [placeholder_vector(t, size) for t in texts], True
            yield pd.DataFrame({"_text": texts, out: [list(map(float, v)) for v in vectors], "degraded": degraded})

    distinct = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).distinct()
    made = distinct.mapInPandas(run, f"_text string, `{out}` array<double>, degraded boolean")
    return df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).join(made, "_text").drop("_text")
