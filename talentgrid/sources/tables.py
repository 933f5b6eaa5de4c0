"""Readers: Parquet and JDBC tables, text and binary files, parameterised SQL, provider feeds, resume fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where each provider keeps a field (fixed values); dots descend into the document.
PROVIDERS = {
    "greenhouse": {"id": "id", "title": "title", "location": "location.name", "department": "departments[0].name", "description": "content", "status": "status"},
    "lever": {"id": "id", "title": "text", "location": "categories.location", "department": "categories.team", "description": "description"},
    "workday": {"id": "jobPostingId", "title": "title", "location": "location", "department": "jobFamily", "description": "jobDescription", "status": "status"},
    "custom": {"id": "id", "title": "title", "location": "location", "department": "department", "description": "description", "status": "status"},
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Tasks a core that rows of costly work are dealt to.
TASKS = 4


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt to tasks by their key: a file's row group is read by one task, however many texts it holds."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * TASKS, *key)


def jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """SQL with named parameters over registered views."""
    return spark.sql(sql, args=args or {})


def provider_jobs(raw: DataFrame, provider: str, column: str = "value") -> DataFrame:
    """One job schema from a provider's JSON documents; what a provider lacks is empty, and its status then open."""
    fields = PROVIDERS[provider]
    get = lambda f: F.get_json_object(F.col(column), f"$.{fields[f]}") if f in fields else F.lit(None).cast("string")
    return raw.select(get("id").alias("id"), *(F.coalesce(get(f), F.lit("")).alias(f) for f in ("title", "location", "department", "description")), F.coalesce(get("status"), F.lit("open")).alias("status"), F.lit(provider).alias("provider"))


def all_providers(feeds: dict[str, DataFrame]) -> DataFrame:
    """Jobs of several providers under one schema."""
    parts = [provider_jobs(df, name) for name, df in sorted(feeds.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text) of whole text files, for pairing with labels by stem."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return df.select(F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("stem"), "text")


def checked_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, ok, message) of files that should be PDFs, by signature. Files of no bytes give no row: Spark's file sources skip them."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 5).cast("string").alias("head"))
    message = F.when(F.col("head") != "%PDF-", "not a PDF").otherwise("ok")
    return files.select("path", (message == "ok").alias("ok"), message.alias("message"))


def kind_of(path: Column) -> Column:
    """How a document is read, by its extension; null for kinds that can't be."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("pdf", "doc", "docx", "txt"), ext)


def stable_index(c: Column, modulus: int) -> Column:
    """A number under ``modulus`` that depends on the text alone."""
    return F.crc32(c.cast("binary")) % modulus
