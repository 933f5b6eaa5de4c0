"""Erasure, export, retention, audit, permissions, quotas and row visibility."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Applications that keep a candidate from being erased (fixed values), and the shortest window in days.
OPEN_STATUSES = ("active",)
LEAST_DAYS = 30


def checked_days(days: int) -> int:
    if days < LEAST_DAYS:
        raise ValueError(f"a retention window has {LEAST_DAYS} days at least")
    return days


def last_activity(candidates: DataFrame, children: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(candidate_id, last_activity): the latest time in the candidate's own row and in all children (table, key, time columns);
    nulls are skipped, and a candidate without any time has none."""
    out = candidates.select(F.col("id").alias("candidate_id"), F.col("updated_at").alias("t0"))
    for k, (child, key, times) in enumerate(children, 1):
        latest = F.max(F.greatest(*map(F.col, times))) if len(times) > 1 else F.max(times[0])
        out = out.join(child.groupBy(F.col(key).alias("candidate_id")).agg(latest.alias(f"t{k}")), "candidate_id", "left")
    names = [f"t{k}" for k in range(len(children) + 1)]
    return out.select("candidate_id", (F.greatest(*names) if len(names) > 1 else F.col("t0")).alias("last_activity"))


def inactive(activity: DataFrame, applications: DataFrame, cutoff: datetime) -> DataFrame:
    """Candidates without activity since the cutoff, oldest first; ``held`` where no time is known or an application is open."""
    open_ones = applications.where(F.col("status").isin(*OPEN_STATUSES)).select("candidate_id").distinct().withColumn("open", F.lit(True))
    idle = activity.where(F.col("last_activity").isNull() | (F.col("last_activity") < F.lit(cutoff))).join(open_ones, "candidate_id", "left")
    held = F.when(F.col("open"), "open application").when(F.col("last_activity").isNull(), "no recorded activity")
    return idle.select("candidate_id", "last_activity", held.alias("held")).orderBy(F.asc_nulls_first("last_activity"), "candidate_id")


def erasure(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(what is left of each table, rows erased per table) when the candidates (candidate_id) go; tables map to (rows, key column)."""
    left, counts = {}, []
    for name, (df, key) in tables.items():
        ids = gone.select(F.col("candidate_id").alias(key))
        left[name] = df.join(ids, key, "left_anti")
        counts.append(df.join(ids, key, "left_semi").agg(F.count("*").alias("erased")).select(F.lit(name).alias("table"), "erased"))
    return left, reduce(DataFrame.unionByName, counts)


def exportable(df: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """A table without vectors, bytes and hidden columns."""
    vector = lambda t: isinstance(t, Ty.BinaryType) or isinstance(t, Ty.ArrayType) and isinstance(t.elementType, (Ty.FloatType, Ty.DoubleType))
    return df.select(*(f.name for f in df.schema if not vector(f.dataType) and f.name not in hidden))


def visible_candidates(applications: DataFrame, rows: DataFrame, interviews: DataFrame, user: str) -> DataFrame:
    """Candidates with a stage that the user interviews for."""
    mine = interviews.where(F.col("interviewer_id") == user).select(F.col("application_stage_id").alias("id"))
    ids = rows.join(mine, "id", "left_semi").select(F.col("application_id").alias("id"))
    return applications.join(ids, "id", "left_semi").select("candidate_id").distinct()


def classified(method: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The name of the first rule (method, path pattern with {placeholders}, name) that fits the whole path."""
    out = F.when(F.lit(False), "")
    for verb, template, name in rules:
        pattern = "^" + "[^/]+".join(p.replace(".", "\\.") for p in _pieces(template)) + "$"
        out = out.when((method == verb) & path.rlike(pattern), name)
    return out


def _pieces(template: str) -> list[str]:
    pieces = template.split("{")
    return [pieces[0], *(p.partition("}")[2] for p in pieces[1:])]


def over_quota(requests: DataFrame, who: str, at: str, limit: int) -> DataFrame:
    """(who, day, n) of everyone with more requests on a day than allowed."""
    return requests.groupBy(F.col(who).alias("who"), F.to_date(at).alias("day")).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def unexpired(df: DataFrame, cached_at: str, ttl_seconds: int, now: datetime) -> DataFrame:
    return df.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(cached_at).cast("timestamp")) <= ttl_seconds * 1_000_000)


def bulk_tag(candidates: DataFrame, tags: DataFrame, wanted: DataFrame, tag: str, most: int = 20) -> DataFrame:
    """(candidate_id, outcome) of one tag for many candidates (candidate_id): not found, already, limit or ok."""
    have = tags.groupBy("candidate_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("tag") == tag, 1)).alias("has"))
    known = candidates.select(F.col("id").alias("candidate_id"), F.lit(True).alias("known"))
    df = wanted.select("candidate_id").distinct().join(known, "candidate_id", "left").join(have, "candidate_id", "left")
    return df.select("candidate_id", F.when(F.col("known").isNull(), "not found").when(F.col("has") == 1, "already").when(F.coalesce("n", F.lit(0)) >= most, "limit").otherwise("ok").alias("outcome"))


def merged(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Upsert on Parquet: rows of the source win where they have a value, the target's other values and rows stay."""
    t, s = target.alias("t"), source.alias("s")
    cols = [F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) if c in source.columns else F.col(f"t.{c}").alias(c) for c in target.columns]
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full").select(*cols)
