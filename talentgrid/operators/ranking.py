"""Latest rows, modes, merged intervals, threads and trimmed histories: what windows are for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first row of each key in an order that ends in a unique column; one aggregate, no sort of the table."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def most_used(df: DataFrame, by: Column, value: str) -> DataFrame:
    """The most frequent spelling of each key; of equally frequent ones the first in order."""
    counts = df.groupBy(by.alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counts.groupBy("key").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("m")).select("key", "m.value", "m.n")


def merged_years(spans: DataFrame, key: str, today: Column) -> DataFrame:
    """Years covered by dated spans (start_date, end_date), overlaps once; an open end is today, later ends are cut to it.
    Keys without a dated span are left out."""
    end = F.coalesce("end_date", today)
    dated = spans.where(F.col("start_date").isNotNull()).where(end >= F.col("start_date")).select(key, F.col("start_date").alias("s"), F.least(end, today).alias("e"))
    w = Window.partitionBy(key).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = dated.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    days = islands.groupBy(key, "island").agg(F.datediff(F.max("e"), F.min("s")).alias("days"))
    return days.groupBy(key).agg(F.round(F.sum("days") / 365.25, 1).alias("years"))


def threads(mails: DataFrame) -> DataFrame:
    """Messages by thread: first subject, people in order of appearance, the last time, whether all are read; newest first. People are
    counted once before a thread's are gathered, so a long thread is no long row."""
    mails = mails.withColumn("thread", F.coalesce("thread_id", F.col("id").cast("string")))
    first = F.struct("at", "id")
    by_person = mails.groupBy("thread", "sender").agg(
        F.min(first).alias("first"), F.min_by("subject", first).alias("subject"), F.max("at").alias("last_at"), F.bool_and("is_read").alias("is_read"), F.count("*").alias("messages")
    )
    people = F.transform(F.array_sort(F.collect_list(F.struct("first", "sender"))), lambda m: m["sender"])
    by = by_person.groupBy("thread").agg(F.min_by("subject", "first").alias("subject"), people.alias("participants"), F.max("last_at").alias("last_at"), F.bool_and("is_read").alias("is_read"), F.sum("messages").alias("messages"))
    return by.orderBy(F.desc("last_at"), "thread")


def trimmed_history(turns: DataFrame, key: str, order: str, text: str, most_turns: int = 20, most_chars: int = 8000) -> DataFrame:
    """The last turns of user and assistant that aren't empty, at most so many and so many characters together."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    said = turns.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    return said.withColumn("_n", F.row_number().over(w)).withColumn("_c", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_n") <= most_turns) & (F.col("_c") <= most_chars)).drop("_n", "_c")


#: Ranges that a table is cut into for a rank over all of it.
RANGES = 64


def cut_points(df: DataFrame, column: str) -> Column:
    """An array of at most RANGES - 1 values that cut a column into parts of about equal size."""
    found = df.agg(F.percentile_approx(column, [k / RANGES for k in range(1, RANGES)], 1000)).first()[0] or []
    return F.array(*(F.lit(v) for v in sorted(set(found)))).cast(f"array<{dict(df.dtypes)[column]}>")


def ranked(df: DataFrame, by: str | None, score: str, key: str) -> DataFrame:
    """A rank from 1 by falling score within ``by``. Without ``by`` the whole table is ranked in ranges: rows are numbered within theirs,
    and the sizes of the ranges before are added. Scores that many rows share, and null ones, which come last, are cut by key."""
    order = (F.desc(score), F.asc(key))
    if by:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    scores, keys = cut_points(df, score), cut_points(df, key)
    tied = F.array_contains(scores, F.col(score)) | F.col(score).isNull()
    above = F.when(F.col(score).isNull(), RANGES).otherwise(F.size(F.filter(scores, lambda v: v > F.col(score))))
    placed = df.withColumns({
        "_range": 2 * above + F.coalesce(tied, F.lit(False)).cast("int"),
        "_part": F.when(tied, F.size(F.filter(keys, lambda v: v < F.col(key)))).otherwise(0),
    })
    sizes = placed.groupBy("_range", "_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)  # over a few thousand rows at most
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_range", "_part").orderBy(*order))
    return placed.join(F.broadcast(starts), ["_range", "_part"]).withColumn("rank", (F.col("_start") + place).cast("int")).drop("_range", "_part", "_start")


def numbered(df: DataFrame, by: str, order: str) -> DataFrame:
    """Dense numbers by first appearance within ``by``."""
    return df.withColumn("number", F.dense_rank().over(Window.partitionBy(by).orderBy(order)))
