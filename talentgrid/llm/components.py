"""Connected components of a table of links, by alternating stars until nothing is left but stars.

Each round points every node at the smallest node it knows; rounds grow with the logarithm of the
longest path. Links stay a distributed table, written to the shared folder after every round. What
the driver holds grows with the tasks that it starts, so a round has few shuffles, its joins make no
broadcasts, and the end is seen from the links themselves, not by a round that changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import discard, stored


def only_stars(edges: DataFrame) -> bool:
    """Whether every node of the links (a, b), a > b, has one smaller neighbour or larger ones only: then b names the component of a."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("up")), F.struct(F.col("b").alias("id"), F.lit(None).alias("up")))))
    nodes = ends.groupBy("id").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max(F.col("up").isNull()).alias("top"))
    return not nodes.where("low < high or low is not null and top").agg(F.count("*")).first()[0]


def shrunk(edges: DataFrame) -> DataFrame:
    """The links after a large and a small star: larger neighbours move to the smallest node around, then smaller ones do."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    # no more rows than links, so only the end of the round drops repeated ones
    large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).repartition("a")
    small = large.join(large.groupBy("a").agg(F.min("b").alias("m")).hint("merge"), "a")
    return small.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every node that has a link to another node: the smallest id reachable.
    Links may repeat and point either way; null ends and loops are ignored."""
    x, y = F.col(a), F.col(b)
    edges = stored(links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    while not only_stars(edges):
        old, edges = edges, stored(shrunk(edges), "links")
        discard(old)
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots.select("id", F.col("id").alias("component_id")))
