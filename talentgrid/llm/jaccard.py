"""Exact Jaccard similarity join of shingle sets in their metric space, as connected classes.

The Jaccard distance d is a metric; two sets link if d <= 1/4. The join works on distinct sets.

1. Sets that share nothing are at distance 1 from each other, and so are nearly all pairs of texts: there the triangle
   inequality excludes nothing, whatever the pivots are. So the space is first cut into neighbourhoods outside of which
   nothing links. A set that links with another shares three quarters of its shingles with it: of the first shingles
   of each set, in the order of their hashes, so many must occur in another set; where they don't, the set links with
   nothing and goes. What is left is counted whole. Rare shingles come first in one global order, and a set belongs to
   the neighbourhoods of its first n - ceil(3n/4) + 1 shingles: two sets at distance 1/4 or less share one of them.
2. The most central member of every neighbourhood, the one with the fewest shingles of its own, becomes its pivot, one
   pivot for all neighbourhoods around it. The exact distance of the other members to it is taken; those within 1/4
   link with it, and its part is done.
3. Neighbourhoods that aren't connected by then are joined recursively. Several members become pivots; each set's region
   is that of its nearest pivot (Voronoi). A set x links with a set y of region p only if d(x, p) <= d(y, p) + 1/4, and so
   d(x, p) <= d(x, q) + 1/2 for its own nearest pivot q: sets in this window, and within 1/4 of the region's radius, are
   replicated to the region. Every region is joined the same way, until it is connected, holds ``LEAF`` members at most,
   or its pivots can't cut it any more because their windows hold most of it.
4. In these last regions, pairs of different components with |d(x, p) - d(y, p)| <= 1/4 are measured, unless the place
   of the neighbourhood in the orders of both leaves too little for a link (their first common neighbourhood does not).

Distances are compared in whole numbers. Shingles are named by 64-bit hashes, sets by 128-bit hashes of their sorted
shingles. Null, empty and word-free texts have no set and link with nothing, nor do rows without a key; texts shorter
than a shingle have one shingle. Repeated rows share a set, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import discard, lean, long_of, mixed, only, release, shingle_sets, slices, stored
from talentgrid.llm.components import components

#: Similarity at which sets link, as a fraction.
OVER, UNDER = 3, 4
#: Shingles beyond the prefix, of each hundred, in the first count: the longer, the fewer sets are counted whole.
SLACK = 15
#: Members of a region that is joined without further pivots, and pivots of a larger one.
LEAF, PIVOTS = 64, 4
#: A region that is larger than this share of the one it was cut from isn't cut again.
SHRUNK = 0.75
#: Distances are floating-point numbers; windows are wider by this much.
EDGE = 1e-9
#: Counted shingles that a task compares with each other before they are shuffled.
SLAB = 1 << 18


def set_name(s: np.ndarray) -> bytes:
    """The 128-bit name of a sorted set."""
    k = np.arange(1, len(s) + 1, dtype=np.uint64)
    sums = [(mixed(s + k + np.uint64(salt)) * (k | np.uint64(1))).sum(dtype=np.uint64) for salt in (0, 0x9E3779B97F4A7C15)]
    return mixed(np.array(sums, np.uint64) + np.uint64(len(s))).tobytes()


def least_shared(n: int) -> int:
    """The smallest intersection that a set of n shingles can have with a set it links to."""
    return (OVER * n + UNDER - 1) // UNDER


def counted(n: int) -> int:
    """How many of n shingles, in the order of their hashes, are counted first."""
    return min(n, n - least_shared(n) + n * SLACK // 100 + 1)


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """(key, n_shingles, sid) of every row; sid is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = [(len(s), set_name(s) if len(s) else None) for s in shingle_sets(part.column("text"), words)]
                columns = [part.column("key"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_shingles", "sid"])

    return docs.select("key", "text").mapInArrow(run, f"key {dict(docs.dtypes)['key']}, n_shingles long, sid binary")


def compared(shingles: list[np.ndarray], sets: list[int]) -> pa.RecordBatch:
    """(s, part, met) of a slab: each shingle once, with a set that has it (met is -1 if no other set of the slab does, else 0), and
    for each set how many of its shingles another one has (met, with a value of its own in place of s)."""
    owner = np.repeat(np.array(sets, np.int64), [len(s) for s in shingles])
    s, first, back, count = np.unique(np.concatenate(shingles), return_index=True, return_inverse=True, return_counts=True)
    name, met = np.unique(owner[count[back] > 1], return_counts=True)
    return pa.RecordBatch.from_pydict({
        "s": long_of(np.concatenate([mixed(name.view(np.uint64)), s])),
        "part": np.concatenate([name, owner[first]]),
        "met": np.concatenate([met, np.where(count > 1, 0, -1)]),
    })


def first_shingles(docs: DataFrame, words: int) -> DataFrame:
    """(s, part, met): the shingles of each set that are counted first, compared slab by slab; a set is named by ``part``, half of its name.
    A shingle that many sets hold has one row for each slab, not for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # eight bytes for each set of the task
        shingles, sets, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for s in shingle_sets(part.column("text"), words):
                    if len(s) and (name := int.from_bytes(set_name(s)[:8], "big", signed=True)) not in seen:
                        seen.add(name)
                        shingles.append(s[: counted(len(s))])
                        sets.append(name)
                        held += len(shingles[-1])
                if held > SLAB:
                    yield compared(shingles, sets)
                    shingles, sets, held = [], [], 0
        if sets:
            yield compared(shingles, sets)

    return docs.select("text").mapInArrow(run, "s long, part long, met long")


def candidates(docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(sid, key, n) of the sets of which enough counted shingles occur in another set. Sets whose half names are alike
    count together, which makes more candidates, never fewer."""
    w = Window.partitionBy("s")
    slabs = first_shingles(docs, words).select("part", "met", F.min("part").over(w).alias("first"), F.max("part").over(w).alias("last"))
    met = slabs.where("met > 0 or met = -1 and first < last").select("part", F.abs("met").alias("met"))
    # a partner holds three quarters as many shingles at least, so this many of the counted ones are in both
    least = F.expr(f"{SLACK} * (({OVER} * n + {UNDER - 1}) div {UNDER}) div 100 + 1")
    return sets.join(met.groupBy("part").agg(F.sum("met").alias("met")), "part").where(F.col("met") >= least).select("sid", "key", "n")


def items(docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(sid, n, items) of these sets: their sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = [(set_name(s), len(s), s.tobytes()) for s in shingle_sets(part.column("text"), words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["sid", "n", "items"])

    found = only(docs, sets.select("key"), "key").select("text").mapInArrow(run, "sid binary, n long, items binary")
    return found.join(sets.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def neighbourhoods(held: DataFrame) -> DataFrame:
    """(region, sid, n, alone, place): the neighbourhoods of each set where another set is, their place in the order of its
    shingles, and how many of these no other set has. Of those with the same members the first in the order stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "items"):
                sizes = part.column("n").to_numpy()
                all_items = np.frombuffer(b"".join(part.column("items").to_pylist()), np.int64)
                owner = part.column("sid").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(all_items), owner], ["s", "sid"])

    single = held.select("sid", "n", "items").mapInArrow(run, "s long, sid binary")
    often = single.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    lists = single.join(often, "s").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("xs")).join(held.select("sid", "n"), "sid")
    # shingles of one set only come first in the order; what is left of the prefix leads to regions
    lists = lists.withColumn("alone", F.col("n") - F.size("xs"))
    room = F.expr(f"cast(n - ({OVER} * n + {UNDER - 1}) div {UNDER} + 1 - alone as int)")
    prefix = lists.where(room > 0).select("sid", "n", "alone", F.posexplode(F.slice("xs", F.lit(1), room)).alias("at", "x"))
    prefix = stored(prefix.select("x.f", "x.s", "sid", "n", "alone", (F.col("alone") + F.col("at") + 1).alias("place")), "prefixes")
    kinds = prefix.groupBy("f", "s").agg(F.count("*").alias("k"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(7), "sid")).alias("x")).where("k > 1")
    kept = kinds.groupBy("k", "h", "x").agg(F.min(F.struct("f", "s")).alias("one")).select("one.s")
    return prefix.join(kept, "s").select(F.col("s").cast("string").alias("region"), "sid", "n", "alone", "place")


def may_link() -> Column:
    """Sizes allow a link, and so does the place of this neighbourhood in the orders of both: the first shingle that two
    sets share leaves enough behind it in either."""
    na, nb = F.col("na"), F.col("nb")
    enough = (OVER + UNDER) * (1 + F.least(na - F.col("pa"), nb - F.col("pb"))) >= OVER * (na + nb)
    return (UNDER * F.least(na, nb) >= OVER * F.greatest(na, nb)) & enough


def measured(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) with their distance d and whether they link."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "y", 1 << 20):
                d, link = [], []
                for p, q in zip(part.column("x"), part.column("y")):
                    p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    same = len(np.intersect1d(p, q, assume_unique=True))
                    union = len(p) + len(q) - same
                    d.append(1 - same / union)
                    link.append(UNDER * same >= OVER * union)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(d, pa.float64()), pa.array(link, pa.bool_())], ["a", "b", "d", "link"])

    x, y = (held.select(F.col("sid").alias(k), F.col("items").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(both, "a binary, b binary, d double, link boolean")


def pivots(members: DataFrame, step: int) -> DataFrame:
    """(region, a): the most central members, one in each region at first, several later. Overlapping regions share them."""
    share = F.pmod(F.xxhash64("sid"), F.lit(PIVOTS if step else 1))
    return members.groupBy("region", share.alias("share")).agg(F.min_by(F.col("sid"), F.struct("alone", "sid")).alias("a")).select("region", "a")


def cut(stars: DataFrame) -> DataFrame:
    """Members (region, whole, sid, ...) of the Voronoi regions of the pivots a, those of the windows included; ``whole`` is the region that was cut."""
    nearest = stars.groupBy("region", "sid").agg(F.min(F.struct("d", "a")).alias("home"))
    radius = nearest.groupBy("region", F.col("home.a").alias("a")).agg(F.max("home.d").alias("radius"))
    near = stars.join(nearest, ["region", "sid"]).join(radius, ["region", "a"])
    width = (UNDER - OVER) / UNDER
    inside = near.where((F.col("d") <= F.col("home.d") + 2 * width + EDGE) & (F.col("d") <= F.col("radius") + width + EDGE))
    own = F.sha1(F.concat_ws("/", "region", F.hex("a")))
    return inside.select(own.alias("region"), F.col("region").alias("whole"), "sid", "n", "alone", "place", "d")


def undecided(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with their components, of regions that aren't connected; without those whose place leaves too little for
    a link with even the smallest set of the region."""
    comp = found.select(F.col("id").alias("sid"), F.col("component_id").alias("comp"))
    label = members.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = members.groupBy("region").agg(F.min("n").alias("least"))
    able = label.join(least, "region").where((OVER + UNDER) * (1 + F.col("n") - F.col("place")) >= OVER * (F.col("n") + F.col("least"))).drop("least")
    several = able.groupBy("region").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.count("*").alias("m")).where("one < other")
    return able.join(several.select("region", "m"), "region")


def merged(found: DataFrame | None, new: DataFrame) -> DataFrame:
    """Components of what was found and of new links (a written table)."""
    if found is not None and new.isEmpty():
        return found
    links = new if found is None else found.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(new.select("a", "b"))
    return stored(components(links), "components")


def connected(members: DataFrame, held: DataFrame) -> DataFrame:
    """(id, component_id) of every set that links with another; components are named by their smallest sid. What a later
    plan reads several times is written first: a plan that holds all steps so far would fill the driver."""
    found, last, step = None, None, 0
    while True:
        stars = members.join(pivots(members, step), "region").withColumn("b", F.col("sid")).where("a <> b")
        got = stored(measured(stars.select("a", "b").distinct(), held), "measured")
        found = merged(found, got.where("link").select("a", "b"))
        stars = stored(stars.join(got.select("a", "b", "d"), ["a", "b"]), "stars")
        if step:  # what was cut before has several pivots
            settled = pivots(members, step).withColumnRenamed("a", "sid")
            rest = stored(cut(stars).join(settled.select(F.col("region").alias("whole"), "sid"), ["whole", "sid"], "left_anti"), "cells")
            sizes = members.select(F.col("region").alias("whole"), F.col("m").alias("before")).distinct()
            rest = undecided(rest, found).join(sizes, "whole").drop("whole")
        else:  # all but the pivot, whose part is done
            rest = undecided(stars.select("region", "sid", "n", "alone", "place", "d"), found).withColumn("before", F.lit(1 << 62))
        rest = stored(rest, "regions")
        discard(stars)
        ends = (F.col("m") <= LEAF) | (F.col("m") > SHRUNK * F.col("before"))
        done = rest.where(ends).drop("m", "before", "comp")
        last = done if last is None else last.unionByName(done)
        members, step = rest.where(~ends).drop("before", "d", "comp"), step + 1
        if members.isEmpty():
            break
    last = stored(undecided(stored(last, "leaves"), found), "open").withColumn("cell", F.floor(F.col("d") * UNDER / (UNDER - OVER)))
    a, b = (last.select("region", *(F.col(c).alias(t + k) for c, t in (("sid", ""), ("comp", "c"), ("d", "d"), ("n", "n"), ("place", "p"))), "cell") for k in "ab")
    a = a.withColumn("cell", F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)))
    window = F.abs(F.col("da") - F.col("db")) <= (UNDER - OVER) / UNDER + EDGE
    met = a.join(b, ["region", "cell"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & window & may_link())
    return merged(found, stored(measured(met.select("a", "b").distinct(), held), "measured").where("link"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its set and the smallest key reachable by links, its own included."""
    spark = docs.sparkSession
    lean(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stored(profiles(docs, words), "profiles")
    named = rows.where("sid is not null and key is not null").groupBy("sid").agg(F.min("key").alias("key"), F.min("n_shingles").alias("n"))
    part = F.conv(F.hex(F.substring("sid", 1, 8)), 16, -10).cast("long")  # as a signed number
    sets = stored(named.withColumn("part", part), "sets")
    some = stored(candidates(docs, sets, words), "candidates")
    release(spark)
    held = stored(items(docs, some, words), "items")
    members = stored(neighbourhoods(held), "neighbourhoods")
    release(spark)
    found = connected(members, held)
    least = found.join(sets.select(F.col("sid").alias("id"), "key"), "id").groupBy("component_id").agg(F.min("key").alias("least"))
    of_set = found.join(least, "component_id").select(F.col("id").alias("sid"), "least").unionByName(sets.join(found.select(F.col("id").alias("sid")), "sid", "left_anti").select("sid", F.col("key").alias("least")))
    return rows.join(of_set, "sid", "left").select(F.col("key").alias(key), "n_shingles", F.coalesce("least", "key").alias("component_id"))
