"""Near-duplicate embeddings with hierarchical navigable small-world graphs, one for each shard.

Vectors link if their labels are equal and not null and their cosine, in double precision, is at
least ``COSINE``. Equal vectors are one node. The nodes of a label are dealt into shards of bounded
size by hash; a graph is built for each shard and every block of a label's nodes queries every shard
of the label. In each of these searches a fixed part of the block is compared with the whole shard;
while the graph misses too many of the nearest links so found, or of the nearest nodes whatever their
cosine (so that a search without links has evidence too), the beam is doubled and the block is
searched again. A query whose beam holds nothing but links has its beam widened in any case, and if
that is full too, its links come from a block product with the shard.
A search passes on the trees of its links, not all pairs; their union gives the components. Links
are then counted, and verified, among the nodes of a component, block by block.

Vectors that are null or zero or hold null or non-finite numbers, and vectors with a null label, link
with nothing; so do vectors of different lengths. Repeated rows count as copies of each other. Labels
may be of any type that has a text form; keys are whole numbers of any type, or text that reads as
one, and come out as long. Rows that share a key but not the vector have their own links each, and
a component is named by the smallest key in it. A row without a key (null, or text that is no
number) has no links, no component, and is not kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import stored
from talentgrid.llm.components import components

COSINE = 0.98
#: Vectors of a shard, of a block of queries, and of a block of counts.
SHARD, BLOCK, COUNT_BLOCK = 16_384, 4_096, 1_024
LINKS = 16  # of a node in each layer; twice as many in the lowest
BUILD_BEAM, QUERY_BEAM = 48, 64
AUDIT = 64  # queries of each search that are compared with the whole shard
RECALL = 0.999
NEAREST, NAVIGABLE = 4, 0.97  # nodes of an audited query that count whatever their cosine, and the share that a search has to find
STEP = 512  # queries that move together
WIDER = 3  # nodes that a query expands at once


class Layer:
    """A navigable graph over some of the vectors, grown in batches."""

    def __init__(self, x: np.ndarray, degree: int):
        self.x, self.degree = x, degree
        self.next = np.full((len(x), degree), -1, np.int32)

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the best ``beam`` nodes found for each query, best first; -1 pads."""
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(self.x) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        node = np.full((len(q), beam), -1, np.int32)
        near = np.full((len(q), beam), -np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        k = min(beam, entry.shape[1])
        entry = entry[:, :k]
        node[:, :k] = entry
        near[:, :k] = np.where(entry >= 0, np.einsum("qd,qkd->qk", q, self.x[entry]), -np.inf)
        done[:, :k] = entry < 0
        np.put_along_axis(seen, entry.astype(np.int64) % (len(self.x) + 1), True, 1)
        seen[:, -1] = True
        live = rows
        while True:
            open_near = np.where(done[live], -np.inf, near[live])
            some = open_near.max(1) > -np.inf
            live, open_near = live[some], open_near[some]
            if not len(live):
                break
            pick = np.argpartition(-open_near, min(WIDER, beam) - 1, 1)[:, :WIDER]
            good = np.take_along_axis(open_near, pick, 1) > -np.inf
            chosen = np.where(good, np.take_along_axis(node[live], pick, 1), -1)
            flags = done[live]
            np.put_along_axis(flags, pick, True, 1)
            done[live] = flags
            new = np.where(chosen[:, :, None] >= 0, self.next[chosen], -1).reshape(len(live), -1)
            new.sort(1)  # equal neighbours of several nodes count once
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            new = np.where(fresh, new, -1)
            sim = np.where(fresh, np.einsum("qd,qkd->qk", q[live], self.x[new]), -np.inf).astype(np.float32)
            all_near = np.concatenate([near[live], sim], 1)
            best = np.argpartition(-all_near, beam - 1, 1)[:, :beam]
            near[live] = np.take_along_axis(all_near, best, 1)
            node[live] = np.take_along_axis(np.concatenate([node[live], new], 1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), best, 1)
        order = np.argsort(-near, 1, kind="stable")
        return np.take_along_axis(node, order, 1), np.take_along_axis(near, order, 1)

    def chosen(self, node: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
        """Of each row's candidates, best first, those that are closer to the row than to one chosen before; the nearest others fill up."""
        x = self.x[node]
        between = np.einsum("qid,qjd->qij", x, x)
        n, width = node.shape
        taken = np.zeros((n, width), bool)
        for j in range(width):
            clash = (taken & (between[:, j] > near[:, j : j + 1])).any(1)
            taken[:, j] = (node[:, j] >= 0) & ~clash & (taken.sum(1) < degree)
        rank = np.where(node < 0, 2 * width + 1, np.where(taken, 0, width + 1)) + np.arange(width) / (width + 1)
        order = np.argsort(rank, 1, kind="stable")[:, :degree]
        out = np.take_along_axis(node, order, 1)
        return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1) if out.shape[1] < degree else out

    def add(self, ids: np.ndarray, node: np.ndarray, near: np.ndarray) -> None:
        """Link new nodes with their candidates, both ways."""
        mine = self.chosen(node[:, :BUILD_BEAM], near[:, :BUILD_BEAM], self.degree)
        self.next[ids] = mine
        source, target = np.repeat(ids, mine.shape[1]), mine.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        host, first, count = np.unique(target, return_index=True, return_counts=True)
        for a in range(0, len(host), STEP):
            h, f, c = host[a : a + STEP], first[a : a + STEP], count[a : a + STEP]
            width = int(min(c.max(), 4 * BUILD_BEAM))
            col = np.arange(width)
            more = np.where(col < c[:, None], source[np.minimum(f[:, None] + col, len(source) - 1)], -1)
            both = np.concatenate([self.next[h], more], 1)
            both.sort(1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sim = np.where(both >= 0, np.einsum("qd,qkd->qk", self.x[h], self.x[both]), -np.inf)
            order = np.argsort(-sim, 1, kind="stable")[:, : 2 * self.degree]
            self.next[h] = self.chosen(np.take_along_axis(both, order, 1), np.take_along_axis(sim, order, 1), self.degree)


class Graph:
    """Layers from the sparsest to the one of all vectors. Layer k holds the first sizes[k] vectors, which come in random order."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        self.sizes = [len(x)]
        while self.sizes[0] > 128:
            self.sizes.insert(0, -(-self.sizes[0] // LINKS))
        self.layers: list[Layer] = []
        for k, size in enumerate(self.sizes):
            layer = Layer(self.x[:size], 2 * LINKS if k == len(self.sizes) - 1 else LINKS)
            begin = min(size, 128)
            sim = self.x[:begin] @ self.x[:begin].T
            np.fill_diagonal(sim, -np.inf)
            order = np.argsort(-sim, 1, kind="stable")[:, : min(BUILD_BEAM, max(1, begin - 1))]
            if begin > 1:
                layer.add(np.arange(begin), order.astype(np.int32), np.take_along_axis(sim, order, 1))
            self.layers.append(layer)
            while begin < size:
                end = min(size, begin + min(STEP, begin))
                q = self.x[begin:end]
                node, near = layer.search(q, self._entries(q, k, begin), BUILD_BEAM)
                own = q @ q.T
                np.fill_diagonal(own, -np.inf)
                top = np.argsort(-own, 1, kind="stable")[:, : min(BUILD_BEAM, len(q) - 1)]
                node = np.concatenate([node, (top + begin).astype(np.int32)], 1)
                near = np.concatenate([near, np.take_along_axis(own, top, 1)], 1)
                order = np.argsort(-near, 1, kind="stable")
                layer.add(np.arange(begin, end), np.take_along_axis(node, order, 1), np.take_along_axis(near, order, 1))
                begin = end

    def _entries(self, q: np.ndarray, layer: int, built: int) -> np.ndarray:
        """Where a search of a layer starts: the best nodes of the layers above, as far as they are built."""
        top = min(128, self.sizes[0])
        sim = q @ self.x[:top].T
        node = np.argsort(-sim, 1, kind="stable")[:, :4].astype(np.int32)
        for k in range(1, layer):
            node = self.layers[k].search(q, node, 8)[0][:, :4]
        return np.where(node < built, node, 0)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, np.float32)
        got = [self.layers[-1].search(p, self._entries(p, len(self.sizes) - 1, len(self.x)), min(beam, len(self.x))) for p in (q[a : a + STEP] for a in range(0, len(q), STEP))]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def units(raw: bytes, dim: int) -> np.ndarray:
    """Vectors of length one, in double precision."""
    x = np.frombuffer(raw, np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def links_of(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, node, beam used) of all links found, once the audit passes. The similarity is the exact one."""
    some = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(np.int64))
    sure = q[some] @ x.T
    order = np.argsort(-sure, 1, kind="stable")[:, : QUERY_BEAM // 2]  # the nearest, which any beam should hold
    close = [set(o[:NEAREST].tolist()) for o in order]
    sure = [set(o[v >= cosine].tolist()) for o, v in zip(order, np.take_along_axis(sure, order, 1))]
    want = sum(map(len, sure))
    beam = QUERY_BEAM
    while True:
        node, near = graph.search(q, beam)
        full = np.flatnonzero(near.min(1) >= cosine - 1e-6) if beam < len(x) else np.zeros(0, np.int64)
        row, col = np.nonzero((node >= 0) & (near >= cosine - 1e-5))
        a, b = row, node[row, col].astype(np.int64)
        sim = np.concatenate([np.einsum("kd,kd->k", q[a[s : s + 65536]], x[b[s : s + 65536]]) for s in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
        a, b = a[sim >= cosine], b[sim >= cosine]
        found = sum(len(own.intersection(b[a == i].tolist())) for i, own in zip(some.tolist(), sure))
        seen = sum(len(own.intersection(node[i].tolist())) for i, own in zip(some.tolist(), close))
        passed = found >= RECALL * want and seen >= NAVIGABLE * sum(map(len, close))
        if beam >= len(x) or (passed and not len(full)):
            return a, b, beam
        beam = min(2 * beam, len(x))
        if len(full) and passed:  # only the queries whose beam was full go on
            rest_a, rest_b, used = links_of_rest(graph, x, q[full], cosine, beam)
            keep = ~np.isin(a, full)
            return np.concatenate([a[keep], full[rest_a]]), np.concatenate([b[keep], rest_b]), used


def links_of_rest(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links of queries whose beam was full: wider beams, and for those with still more links a block product with the shard."""
    if beam > 2 * QUERY_BEAM:
        got = [np.nonzero(q[s : s + STEP] @ x.T >= cosine) for s in range(0, len(q), STEP)]
        return np.concatenate([g[0] + s for g, s in zip(got, range(0, len(q), STEP))]), np.concatenate([g[1] for g in got]), beam
    node, near = graph.search(q, beam)
    full = near.min(1) >= cosine - 1e-6
    row, col = np.nonzero((node >= 0) & (near >= cosine - 1e-5) & ~full[:, None])
    b = node[row, col].astype(np.int64)
    good = np.einsum("kd,kd->k", q[row], x[b]) >= cosine
    a, b = row[good], b[good]
    if full.any():
        which = np.flatnonzero(full)
        more_a, more_b, beam = links_of_rest(graph, x, q[which], cosine, 2 * beam)
        a, b = np.concatenate([a, which[more_a]]), np.concatenate([b, more_b])
    return a, b, beam


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id of its tree) for all ids but the smallest of each tree."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    return [(i, r) for i in up if (r := root(i)) != i]


PACK = "label string, dim int, part long, ids binary, vectors binary"


def packed(keys: tuple, batch: pa.Table) -> pa.Table:
    """All nodes of a group, in an order by hash, in one row."""
    ids = np.frombuffer(batch.column("node").combine_chunks().to_numpy().astype(np.int64).tobytes(), np.int64)
    order = np.argsort((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    raw = batch.column("vector").to_pylist()
    return pa.table({
        "label": pa.array([keys[0].as_py()], pa.string()), "dim": pa.array([keys[1].as_py()], pa.int32()), "part": pa.array([keys[2].as_py()], pa.int64()),
        "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([b"".join(raw[i] for i in order.tolist())], pa.binary()),
    })


def blocks(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.withColumn("part", F.expr(part)).groupBy("label", "dim", "part").applyInArrow(packed, PACK)


def classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                good = len(x) and np.isfinite(x).all() and x.any()
                out.append((len(x) if good else None, (x + 0.0).tobytes() if good else None))  # both zeros are one number
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["key", "label", "dim", "vector"])

    rows = vectors.select(F.col(key).try_cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    rows = stored(rows.mapInArrow(read, "key long, label string, dim int, vector binary").withColumn("same", F.sha2("vector", 256)), "vectors")
    nodes = rows.where("key is not null and dim is not null and label is not null").groupBy("label", "dim", "same").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    nodes = stored(nodes.join(sizes, ["label", "dim"]).withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold once they are written

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(Graph(units(v, d))) for v, d in zip(batch.column("vectors").to_pylist(), batch.column("dim").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", "dim", "part", "ids", "vectors")] + [pa.array(made, pa.binary())], ["label", "dim", "part", "ids", "vectors", "graph"])

    one = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}  # a shard or block is megabytes; tasks hold one at a time
    before = {k: spark.conf.get(k) for k in one}
    for k, v in one.items():
        spark.conf.set(k, v)
    try:
        shards = stored(blocks(nodes, f"pmod(xxhash64(same), ceil(n / {SHARD}))").repartition("label", "dim", "part").mapInArrow(build, PACK + ", graph binary"), "shards")
        asked = stored(blocks(nodes, f"pmod(xxhash64(same, 1), ceil(n / {BLOCK}))"), "asked")
        where = shards.select("label", "dim", F.col("part").alias("shard"))
        pairs = asked.join(where, ["label", "dim"]).join(shards.select("label", "dim", F.col("part").alias("shard"), F.col("ids").alias("s_ids"), F.col("vectors").alias("s_vectors"), "graph"), ["label", "dim", "shard"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, ids, vs, s_ids, s_vs, graph in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "vectors", "s_ids", "s_vectors", "graph"))):
                    ids, s_ids = np.frombuffer(ids, np.int64), np.frombuffer(s_ids, np.int64)
                    a, b, _ = links_of(pickle.loads(graph), units(s_vs, dim), units(vs, dim), cosine)
                    trees = forest(ids[a], s_ids[b])
                    yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in trees], pa.int64()), pa.array([t[1] for t in trees], pa.int64())], ["a", "b"])

        found = pairs.select("dim", "ids", "vectors", "s_ids", "s_vectors", "graph").repartition(max(1, asked.count())).mapInArrow(search, "a long, b long")
        joined = stored(components(stored(found, "trees")), "components")

        # links among the nodes of each component, block by block
        member = nodes.join(joined, F.col("node") == F.col("id")).select("component_id", "dim", "node", "copies", "vector")
        many = member.groupBy("component_id").agg(F.count("*").alias("m"))
        member = member.join(many, "component_id").withColumn("part", F.expr(f"pmod(xxhash64(node), ceil(m / {COUNT_BLOCK}))"))

        def pack(keys: tuple, batch: pa.Table) -> pa.Table:
            return pa.table({
                "component_id": pa.array([keys[0].as_py()], pa.int64()), "part": pa.array([keys[1].as_py()], pa.int64()), "dim": batch.column("dim").slice(0, 1), "parts": pa.array([-(-batch.column("m")[0].as_py() // COUNT_BLOCK)], pa.int64()),
                "ids": pa.array([batch.column("node").combine_chunks().to_numpy().tobytes()], pa.binary()), "copies": pa.array([batch.column("copies").combine_chunks().to_numpy().tobytes()], pa.binary()), "vectors": pa.array([b"".join(batch.column("vector").to_pylist())], pa.binary()),
            })

        packs = stored(member.groupBy("component_id", "part").applyInArrow(pack, "component_id long, part long, dim int, parts long, ids binary, copies binary, vectors binary"), "blocks")
        other = packs.select("component_id", F.col("part").alias("other"), F.col("copies").alias("o_copies"), F.col("vectors").alias("o_vectors"))
        product = packs.select("component_id", "part", "dim", "ids", "copies", "vectors", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).join(other, ["component_id", "other"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, ids, copies, vs, o_copies, o_vs, own in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "copies", "vectors", "o_copies", "o_vectors", "own"))):
                    near = units(vs, dim) @ units(o_vs, dim).T >= cosine
                    if own:
                        np.fill_diagonal(near, True)
                    n = near @ np.frombuffer(o_copies, np.int64) - (1 if own else 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(n.astype(np.int64))], ["node", "n_links"])

        told = product.withColumn("own", F.col("part") == F.col("other")).select("dim", "ids", "copies", "vectors", "o_copies", "o_vectors", "own").mapInArrow(count, "node long, n_links long")
        counted = stored(told.groupBy("node").agg(F.sum("n_links").alias("n_links")), "counts")  # while a batch holds one row
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

    named = nodes.join(joined, F.col("node") == F.col("id")).groupBy("component_id").agg(F.min("least").alias("smallest"))
    joined = joined.join(named, "component_id").select(F.col("id").alias("node"), "smallest")
    of_node = nodes.select("label", "dim", "same", "node", "least", "copies").join(counted, "node", "left").join(joined, "node", "left")
    out = rows.select("key", "label", "dim", "same").join(of_node, ["label", "dim", "same"], "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("smallest", "least", "key"))
    return out.select(
        F.col("key").alias(key),
        F.when(F.col("key").isNotNull(), F.coalesce("n_links", F.col("copies") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("key"), F.lit(False)).alias("kept"),
    )
