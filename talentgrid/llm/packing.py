"""Best-fit packing of documents into training sequences, by bin completion.

Pieces of one length can change places, so the search needs no documents, only how many pieces there are of each
length: at most ``limit`` numbers, however large the corpus is. Spark encodes, cuts and counts; the search turns the
counts into patterns (a filling and how often it is used); Spark numbers the pieces of every length and gives each its
place in the patterns. No piece goes through the driver, and a length that a third of all pieces have is numbered
partition by partition.

The search takes the largest piece that is left, enumerates the undominated fillings around it, fullest first, and
branches on them; a branch is left when its waste passes what the incumbent allows. The first incumbent is a best-fit
packing. A filling is used as often as the counts allow, and once as the alternative. A search ends when the lower
bound is met (which proves the number of sequences smallest), when the branches end or after ``STEPS`` steps.

Defined results: null and empty texts are the end token alone. Rows with null or repeated ids are packed like all
others, each by itself. Equal lengths and repeated rows change places freely. An empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm import bpe
from talentgrid.llm.common import slices, stored

LIMIT = 4096
END_ID = 1
#: Elementary steps of each search (one or two microseconds each); after them the best packing so far stands.
STEPS = 2_000_000
#: Steps and fillings of one enumeration: narrow first, which goes deep quickly, then wide.
WIDTHS = ((300, 6), (1200, 12))

#: A filling: (length, how many) pairs, longest first.
Filling = tuple[tuple[int, int], ...]


# ---------------------------------------------------------------- the search
def lower_bound(counts: dict[int, int], limit: int) -> int:
    """Sequences that any packing needs: for each small length k, what lies over half a sequence can't share one,
    and pieces of k at least that don't fit beside these need more."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], dtype=object)
    if not len(lengths):
        return 0
    total = int((lengths * n).sum())
    best = -(-total // limit)
    upto_n, upto_sum = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(lengths * n)])
    half = int(np.searchsorted(lengths, limit // 2, "right"))
    for k in [0, *lengths[:half].tolist()]:
        large, small = int(np.searchsorted(lengths, limit - k, "right")), int(np.searchsorted(lengths, k))
        wide = int(upto_n[-1] - upto_n[large])
        middle, filled = int(upto_n[large] - upto_n[half]), int(upto_sum[large] - upto_sum[half])
        rest = int(upto_sum[half] - upto_sum[small]) - (middle * limit - filled)
        best = max(best, wide + middle + max(0, -(-rest // limit)))
    return best


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: each length goes to the fullest sequences that still take it."""
    rooms: list[int] = []
    open_at: dict[int, dict[Filling, int]] = {}

    def put(room: int, filling: Filling, times: int) -> None:
        if room not in open_at:
            open_at[room] = {}
            insort(rooms, room)
        open_at[room][filling] = open_at[room].get(filling, 0) + times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, filling, there = limit, (), left
            else:
                room = rooms[at]
                filling, there = open_at[room].popitem()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            each = room // length
            full = min(there, left // each)
            if full:
                put(room - each * length, (*filling, (length, each)), full)
                left, there = left - full * each, there - full
            if there and 0 < left < each:
                put(room - left * length, (*filling, (length, left)), 1)
                left, there = 0, there - 1
            if there and filling:
                put(room, filling, there)
    return [(filling, times) for room in rooms for filling, times in open_at[room].items()]


class Search:
    """Bin completion over counts of lengths."""

    def __init__(self, counts: dict[int, int], limit: int, width: tuple[int, int] = WIDTHS[-1], steps: int = STEPS):
        self.limit, self.steps, self.width = limit, steps, width
        self.left = dict(counts)
        self.falling = sorted(-x for x in counts)  # lengths that are left, negative: the longest first
        self.lower = lower_bound(counts, limit)
        self.best = best_fit(counts, limit)
        self.size = len_of(self.best)
        self.total = sum(length * n for length, n in counts.items())

    def take(self, filling: Filling, times: int) -> None:
        for length, many in filling:
            self.left[length] -= many * times
            if not self.left[length]:
                del self.falling[bisect_left(self.falling, -length)]

    def give_back(self, filling: Filling, times: int) -> None:
        for length, many in filling:
            if not self.left[length]:
                insort(self.falling, -length)
            self.left[length] += many * times

    def fillings(self, first: int, slack: int) -> list[tuple[int, Filling]]:
        """(waste, what to add) of the undominated ways to complete a sequence around a piece of length ``first``, which has
        been taken; fullest first, none that wastes more than ``slack``."""
        gap, falling, left = self.limit - first, self.falling, self.left
        at = bisect_left(falling, -gap)
        if at == len(falling):
            return [(gap, ())] if gap <= slack else []
        if falling[at] == -gap:  # one piece that fills the gap dominates every other filling
            return [(0, ((gap, 1),))]
        found: list[tuple[int, Filling]] = []
        # (place of the next length, room, chosen): long pieces and many of them first
        stack: list[tuple[int, int, Filling]] = [(at, gap, ())]
        (budget, most_found), perfect = self.width, 0
        while stack and budget and len(found) < most_found and perfect < 3:
            budget -= 1
            at, room, chosen = stack.pop()
            at = max(at, bisect_left(falling, -room))
            if at == len(falling):
                if room <= slack and not self.dominated(chosen, room):
                    found.append((room, chosen))
                    perfect += not room
                continue
            length = -falling[at]
            most = min(left[length], room // length)
            for many in range(most + 1) if most < 4 else (0, most - 1, most):
                stack.append((at + 1, room - many * length, (*chosen, (length, many)) if many else chosen))
        self.steps -= self.width[0] - budget
        return sorted(found, key=lambda x: x[0])

    def dominated(self, chosen: Filling, room: int) -> bool:
        """Whether one unused piece can be added, or stand in for one or two of the chosen ones and fill no less."""
        used, falling = dict(chosen), self.falling

        def unused(longest: int, shortest: int) -> bool:
            a, b = bisect_left(falling, -longest), bisect_left(falling, 1 - shortest)
            return any(self.left[-x] > used.get(-x, 0) for x in falling[a:b])

        if room and unused(room, 1):
            return True
        few = [length for length, _ in chosen[-6:]]
        twos = {a + b for i, a in enumerate(few) for b in few[:i]} | {2 * length for length, many in chosen[-6:] if many > 1}
        return any(unused(s + room, s) for s in twos) or (room > 0 and any(unused(s + room, s + 1) for s in few))

    def choices(self, waste: int) -> list[tuple[int, Filling, int]]:
        """(waste, filling, times) to branch on around the longest piece that is left, the best one last."""
        first, slack = -self.falling[0], (self.size - 1) * self.limit - self.total - waste
        if slack < 0:
            return []
        self.take(((first, 1),), 1)
        found = self.fillings(first, slack)
        self.give_back(((first, 1),), 1)
        out = []
        for lost, chosen in found:
            need = {first: 1}
            for length, many in chosen:
                need[length] = need.get(length, 0) + many
            times = min(self.left[length] // many for length, many in need.items())
            out.append((lost, tuple(need.items()), max(1, min(times, slack // lost)) if lost else times))
        return [*out, *((lost, filling, 1) for lost, filling, times in out if times > 1)][::-1]

    def run(self) -> list[tuple[Filling, int]]:
        """The best packing found, as (filling, times)."""
        waste = used = 0
        path: list[tuple[list, list]] = []  # at each depth: what is taken there (waste, filling, times), and the choices that remain
        todo = self.choices(0) if self.falling else []
        while self.size > self.lower and self.steps > 0:
            self.steps -= 1
            if not todo:  # go back to the last depth that has another choice
                if not path:
                    break
                (lost, filling, times), todo = path.pop()
                self.give_back(filling, times)
                waste, used = waste - lost * times, used - times
                continue
            lost, filling, times = todo.pop()
            self.take(filling, times)
            path.append(((lost, filling, times), todo))
            waste, used = waste + lost * times, used + times
            if self.falling:
                todo = self.choices(waste)
            else:
                if used < self.size:
                    self.size, self.best = used, [(f, n) for (_, f, n), _ in path]
                todo = []
        return self.best


def planned(counts: dict[int, int], limit: int = LIMIT, steps: int = STEPS) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, so that all pieces are placed in as few sequences as the search finds."""
    counts = {length: n for length, n in counts.items() if n}
    best = None
    for width in WIDTHS:
        search = Search(counts, limit, width, steps)
        if best and len_of(best) < search.size:
            search.best, search.size = best, len_of(best)
        best = search.run()
    return best


def len_of(plan: list[tuple[Filling, int]]) -> int:
    """Sequences of a packing."""
    return sum(times for _, times in plan)


# ---------------------------------------------------------------- pieces and places
def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, nth): the pieces of all documents; nth numbers the pieces of one length
    within a partition. With ``ids`` the token ids of each piece come too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, part_no = bpe.encoder(path), np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, text):
                flat, off = coder.encode(part.column(text))
                flat = np.insert(flat.astype("<u4"), off[1:], end_id)
                off = off + np.arange(len(off))
                many = -(-np.diff(off) // limit)
                owner = np.repeat(np.arange(len(many)), many)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * limit
                length = np.minimum(limit, np.diff(off)[owner] - start)
                begin, raw = (off[owner] + start).tolist(), memoryview(flat)
                order = np.argsort(length, kind="stable")
                sizes, first, count = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(first - seen[sizes], count)
                seen[sizes] += count
                cols = {
                    key: part.column(key).take(pa.array(owner)),
                    "piece": piece.astype(np.int32),
                    "start": start.astype(np.int64),
                    "length": length.astype(np.int64),
                    "ids_crc32": np.array([zlib.crc32(raw[a : a + n]) for a, n in zip(begin, length.tolist())], np.int64),
                    "part": np.full(len(owner), part_no, np.int32),
                    "nth": nth,
                }
                if ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(cols)

    schema = f"`{key}` {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<long>" * ids
    return docs.select(key, text).mapInArrow(run, schema)


def slots(plan: list[tuple[Filling, int]], counts: dict[int, int]) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go: runs of numbers of pieces, shortest length first, with the first sequence, how many
    pieces of the run one sequence takes, the offset of the first of these, and their length."""
    base, at = {}, 0
    for length in sorted(counts):
        base[length], at = at, at + counts[length]
    runs, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for length, many in filling:
            runs.append((base[length], sequence, many, offset, length))
            base[length] += many * times
            offset += many * length
        sequence += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(runs)))


def placed(found: DataFrame, limit: int = LIMIT, steps: int = STEPS) -> DataFrame:
    """The rows of ``found``, a written table of ``pieces``, with sequence_id and offset instead of part and nth."""
    per_part = found.groupBy("length", "part").agg(F.count("*").alias("own"))
    counts = {r["length"]: r["own"] for r in per_part.groupBy("length").agg(F.sum("own").alias("own")).collect()}  # at most ``limit`` rows
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = per_part.select("length", "part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))
    numbered = found.join(before, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "part")
    if not counts:
        return numbered.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("nth")
    begin, sequence, many, offset, size = slots(planned(counts, limit, steps), counts)
    shortest = np.array(sorted(counts), np.int64)
    base = np.concatenate([[0], np.cumsum([counts[x] for x in shortest.tolist()])])[:-1]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in numbered.dtypes if c != "nth") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = base[np.searchsorted(shortest, length)] + batch.column("nth").to_numpy()
            at = np.searchsorted(begin, number, "right") - 1
            apart = number - begin[at]
            cols = {c: batch.column(c) for c in batch.schema.names if c != "nth"}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": sequence[at] + apart // many[at], "offset": offset[at] + apart % many[at] * size[at]})

    return numbered.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, text: str = "text", key: str = "doc_id", steps: int = STEPS, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document; ``ids`` adds the token ids."""
    found = stored(pieces(docs, path, limit, end_id, text, key, ids), "pieces")
    return placed(found, limit, steps).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of every training sequence, from the rows of ``pack(..., ids=True)``; a sequence is at most ``limit`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    return rows.select("sequence_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
