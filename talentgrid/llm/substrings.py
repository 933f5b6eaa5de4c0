"""Exact substring deduplication with suffix arrays.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts in a document with a
smaller id. The work is dealt out by content: in every window of LENGTH bytes the 25-byte gram with
the smallest hash is its anchor, so equal windows have equal anchors at equal places.

1. Anchors that occur in one text only can't be part of a match. They are compared within slabs of text first and then, packed,
   within buckets of bounded size; an anchor that many texts hold sends one entry for each slab.
2. Around each remaining anchor lies the segment of the windows that it anchors. Equal segments are
   counted once, with the smallest id that has them; copies need nothing more.
3. Where an anchor has several different segments, those that may share a window, by its hash, are
   matched with a suffix array of the segments laid end to end. It is built by grouping: suffixes are grouped by their first
   symbol; groups are processed in descending order, each suffix pointing at the nearest earlier
   suffix of a smaller group, and what is pointed at equally often moves into a group of its own just
   above its old one, until groups are the classes of equal Lyndon prefixes. Then the order of each
   group is emitted by one pass along those pointers. Nothing is renamed and nothing recurses.
4. Runs of adjacent suffixes that agree in LENGTH bytes give each window its smallest id.

No task holds an unbounded group: where an anchor has more than ``MOST_SEGMENTS`` different segments, these are cut again around
longer grams and matched the same way, down to grams of LENGTH bytes, where a group is one window. Whole copies of a text with
a smaller id are settled by a digest of the text. Null and empty texts have no bytes; rows without an id count as the largest
id; rows that share an id don't remove each other's bytes. Ids are numbers, or text that reads as one. One text of 256 MB or
more is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.bpe import Powers
from talentgrid.llm.common import _BYTE, discard, lean, long_of, mixed, offsets_of, only, release, slices, stored

LENGTH = 50
#: Bytes of the grams that anchors are chosen from, by level.
GRAMS = (25, 38, 50)
#: Different segments of one anchor that one suffix array may hold.
MOST_SEGMENTS = 2000
#: Bytes that are laid end to end for one suffix array; small anchors share one.
ARRAY_BYTES = 8192
LAST = (1 << 63) - 1
#: The bits of a hash that order anchors.
ORDER = np.uint64(2**64 - 2**28)
#: Bytes of segments whose windows are compared by hash before any array is built.
FILTER_BYTES = 1 << 20
#: Bytes of text whose anchors are found at once; about thirty times as much is held meanwhile.
TEXT_BYTES = 1 << 18
#: Anchors that a task compares with each other before they are shuffled, and those that share a bucket afterwards.
SLAB, BUCKET = 1 << 20, 1 << 20
#: A text must be shorter than this: places take 28 bits.
MOST_BYTES = 1 << 28


# ---------------------------------------------------------------- suffix arrays
def suffix_array(codes: list[int]) -> list[int]:
    """The order of all suffixes of codes, whose last symbol is smaller than all others."""
    n = len(codes)
    size: dict[int, int] = {}
    for c in codes:
        size[c] = size.get(c, 0) + 1
    start, at = {}, 0
    for c in sorted(size):
        start[c] = at
        at += size[c]
    group = [start[c] for c in codes]  # a group is named by its first place in the array
    size = {start[c]: k for c, k in size.items()}
    begins = {g + k: g for g, k in size.items()}  # by the place after its last
    members: dict[int, list[int]] = {g: [] for g in size}
    for i, g in enumerate(group):
        members[g].append(i)
    before = [-1] * n
    end = n
    while end:
        g = begins[end]
        hit: dict[int, int] = {}
        for i in members.pop(g):  # they are in text order, and so is what they point at
            if group[i] != g:
                continue
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                hit[j] = hit.get(j, 0) + 1
        if hit:
            often: dict[int, dict[int, list[int]]] = {}
            for j, k in hit.items():
                often.setdefault(k, {}).setdefault(group[j], []).append(j)
            for k in sorted(often, reverse=True):  # few: their sum is the size of the group at most
                for old, moved in often[k].items():
                    whole, part = size[old], len(moved)
                    if part == whole:
                        continue
                    new = old + whole - part
                    for j in moved:
                        group[j] = new
                    members[new], size[new], size[old] = moved, part, whole - part
                    begins[old + whole], begins[new] = new, old
        end = g
    out, done, free = [-1] * n, [False] * n, {g: g for g in set(group)}
    out[0], done[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]], done[j] = j, True
            free[g] += 1
            j = before[j]
    return out


def smallest_ids(segments: list[bytes], ids: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each segment, the smallest id of a segment that holds the same window."""
    text = b"".join(s + b"\0" for s in segments)
    raw = np.frombuffer(text, np.uint8)
    sizes = np.array([len(s) for s in segments])
    begin = np.cumsum(sizes + 1) - sizes - 1
    codes = raw.astype(np.int64) + 2
    codes[begin + sizes] = 1  # ends of segments; no window reaches across one
    order = np.array(suffix_array([*codes.tolist(), 0]))
    windows = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(len(raw) + 1, bool)
    owner = np.repeat(np.arange(len(segments)), windows)
    where = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
    valid[where] = True
    id_at = np.zeros(len(raw) + 1, np.int64)
    id_at[where] = np.array(ids, np.int64)[owner]
    order = order[valid[order]]
    views = np.lib.stride_tricks.sliding_window_view(raw, length)[order]
    new = np.concatenate([[True], (views[1:] != views[:-1]).any(1)])
    first = np.flatnonzero(new)
    best = np.minimum.reduceat(id_at[order], first)
    id_at[order] = best[np.cumsum(new) - 1]
    return [id_at[b : b + w] for b, w in zip(begin.tolist(), windows.tolist())]


def sharing(groups: np.ndarray, segments: list[bytes]) -> np.ndarray:
    """Which segments have a window that another segment of their group may have, by hash."""
    sizes = np.array([len(s) for s in segments])
    raw = np.frombuffer(b"".join(segments), np.uint8)
    up, down = Powers.of(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * down[: len(raw)], dtype=np.uint64)])
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(sizes) - sizes)[owner]
    key = mixed((total[at + LENGTH] - total[at]) * up[at]) ^ mixed(groups.view(np.uint64))[owner]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return np.logical_or.reduceat(count[back] > 1, np.cumsum(n) - n)


# ---------------------------------------------------------------- anchors
def anchors(raw: np.ndarray, off: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, anchor hash, first window's place in raw, windows, hash of the segment)."""
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    grams, span = len(raw) - gram + 1, LENGTH - gram + 1
    windows = grams - span + 1
    if windows <= 0:
        return nothing
    up, down = Powers.of(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * down[: len(raw)], dtype=np.uint64)])
    g = mixed((total[gram:] - total[:-gram]) * up[:grams])
    # 36 bits of the hash before 28 of the place: the smallest hash, the leftmost among equals, by plain minima
    best, reach = (g & ORDER) | np.arange(grams, dtype=np.uint64), 1
    while reach < span:
        step = min(reach, span - reach)
        best = np.minimum(best[:-step], best[step:])
        reach += step
    best = (best & ~ORDER).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:windows]
    inside = np.arange(windows) + LENGTH <= off[1:][row]
    at = np.flatnonzero(inside)
    if not len(at):
        return nothing
    new = np.concatenate([[True], (best[at][1:] != best[at][:-1]) | (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])])
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    end = first + count - 1 + LENGTH
    segment = mixed(((total[end] - total[first]) * up[first]) ^ mixed(count.astype(np.uint64)))
    return row[first], g[best[first]], first, count, segment


def packed(h: np.ndarray, tid: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The anchors of a slab by bucket, as bytes: what only one text of the slab has (bucket by hash), what several have (bucket -1),
    and one entry of each of these (told), which lets other slabs know."""
    order = np.argsort(h, kind="stable")
    h, tid = h[order], tid[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = np.minimum.reduceat(tid, first) != np.maximum.reduceat(tid, first)
    every = np.repeat(several, np.diff(np.append(first, len(h))))
    h1, t1, told = h[first], tid[first], several
    bucket = ((h1 >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, h1, t1, told = bucket[order], h1[order], t1[order], told[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cut[1:], len(bucket))
    rows = [(-1, h[every].tobytes(), tid[every].tobytes(), b"")] if every.any() else []
    rows += [(int(bucket[a]), h1[a:b].tobytes(), t1[a:b].tobytes(), told[a:b].tobytes()) for a, b in zip(cut.tolist(), ends.tolist())]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "h", "tid", "told"])


def of_several(batch: pa.Table) -> pa.Table:
    """(h, tid) of a bucket's anchors that several texts have, without those that are known already."""
    h, tid = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("h", "tid"))
    told = np.frombuffer(b"".join(batch.column("told").to_pylist()), bool)
    if not len(told):
        return pa.table({"h": h, "tid": tid})
    order = np.argsort(h, kind="stable")
    h, tid, told = h[order], tid[order], told[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = (np.minimum.reduceat(tid, first) != np.maximum.reduceat(tid, first)) | np.logical_or.reduceat(told, first)
    keep = np.repeat(several, np.diff(np.append(first, len(h)))) & ~told
    return pa.table({"h": h[keep], "tid": tid[keep]})


def shared_anchors(texts: DataFrame, n_bytes: int) -> DataFrame:
    """(h, tid): the anchors that occur in several texts."""
    buckets = max(1, n_bytes // (BUCKET * 8))  # there is one anchor to 13 bytes, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # eight bytes for each text of the task
        hs, tids, held = [], [], 0
        for batch in batches:
            new = [t not in seen and not seen.add(t) for t in batch.column("tid").to_pylist()]
            for part in slices(batch.filter(pa.array(new)), "text", TEXT_BYTES):
                row, h, *_ = anchors(*offsets_of(part.column("text")))
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                hs.append(h[keep])
                tids.append(part.column("tid").to_numpy()[row[keep]])
                held += len(hs[-1])
                if held > SLAB:
                    yield packed(np.concatenate(hs), np.concatenate(tids), buckets)
                    hs, tids, held = [], [], 0
        if held:
            yield packed(np.concatenate(hs), np.concatenate(tids), buckets)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, tid in zip(batch.column("h").to_pylist(), batch.column("tid").to_pylist()):
                yield pa.RecordBatch.from_pydict({"h": np.frombuffer(h, np.int64), "tid": np.frombuffer(tid, np.int64)})

    slabs = stored(texts.select("tid", "text").mapInArrow(run, "bucket long, h binary, tid binary, told binary"), "slabs")
    here = slabs.where("bucket < 0").select("h", "tid").mapInArrow(known, "h long, tid long")
    across = slabs.where("bucket >= 0").groupBy("bucket").applyInArrow(of_several, "h long, tid long")
    found = stored(here.unionByName(across), "anchors")
    discard(slabs)
    return found


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, seg, doc, tid, at, n, body) around the known anchors (hs) of each text; a segment's bytes are sent once for each task."""
    sent: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            raw, off = offsets_of(part.column("text"))
            row, h, first, count, seg = anchors(raw, off)
            hs = part.column("hs")
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(hs).to_numpy(zero_copy_only=False))])
            flat, known = hs.flatten().to_numpy(), np.zeros(len(h), bool)
            cut = np.searchsorted(row, np.arange(len(off)))
            for r in range(len(off) - 1):
                known[cut[r] : cut[r + 1]] = np.isin(h[cut[r] : cut[r + 1]].view(np.int64), flat[bounds[r] : bounds[r + 1]])
            row, h, first, count, seg = (x[known] for x in (row, h, first, count, seg))
            if len(sent) > 500_000:
                sent = set()
            bodies, view = [], memoryview(raw)
            for s, a, c in zip(seg.tolist(), first.tolist(), count.tolist()):
                if s in sent:
                    bodies.append(None)
                else:
                    sent.add(s)
                    bodies.append(bytes(view[a : a + c - 1 + LENGTH]))
            cols = [
                pa.array(long_of(h)), pa.array(long_of(seg)), *(part.column(c).take(pa.array(row)) for c in ("doc", "tid")),
                pa.array(first - off[row]), pa.array(count.astype(np.int32)), pa.array(bodies, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["h", "seg", "doc", "tid", "at", "n", "body"])


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seg, h, best) of the segments (h, seg, doc, body) of small groups, which come together: the smallest id of each window."""

    def matched(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keep = sharing(np.array([r[0] for r in rows], np.int64), [r[3] for r in rows])
        rows = [r for r, k in zip(rows, keep.tolist()) if k]
        first = held = 0
        for k in range(len(rows) + 1):
            if k and (k == len(rows) or held > ARRAY_BYTES and rows[k][0] != rows[k - 1][0]):
                part = rows[first:k]
                best = [b.tobytes() for b in smallest_ids([r[3] for r in part], [r[2] for r in part])]
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in part], pa.int64()), pa.array([r[0] for r in part], pa.int64()), pa.array(best, pa.binary())], ["seg", "h", "best"])
                first, held = k, 0
            if k < len(rows):
                held += len(rows[k][3])

    rows, held = [], 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("h", "seg", "doc", "body"))):
            if held > FILTER_BYTES and r[0] != rows[-1][0]:
                yield from matched(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[3])
    if rows:
        yield from matched(rows)


def smallest(distinct: DataFrame, level: int = 0) -> DataFrame:
    """(seg, h, best): the smallest id of each window of segments (h, seg, doc, body) that share an anchor with others; where it is the
    segment's own id throughout, a row may be left out."""
    kinds = distinct.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = stored(distinct.join(kinds, "h"), "several")
    small = several.where(F.col("kinds") <= MOST_SEGMENTS).select("h", "seg", "doc", "body").repartition("h").sortWithinPartitions("h", "seg")
    best = small.mapInArrow(arrays, "seg long, h long, best binary")
    large = several.where(F.col("kinds") > MOST_SEGMENTS)
    if level + 1 == len(GRAMS) or large.isEmpty():
        return best
    gram = GRAMS[level + 1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", TEXT_BYTES):
                raw, off = offsets_of(part.column("body"))
                row, h, first, count, seg = anchors(raw, off, gram)
                upper = part.column("h").to_numpy()[row]
                bodies = [bytes(memoryview(raw)[a : a + c - 1 + LENGTH]) for a, c in zip(first.tolist(), count.tolist())]
                cols = [pa.array(long_of(h ^ mixed(upper.view(np.uint64)))), pa.array(long_of(seg)), pa.array(first - off[row]), pa.array(count.astype(np.int32)), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(upper), *(part.column(c).take(pa.array(row)) for c in ("seg", "doc")), *cols], ["upper", "of", "doc", "h", "seg", "at", "n", "body"])

    pieces = stored(large.select("h", "seg", "doc", "body").mapInArrow(cut, "upper long, of long, doc long, h long, seg long, at long, n int, body binary"), "pieces")
    own = stored(pieces.groupBy("h", "seg").agg(F.min("doc").alias("doc"), F.max("body").alias("body")), "segments")
    found = pieces.select("upper", "of", "h", "seg", "at", "n").join(own.select("h", "seg", F.col("doc").alias("first_doc")), ["h", "seg"]).join(smallest(own, level + 1), ["h", "seg"], "left")
    whole = found.groupBy("upper", "of").agg(F.array_sort(F.collect_list(F.struct("at", "n", "first_doc", "best"))).alias("parts"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(p["best"] or np.full(p["n"], p["first_doc"], np.int64).tobytes() for p in parts) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("upper"), pa.array(ids, pa.binary())], ["seg", "h", "best"])

    return best.unionByName(whole.mapInArrow(put_together, "seg long, h long, best binary"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, doc, start, end): the bytes of occurrences (tid, doc, at, best) under windows whose smallest id is less than the document's."""
    for batch in batches:
        n = pc.binary_length(batch.column("best")).to_numpy() // 8
        ids, _ = offsets_of(batch.column("best"))
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(np.frombuffer(ids.tobytes(), np.int64) < batch.column("doc").to_numpy()[row])
        if not len(hit):
            continue
        new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)])
        first, last = hit[new], hit[np.append(new[1:], True)]
        at = batch.column("at").to_numpy()[row[first]]
        cols = [*(batch.column(c).take(pa.array(row[first])) for c in ("tid", "doc")), pa.array(at + place[first]), pa.array(at + place[last] + LENGTH)]
        yield pa.RecordBatch.from_arrays(cols, ["tid", "doc", "start", "end"])


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, doc, n_removed, n_spans, kept) of texts with their spans (starts, ends), in any order."""
    for batch in batches:
        out = []
        sides = [batch.column(c) for c in ("starts", "ends")]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(sides[0]).to_numpy())]).tolist()
        flat = [c.flatten().to_numpy() for c in sides]
        for r, text in enumerate(batch.column("text")):
            start, end = (f[bounds[r] : bounds[r + 1]] for f in flat)
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.concatenate([[True], start[1:] > end[:-1]])
            first, last = start[new].tolist(), end[np.append(new[1:], True)].tolist()
            raw, sha = memoryview(text.as_buffer()), hashlib.sha256()
            for a, b in zip([0, *last], [*first, len(raw)]):
                sha.update(raw[a:b])
            out.append((sum(last) - sum(first), len(first), sha.hexdigest()))
        cols = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("doc"), *cols], ["tid", "doc", "n_removed", "n_spans", "kept"])


def removed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    lean(spark)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), raw.alias("text"))
    named = docs.withColumn("tid", F.xxhash64("text", F.sha1("text")))  # with the smallest id of its text it names a text
    rows = stored(named.select("key", "doc", "tid", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha")), "rows")
    total, longest = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if longest >= MOST_BYTES:
        raise ValueError(f"a text of {longest} bytes is too long; {MOST_BYTES - 1} are allowed")
    firsts = stored(rows.where(F.col("n") >= LENGTH).groupBy("tid", "sha").agg(F.min("doc").alias("doc")), "firsts")

    # 1. anchors of more than one text
    shared = shared_anchors(named, total)
    release(spark)

    # 2. segments around them
    lists = shared.groupBy("tid").agg(F.collect_list("h").alias("hs")).join(firsts.select("tid", "doc"), "tid")
    dealt = named.join(lists, ["tid", "doc"]).select("doc", "tid", "hs", "text")
    occurrences = stored(dealt.mapInArrow(segments, "h long, seg long, doc long, tid long, at long, n int, body binary"), "occurrences")
    discard(shared)
    release(spark)
    distinct = stored(occurrences.groupBy("h", "seg").agg(F.min("doc").alias("doc"), F.max("body").alias("body")), "segments")

    # 3. and 4. the smallest id of each window of each segment
    best = stored(smallest(distinct), "matches")
    alone = distinct.select("h", "seg", F.col("doc").alias("first_doc"))
    found = stored(occurrences.select("h", "seg", "doc", "tid", "at", "n").join(alone, ["h", "seg"]).join(best, ["h", "seg"], "left").where("best is not null or first_doc < doc").drop("h", "seg"), "found")
    discard(occurrences, distinct, best)
    release(spark)
    whole = found.where("best is null").select("tid", "doc", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + LENGTH).alias("end"))
    spans = whole.unionByName(found.where("best is not null").select("tid", "doc", "at", "best").mapInArrow(runs, "tid long, doc long, start long, end long"))
    spans = stored(spans.groupBy("tid", "doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")).select("tid", "doc", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")), "spans")
    discard(found)
    release(spark)

    # what is left of each text
    touched = only(named, spans.select("doc").distinct(), "doc").join(spans, ["tid", "doc"])
    results = touched.select("tid", "doc", "text", "starts", "ends").mapInArrow(kept, "tid long, doc long, n_removed long, n_spans long, kept string").dropDuplicates(["tid", "doc"])
    nothing = hashlib.sha256(b"").hexdigest()
    copy = F.col("first_doc").isNotNull() & (F.col("first_doc") < F.col("doc"))
    return (
        rows.join(firsts.withColumnRenamed("doc", "first_doc"), ["tid", "sha"], "left")
        .join(results.withColumnRenamed("doc", "first_doc"), ["tid", "first_doc"], "left")
        .select(
            F.col("key").alias(key),
            F.col("n").alias("n_bytes"),
            F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )
    )
