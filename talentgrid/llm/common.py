"""What the operators of this subpackage share: scratch tables, slices of batches, word hashes.

Every function that runs inside a task works on one Arrow batch at a time, cut into slices of a few
megabytes, so a worker's memory does not depend on the size of a partition or of the table.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Rows of 8-byte ids that may be broadcast (16 MB); above it the same join runs as a shuffle join.
BROADCAST_ROWS = 2_000_000
#: Rows of an Arrow batch that goes to a Python worker; texts and sets are long.
BATCH_ROWS = 1000


# ---------------------------------------------------------------- scratch tables
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Where it is unset, Spark on one machine gets a temporary folder;
    a cluster can't share one, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="talentgrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote and that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, which nothing refers to any more."""
    for _ in range(2):  # what the first round frees on this side, the second frees in the cluster
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
    trim()


def trim() -> None:
    """Give memory that this process has freed back to the system, where its C library can: a fit leaves much of it behind."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        give_back(0)


def lean(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to ``BATCH_ROWS`` for this session, so that neither side of a worker's pipe holds many texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is among ids; ids are broadcast only after their number has been checked."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


# ---------------------------------------------------------------- batches
def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of the column ``text``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        upto = (ends[start - 1] if start else 0) + most
        stop = max(start + 1, int(np.searchsorted(ends, upto, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def offsets_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls; offsets start at 0."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space: (flat array, offsets of each text). Null counts as empty."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy().astype(np.int64))
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)[full]
        counts = np.bincount(owner, minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(full))
    return flat, np.concatenate([[0], np.cumsum(counts)])


# ---------------------------------------------------------------- hashes
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
#: Odd multipliers for the places of a window of words.
WORD_PLACE = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def places(n: int) -> np.ndarray:
    """The first n multipliers for the places of bytes in a word (the same whatever was asked before)."""
    global _PLACE
    if n > len(_PLACE):
        more = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, 1 << int(n).bit_length(), dtype=np.uint64) | np.uint64(1)
        more[:4096] = _PLACE[:4096]
        _PLACE = more
    return _PLACE[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(arr: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    if not len(arr):
        return np.zeros(0, np.uint64)
    raw, off = offsets_of(arr)
    size = np.diff(off)
    out = np.zeros(len(size), np.uint64)
    if len(raw):
        at = np.arange(len(raw)) - np.repeat(off[:-1], size)
        part = _BYTE[raw] * places(int(size.max()))[at]
        full = size > 0
        out[full] = np.add.reduceat(part, off[:-1][full])
    return mixed(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of every text, offsets of each text); A-Z are lower-cased."""
    flat, off = words_of(texts)
    if not len(flat):
        return np.zeros(0, np.uint64), off
    coded = flat.dictionary_encode()
    return hashes(coded.dictionary)[coded.indices.to_numpy()], off


def shingle_sets(texts: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """The set of each text as a sorted array: hashes of its runs of ``words`` words, of the whole
    sequence where there are fewer, nothing without words."""
    h, off = word_hashes(texts)
    runs = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        runs += h[j : j + len(runs)] * WORD_PLACE[j]
    runs = mixed(runs)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= words:
            yield np.unique(runs[a : b - words + 1])
        elif b > a:
            yield mixed((h[a:b] * WORD_PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + WORD_PLACE[40 + b - a])
        else:
            yield np.zeros(0, np.uint64)


def long_of(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
