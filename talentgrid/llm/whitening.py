"""Embedding whitening without a covariance matrix: a QR in every partition, R factors merged in a tree, one small SVD.

Entries become integers, x = floor(64 * c) + 1000000, so their sums are exact whatever order the rows come in. Rows
are centred with these sums and reduced to one R factor a partition; R factors are merged a few at a time, and the
right singular vectors of the last one whiten. Only sums and R factors, whose size is set by the dimension of the
vectors, reach the driver.

Defined results:

- Vectors that are null or empty, hold null or non-finite entries, or entries whose x is no 64-bit number are dropped.
  So are vectors of another length than most have (ties: the longer one); all others are the fit list.
- Repeated rows and repeated or null keys count and come out as often as they stand in the table.
- Directions without variance (a singular value of zero, to rounding) are no components: one row alone, or rows that
  are all equal, give no result rows. Equal eigenvalues give any basis of their space, the same one for all rows.
- ``deviation`` is null where the exact number passes 64 bits; ``deviation_exact`` holds it up to 38 digits.
- An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: R factors that one step of the tree merges.
FAN = 8
#: Rows that are stacked under an R factor before the next QR (twice the dimension at least).
STACK = 4096
PART = "part int, n long, body binary"


def entries(vectors: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x as a matrix) of the usable vectors of a batch, by length; only those of ``size`` where it is given."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for length in [size] if size else np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        if not len(rows):
            continue
        scaled = values[starts[rows][:, None] + np.arange(length)] * SCALE
        fine = (np.isfinite(scaled) & (np.abs(scaled) < 2.0**62)).all(1)
        yield length, rows[fine], np.floor(scaled[fine]).astype(np.int64) + SHIFT


# ---------------------------------------------------------------- exact sums
LOW_BITS = 20


def sums(vectors: DataFrame, column: str) -> tuple[int, list[int]]:
    """(rows of the fit list, exact sums of x in every dimension); no sums where there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for length, rows, x in entries(batch.column(0)):
                total = found.setdefault(length, [0, np.zeros(length, np.int64), np.zeros(length, np.int64)])
                total[0] += len(rows)
                total[1] += (x >> LOW_BITS).sum(0)
                total[2] += (x & ((1 << LOW_BITS) - 1)).sum(0)
        for length, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pydict(
                {"size": pa.array(np.full(length, length, np.int32)), "place": pa.array(np.arange(length, dtype=np.int32)), "high": high, "low": low, "n": np.full(length, n)}
            )

    parts = vectors.select(column).mapInArrow(run, "size int, place int, high long, low long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    total = parts.groupBy("size", "place").agg(wide("high"), wide("low"), F.sum("n").alias("n"))
    # as many rows as dimensions for each length; the commonest length is chosen before anything is collected
    best = total.where("place = 0 and n > 0").orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return 0, []
    rows = total.where(F.col("size") == best["size"]).orderBy("place").collect()
    return best["n"], [(int(r["high"]) << LOW_BITS) + int(r["low"]) for r in rows]


class Centre:
    """The mean of the fit list as whole numbers and remainders: S = n * whole + rest."""

    def __init__(self, n: int, totals: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in totals], np.int64)
        self.rest = np.array([s % n for s in totals], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision; the difference of whole numbers comes first and loses nothing."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n * x - S) ** 2 for each row.

        With y = x - whole it is n^2 * sum(y^2) - 2n * sum(y * rest) + sum(rest^2): two sums in 64 bits
        where they fit, else in numbers of any size, and three products a row."""
        y = x - self.whole
        most = int(np.abs(y).max(initial=0)) + 1
        if most * max(most, self.n) * len(self.whole) >= 2**63:
            y = y.astype(object)
        rest = self.rest if y.dtype != object else self.rest.astype(object)
        squares, mixed = (y * y).sum(1).tolist(), (y * rest).sum(1).tolist()
        own = sum(int(r) ** 2 for r in self.rest)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + own for a, b in zip(squares, mixed)]


# ---------------------------------------------------------------- a tree of small matrices
def merged(parts: DataFrame, join: Callable[[list[tuple[int, np.ndarray]]], tuple[int, np.ndarray]], name: str) -> tuple[int, np.ndarray] | None:
    """One (rows, matrix) from those of all partitions, ``FAN`` at a time; null where there are none."""
    parts = stored(parts, name)
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def step(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        n, body = join([(r["n"], np.frombuffer(r["body"])) for r in table.select(["n", "body"]).to_pylist()])
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN], pa.int32()), "n": [n], "body": pa.array([body.tobytes()], pa.binary())})

    while last:
        parts, last = parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(step, PART), last // FAN
    row = parts.first()
    return row["n"], np.frombuffer(row["body"])


def join_factors(found: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    size = int(np.sqrt(len(found[0][1])))
    return sum(n for n, _ in found), np.linalg.qr(np.vstack([r.reshape(-1, size) for _, r in found]), mode="r").ravel()


def join_spreads(found: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Counts, means and centred products of several parts as one, by the rule for pairs of parts."""
    n, body = found[0]
    size = int((np.sqrt(1 + 4 * len(body)) - 1) / 2)
    mean, products = body[:size].copy(), body[size:].reshape(size, size).copy()
    for m, other in found[1:]:
        apart = other[:size] - mean
        products += other[size:].reshape(size, size) + np.outer(apart, apart) * (n * m / (n + m))
        mean += apart * (m / (n + m))
        n += m
    return n, np.concatenate([mean, products.ravel()])


def _part(n: int, body: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": [n], "body": pa.array([body.tobytes()], pa.binary())})


# ---------------------------------------------------------------- the model
class Whitening:
    """Fitted centre and components; ``vectors`` are rows, ``explained`` is each one's share of the variance."""

    def __init__(self, centre: Centre, factor: np.ndarray, most: int):
        size = len(centre.whole)
        _, singular, right = np.linalg.svd(factor.reshape(-1, size))
        usable = singular > singular[0] * np.finfo(float).eps * size
        self.centre, self.size = centre, size
        k = min(most, int(usable.sum()))
        self.vectors = right[:k] * np.where(right[np.arange(k), np.abs(right[:k]).argmax(1)] < 0, -1.0, 1.0)[:, None]
        self.scale = singular[:k] / np.sqrt(centre.n)
        self.explained = singular[:k] ** 2 / (singular**2).sum()

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors.T / self.scale


def fit(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """Centre and components of all usable vectors; null where no direction has any variance."""
    n, totals = sums(vectors, column)
    if not n:
        return None
    centre = Centre(n, totals)
    size = len(totals)
    stack = max(STACK, 2 * size)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, seen = [np.zeros((0, size))], 0, 0
        for batch in batches:
            for _, _, x in entries(batch.column(0), size):
                waiting.append(centre.centred(x))
                rows, seen = rows + len(x), seen + len(x)
                if rows >= stack:
                    waiting, rows = [np.linalg.qr(np.vstack(waiting), mode="r")], 0
        if seen:
            yield _part(seen, np.linalg.qr(np.vstack([*waiting, np.zeros((size, size))]), mode="r"))

    _, factor = merged(vectors.select(column).mapInArrow(reduced, PART), join_factors, "factors")
    return Whitening(centre, factor, most) if factor.any() else None


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured on all rows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[int, np.ndarray] | None = None
        for batch in batches:
            for _, _, x in entries(batch.column(0), model.size):
                if len(x):
                    w = model.of(x)
                    mean = w.mean(0)
                    own = (len(w), np.concatenate([mean, ((w - mean).T @ (w - mean)).ravel()]))
                    found = join_spreads([found, own]) if found else own
        if found:
            yield _part(*found)

    n, body = merged(vectors.select(column).mapInArrow(spread, PART), join_spreads, "spreads")
    k = len(model.vectors)
    return float(np.abs(body[k:].reshape(k, k) / n - np.eye(k)).max())


def whitened(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_exact): a row for each usable vector and component."""
    schema = f"`{key}` {dict(vectors.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    model = fit(vectors, column, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(vectors, model, column), len(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, x in entries(batch.column(1), model.size):
                each = np.repeat(np.arange(len(rows)), k)
                exact = model.centre.deviations(x)
                deviation = pa.array([d if d < 2**63 else None for d in exact], pa.int64())
                wide = pa.array([Decimal(d) if d < 10**38 else None for d in exact], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_pydict(
                    {
                        key: batch.column(0).take(pa.array(rows[each])),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)),
                        "n": np.full(len(each), model.centre.n),
                        "deviation": deviation.take(pa.array(each)),
                        "whitened": model.of(x).ravel(),
                        "explained": np.tile(model.explained, len(rows)),
                        "identity_error": np.full(len(each), error),
                        "deviation_exact": wide.take(pa.array(each)),
                    }
                )

    return vectors.select(F.col(key).alias("_key"), F.col(column).alias("_vector")).mapInArrow(run, schema)
