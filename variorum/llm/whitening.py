"""Embedding whitening: a compensated covariance, its eigenvectors, and the vectors' components in their units.

Vectors become integers (rounded down after scaling, and shifted). Over the distinct ones: exact sums by component; then
centred outer products, accumulated in double-double: a difference from the mean is a pair of floats; it is split without
error into slices of few bits, so that products of slices add up exactly over a block of rows; blocks are added to a high
and a low part by two-sum, tasks' parts likewise, in two steps (shares of the tasks, then the shares). So the covariance is
right to more than a float's digits whatever the mean. It is solved by reduction to tridiagonal form and divide and
conquer (LAPACK's symmetric solver), then mended once or twice by residuals that are taken exactly, in integers; so small
eigenvalues beside great ones are right too.

Distinct vectors are found by one shuffle of their bytes (as few a component as the vector needs), pre-aggregated by task,
so copies don't pile up. Every other pass is narrow. To the driver come sums, one covariance and one row more.

Cases. Vectors that are null, empty or hold null or non-finite entries are left out, and so are vectors of another size
than most have (ties: the smaller size), as they lie in another space. Repeated rows each get their rows of the result.
Directions without variance (eigenvalues not above the dimensions times 2^-52 times the largest) have no unit and no rows:
one distinct vector gives none. Entries are clipped to +-2^40 after scaling. `deviation` is null where it doesn't fit a
long. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.llm import bytesops as B
from variorum.llm import storage

#: What entries are multiplied by before they are rounded down, what is added then, and the largest magnitude before that.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 40
#: Rows of a block, and bits of a slice: 2 * BITS and the logarithm of ROWS stay below 53.
ROWS, BITS = 512, 21
#: Shares that tasks' covariances are merged in first.
SHARES = 64
_LIMB = 20
_MENDED = 60


def usable(v: Column) -> Column:
    """Whether a vector has entries, all finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))


def whole(v: Column, scale: int = SCALE) -> Column:
    """Entries as integers, before the shift."""
    return F.transform(v, lambda e: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(e * F.lit(float(scale))).cast("double"))).cast("long"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes: the fewest a component that hold all of the vector, so that equal vectors are equal bytes."""
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        out = []
        for v in (_matrix(lists, int(sizes[0])) if len(sizes) else []):
            kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= v.min() and v.max() <= np.iinfo(k).max)
            out.append(v.astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["packed"])


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The shifted vectors of packed ones."""
    out = np.empty((len(column), dim), np.int64)
    for i, raw in enumerate(column):
        b = raw.as_buffer()
        out[i] = np.frombuffer(b, f"<i{b.size // dim}")
    return out + SHIFT


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Sum:
    """A sum of arrays in double-double."""

    def __init__(self, shape: tuple[int, ...]) -> None:
        self.high, self.low = np.zeros(shape), np.zeros(shape)

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, error = two_sum(self.high, high)
        self.high, self.low = two_sum(s, error + (self.low + low))


def slices(d: np.ndarray, grid: float) -> tuple[np.ndarray, np.ndarray]:
    """d as a multiple of the grid and the rest, without error."""
    top = np.round(d / grid) * grid
    return top, d - top


def outer(total: Sum, high: np.ndarray, low: np.ndarray) -> None:
    """Adds the outer products of the rows high + low."""
    most = np.abs(high).max(initial=0)
    if most == 0:
        return
    # The grid is a power of two, so dividing and multiplying by it are exact.
    grid = 2.0 ** (int(np.ceil(np.log2(most))) + 1 - BITS)
    a, rest = slices(high, grid)
    b, c = slices(rest, grid * 2.0 ** (1 - BITS))
    c = c + low
    total.add(a.T @ a)
    cross = a.T @ b
    total.add(cross)
    total.add(cross.T)
    total.add(b.T @ b)
    # What is left is below 2^-40 of the entries: a float's digits of it are more than enough.
    cross = (a + b).T @ c
    total.add(cross + cross.T)


@dataclass
class Space:
    """The fitted space: n distinct vectors, their sums, unit eigenvectors as columns and eigenvalues, and the trace."""

    n: int
    sums: list[int]
    mean: np.ndarray
    mean_low: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Components of shifted integer vectors, in units of their deviations."""
        return ((x - self.mean) - self.mean_low) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum of (n * x - S)^2 of each vector, exactly, or null where it doesn't fit a long."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(abs(s) for s in self.sums)
        if most < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(d).max(initial=0)) ** 2 * self.dim < 1 << 63:
                return pa.array((d * d).sum(axis=1))
        exact = [sum((self.n * e - s) ** 2 for e, s in zip(v, self.sums, strict=True)) for v in x.tolist()]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of distinct vectors and their sums, exactly: in limbs, as a long might not hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, limbs = 0, np.zeros((3, dim), np.int64)
        for batch in batches:
            x = _unpacked(batch.column("packed"), dim)
            n += len(x)
            for k in range(3):
                limbs[k] += ((x >> (_LIMB * k)) if k == 2 else (x >> (_LIMB * k)) & ((1 << _LIMB) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), *(pa.array(v) for v in limbs)], names=["i", "n", "a", "b", "c"])

    rows = fit.mapInArrow(B.task(run), "i int, n long, a long, b long, c long").groupBy("i").agg(*(F.sum(c).alias(c) for c in "nabc")).collect()
    sums = [0] * dim
    for r in rows:
        sums[r["i"]] = r["a"] + (r["b"] << _LIMB) + (r["c"] << 2 * _LIMB)
    return (rows[0]["n"] if rows else 0), sums


_PARTS = "share int, high binary, low binary"


def _merge(dim: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sum((dim, dim))
        for batch in batches:
            for high, low in zip(batch.column("high"), batch.column("low"), strict=True):
                total.add(*(np.frombuffer(b.as_buffer(), np.float64).reshape(dim, dim) for b in (high, low)))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.high.tobytes()], pa.binary()), pa.array([total.low.tobytes()], pa.binary())], names=["share", "high", "low"])

    return B.task(run)


def _covariance(fit: DataFrame, dim: int, mean: np.ndarray, mean_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of centred outer products, as a high and a low part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sum((dim, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _unpacked(batch.column("packed").slice(at, ROWS), dim).astype(np.float64)
                high, error = two_sum(x, -mean)
                high, low = two_sum(high, error - mean_low)
                outer(total, high, low)
        share = TaskContext.get().partitionId() % SHARES
        yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([total.high.tobytes()], pa.binary()), pa.array([total.low.tobytes()], pa.binary())], names=["share", "high", "low"])

    parts = fit.mapInArrow(B.task(run), _PARTS)
    shared = parts.repartition("share").mapInArrow(_merge(dim), _PARTS)
    row = shared.repartition(1).mapInArrow(_merge(dim), _PARTS).head()
    return tuple(np.frombuffer(row[c], np.float64).reshape(dim, dim) for c in ("high", "low"))


def _integers(a: np.ndarray, bits: int) -> np.ndarray:
    """a * 2^bits in Python integers, rounded."""
    out = np.empty(a.shape, object)
    for at, v in np.ndenumerate(a):
        m, e = np.frexp(v)
        shift = int(e) + bits - 53
        whole_part = int(m * (1 << 53))
        out[at] = whole_part << shift if shift >= 0 else whole_part >> -shift
    return out


def eigen(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of (high + low) / n; of all that have variance."""
    dim = len(high)
    high, low = (high + high.T) / 2, (low + low.T) / 2
    scale = float(np.abs(high).max(initial=0))
    if n == 0 or scale == 0:
        return np.zeros(0), np.zeros((dim, 0)), 0.0
    unit = 2.0 ** int(np.ceil(np.log2(scale)))
    values, vectors = np.linalg.eigh(high / unit)
    v = _integers(high / unit, 2 * _MENDED) + _integers(low / unit, 2 * _MENDED)
    for _ in range(2):
        # Ogita and Aishima's step, its residuals exact: R = I - X'X and S = X'VX.
        x = _integers(vectors, _MENDED)
        one = 1 << 2 * _MENDED
        gram = x.T.dot(x)
        r = np.array([[float((one if i == j else 0) - gram[i, j]) for j in range(dim)] for i in range(dim)]) / float(one)
        s = x.T.dot(v).dot(x)
        whole_s = np.array([[float(s[i, j]) for j in range(dim)] for i in range(dim)]) / float(1 << 4 * _MENDED)
        values = np.diag(whole_s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= 2 * (np.linalg.norm(whole_s - np.diag(values), 2) + np.abs(values).max() * np.linalg.norm(r, 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(close, r / 2, (whole_s + values[None, :] * r) / gap)
        vectors = vectors + vectors @ e
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    # Either sign will do: the largest entry is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)
    trace = sum((int(v[i, i]) for i in range(dim)), 0) / (1 << 2 * _MENDED)
    some = values > dim * 2.0**-52 * values[0]
    return values[some] * unit / n, vectors[:, some], trace * unit / n


def fit(vectors: DataFrame, components: int, embedding: str = "embedding", scale: int = SCALE) -> tuple[Space | None, DataFrame]:
    """The space of the distinct vectors (None if there is none), and those."""
    rows = vectors.select(F.col(embedding).cast("array<double>").alias("_v")).where(usable(F.col("_v")))
    usual = rows.groupBy(F.size("_v").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    if usual is None:
        return None, rows
    dim = usual["dim"]
    packed = rows.where(F.size("_v") == dim).select(whole(F.col("_v"), scale).alias("x")).mapInArrow(B.task(_packed), "packed binary")
    distinct = storage.kept(packed.distinct(), "whitening-fit")
    n, sums = _sums(distinct, dim)
    mean = np.array([s / n for s in sums])
    # The mean's second part: what its float leaves of S / n, in fractions of integers.
    mean_low = np.array([(s * d - m * n) / (n * d) for s, (m, d) in zip(sums, (float(v).as_integer_ratio() for v in mean), strict=True)])
    values, columns, trace = eigen(*_covariance(distinct, dim, mean, mean_low), n)
    return Space(n, sums, mean, mean_low, columns[:, :components], values[:components], trace), distinct


def identity_error(space: Space, distinct: DataFrame) -> float:
    """The largest absolute entry of the whitened distinct vectors' covariance minus the identity."""
    k = len(space.values)
    if k == 0:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = space.whitened(_unpacked(batch.column("packed"), space.dim))
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += w.T @ w
        at = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "s"])

    got = np.zeros((k + 1, k + 1))
    for r in distinct.mapInArrow(B.task(run), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r["i"], r["j"]] = r["s"] / space.n
    mean = got[:k, k]
    return float(np.abs(got[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, a row for each vector and component."""
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    space, distinct = fit(vectors, components, embedding, scale)
    if space is None or not len(space.values):
        return vectors.sparkSession.createDataFrame([], columns)
    error, k = identity_error(space, distinct), len(space.values)
    share = space.values / space.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 8 * ROWS):
                batch = whole_batch.slice(at, 8 * ROWS)
                x = _matrix(batch.column("x"), space.dim) + SHIFT
                n = len(x)
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, space.n)), space.deviation(x).take(each),
                    pa.array(space.whitened(x).ravel()), pa.array(np.tile(share, n)), pa.array(np.full(n * k, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("_v")).where(usable(F.col("_v")) & (F.size("_v") == space.dim))
    return rows.select("vec_id", whole(F.col("_v"), scale).alias("x")).mapInArrow(B.task(run), columns)
