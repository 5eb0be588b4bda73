"""Centroid clustering: Lloyd's rounds over integer vectors, each assignment by exponion search.

Every vector carries an upper bound of the distance to its centroid and a lower bound of the distance to any other. While
the upper one is below the lower one, or below half of the gap around its centroid, it stays unseen. Else its distance is
taken anew, and if that doesn't settle it, it scans the centroids in a ball around its own one: those no farther from it
than twice its distance plus the gap to the nearest other centroid, a prefix of its list of centroids sorted by distance.
The radius is inclusive, so that every centroid at equal distance is scanned and ties go to the smaller number.

Squared distances are exact integers: products of floats below 2^53 where components allow, else 64-bit integers. Bounds
are floats, held apart by a relative slack, so that rounding never decides.

Rounds are narrow: a round reads the table of the round before (vector, centroid, bounds), writes its own and drops that
one. Only sums per centroid and component are shuffled, pre-aggregated by task; k times the dimensions come to the driver.

Cases. Vectors that are null, of another size or hold null or non-finite components are left out. Rows with a null vec_id
are clustered, but are no initial centroids while others are left. Repeated rows each count; repeated ids of the initial
ones are told apart by their vectors. Fewer than k vectors: as many centroids. No vectors: no rows. Scaled components are
clipped to +-2^27, as else no squared distance would fit a long. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.llm import bytesops as B
from variorum.llm import storage

#: What components are multiplied by before they are rounded down, and the largest magnitude that is kept.
SCALE, LIMIT = 256, 1 << 27
#: Relative slack between bounds.
SLACK = 1e-9
#: Magnitude up to which products of floats are exact whatever their order, for up to 512 dimensions.
_FLOATS = 1 << 21
_ROWS = 1 << 14

STATE = "vec_id long, x array<int>, cluster int, upper double, lower double, scanned int"


def usable(embedding: Column, dim: int) -> Column:
    """Whether a vector has dim components, all finite."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == dim) & finite, F.lit(False))


def scaled(vectors: DataFrame, dim: int, scale: int, key: str, embedding: str) -> DataFrame:
    """vec_id and x: usable vectors in integers."""
    wide = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("_v"))
    whole = F.transform("_v", lambda v: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(v * F.lit(float(scale))).cast("double"))).cast("int"))
    return wide.where(usable(F.col("_v"), dim)).select("vec_id", whole.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x (int64) to all of c, as int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most <= _FLOATS and x.shape[1] <= 512:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


@dataclass
class Centroids:
    """Centroids with, for each, all of them by distance from it; how far each has moved since the round before."""

    points: np.ndarray  # int64, k x dim
    moved: np.ndarray  # float64, k

    def __post_init__(self) -> None:
        gaps = np.sqrt(squared(self.points, self.points).astype(np.float64))
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        # A copy of a centroid is at distance 0, so the centroid itself needn't come first; the gap is the second entry all the same.
        self.nearest = self.gaps[:, 1] if len(gaps) > 1 else np.full(len(gaps), np.inf)

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) by scanning every centroid."""
        return _best(squared(x, self.points), np.arange(len(self.points)))

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower, scanned): the bounds of the round before are moved on, and what they leave open is scanned."""
        cluster, scanned = cluster.copy(), np.zeros(len(x), np.int64)
        upper = upper + self.moved[cluster]
        lower = lower - self.moved.max(initial=0)
        apart = np.maximum(lower, self.nearest[cluster] / 2) * (1 - SLACK)
        due = np.flatnonzero(~(upper * (1 + SLACK) < apart))
        if len(due):
            own = x[due] - self.points[cluster[due]]
            upper[due] = np.sqrt((own * own).sum(axis=1).astype(np.float64))
            scanned[due] += 1
            due = due[~(upper[due] * (1 + SLACK) < apart[due])]
        radius = (2 * upper[due] + self.nearest[cluster[due]]) * (1 + SLACK)
        for c in np.unique(cluster[due]):
            rows = due[cluster[due] == c]
            inside = np.searchsorted(self.gaps[c], radius[cluster[due] == c], side="right")
            # Rows are taken by the size of their ball, rounded up to a power of two: a larger ball does no harm.
            level = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64), len(self.points))
            for n in np.unique(level):
                some, ball = rows[level == n], self.order[c, :n]
                cluster[some], upper[some], lower[some] = _best(squared(x[some], self.points[ball]), ball)
                scanned[some] += n
        return cluster, upper, lower, scanned


def _best(d: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of the numbered centroids (ties: the smaller number), its distance and the next one's."""
    least = d.min(axis=1)
    cluster = np.where(d == least[:, None], numbers, np.iinfo(np.int64).max).min(axis=1)
    second = np.partition(d, 1, axis=1)[:, 1].astype(np.float64) if d.shape[1] > 1 else np.full(len(d), np.inf)
    return cluster, np.sqrt(least.astype(np.float64)), np.sqrt(second)


def _ints(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assigned(rows: DataFrame, centroids: Centroids, first: bool) -> DataFrame:
    """rows with the centroids' clusters and bounds."""
    dim = centroids.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                x = _ints(batch.column("x"), dim)
                if first:
                    cluster, upper, lower = centroids.all(x)
                    scanned = np.full(len(x), len(centroids.points))
                else:
                    cluster, upper, lower, scanned = centroids.again(x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned.astype(np.int32))], names=["vec_id", "x", "cluster", "upper", "lower", "scanned"])

    return rows.mapInArrow(B.task(run), STATE)


def _sums(state: DataFrame, k: int, dim: int) -> tuple[list[int], dict[int, list[int]]]:
    """How many vectors each cluster has, and the sums of their components, exactly: in two parts, as one might not fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, of = _ints(batch.column("x"), dim), batch.column("cluster").to_numpy()
            order = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.diff(of[order], prepend=-1))
            if len(starts):
                cs = of[order][starts]
                high[cs] += np.add.reduceat(x[order] >> 16, starts, axis=0)
                low[cs] += np.add.reduceat(x[order] & 0xFFFF, starts, axis=0)
            count += np.bincount(of, minlength=k)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, c, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(high[c]), pa.array(low[c]), pa.array(np.full(dim, count[c]))], names=["cluster", "i", "high", "low", "n"])

    told = state.select("x", "cluster").mapInArrow(B.task(run), "cluster int, i int, high long, low long, n long")
    counts, sums = [0] * k, {}
    for r in told.groupBy("cluster", "i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).toLocalIterator():
        counts[r["cluster"]] = r["n"]
        sums.setdefault(r["cluster"], [0] * dim)[r["i"]] = (r["high"] << 16) + r["low"]
    return counts, sums


def fitted(rows: DataFrame, first: np.ndarray, rounds: int) -> tuple[DataFrame, Centroids]:
    """The table (STATE) of the last assignment, and the centroids that it is to."""
    spark, dim = rows.sparkSession, first.shape[1]
    centroids = Centroids(first, np.zeros(len(first)))
    state, path = storage.put(_assigned(rows, centroids, True), "clusters")
    for _ in range(rounds):
        counts, sums = _sums(state, len(first), dim)
        new = centroids.points.copy()
        for c, total in sums.items():
            new[c] = [s // counts[c] for s in total]
        gone = new - centroids.points
        centroids = Centroids(new, np.sqrt((gone * gone).sum(axis=1).astype(np.float64)))
        before = path
        state, path = storage.put(_assigned(state, centroids, False), "clusters")
        storage.delete(spark, before)
    return state, centroids


def initial(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt, a colon and their id."""
    order = [F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("x").asc()]
    return np.array([r["x"] for r in rows.orderBy(*order).limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = SCALE, salt: str = "2", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and scanned of every usable vector.

    scanned: how many distances the last assignment took for it. k centroids are broadcast, with k * k distances.
    """
    spark = vectors.sparkSession
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned int"
    rows = scaled(vectors, dim, scale, key, embedding)
    first = initial(rows, k, salt)
    if not len(first):
        return spark.createDataFrame([], columns)
    state, centroids = fitted(rows, first, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _ints(batch.column("x"), dim) - centroids.points[batch.column("cluster").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array((own * own).sum(axis=1)), batch.column("scanned")], names=["vec_id", "cluster", "distance", "scanned"])

    placed = storage.kept(state.mapInArrow(B.task(run), "vec_id long, cluster int, distance long, scanned int"), "clustered")
    by_cluster = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    digest = [",".join(map(str, c)) for c in centroids.points.tolist()]
    total = sum(r["cluster_inertia"] for r in by_cluster)
    told = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, digest[r["cluster"]]) for r in by_cluster], "cluster int, cluster_inertia long, inertia long, digits string")
    told = told.select("cluster", "cluster_inertia", "inertia", F.sha2("digits", 256).alias("centroid_sha256"))
    # A row for each of k centroids.
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
