"""Nearest neighbours by inner product: stable random projections in kd-trees, searched until a chi-square test stops.

Inner products become distances by one more coordinate: x gets sqrt(M^2 - |x|^2) (M the largest norm) and a query 0, so
|q - x|^2 = |q|^2 + M^2 - 2 q.x and the nearest is the one of largest inner product. Vectors are projected to `DIMS`
dimensions by a Gaussian matrix (2-stable: a squared projected distance over the squared distance is chi-square
distributed). A query takes candidates by increasing projected distance from kd-trees and verifies them on the original
vectors; it stops when the next projected distance is so large that, with probability `CERTAINTY`, nothing nearer than
its present k-th neighbour lies beyond: delta^2 > d_k^2 * chi2^-1(CERTAINTY; DIMS). The test holds for cells, for the leaves
of a cell's tree, and for each point of a leaf: of one beyond it, no exact product is taken.

Distribution: a kd-tree cuts space into cells. It grows from one cell: a cell of more than twice `CELL` vectors is split by
medians of a bounded sample of its projections (`SAMPLE` rows), until none is left, so cells stay small however large the
table is; every vector is indexed in its cell, whose own kd-tree is built where it is searched. What the driver holds is the
tree: a few numbers for every `CELL` / 2 vectors. Queries visit cells in rounds: first their own, then by increasing
projected distance 4 more, 16 more and so on, always with the distance of the k-th neighbour found so far, until the test
stops them. A cell that many queries visit is searched by `VISITS` at a time, in several tasks. Per query and cell a bounded
list comes back, and lists are merged by a window with a limit per group.

Equal vectors are one point that keeps its k + 1 smallest ids: ties go to smaller ids, so no others can be among the k
nearest of anything. Equal queries are searched once. Vectors that are null, zero, not of the table's usual length, or
hold null or non-finite components take no part, neither as queries nor as candidates; equal (id, vector) rows count
once, and rows with a null id don't count. An id that comes with several vectors is one query and one candidate, by the best
of its vectors, and never its own neighbour (with many such ids, fewer than k may be found). Columns but the two named take
no part, whatever their names, unless is_query reads them. An empty table gives an empty result. Floats are held as floats,
wider numbers as doubles; doubles over `LARGEST` in size, whose squares have no sum, count as non-finite. Unlike points that
are projected to one place stay in one cell, which is searched in parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.llm import bytesops as B
from variorum.llm import storage

DIMS = 12
CERTAINTY = 0.95
CELL = 8192
LEAF = 64
#: Projected rows of a cell from which its planes are taken; the index itself holds every row.
SAMPLE = 40_000
#: Candidates of which exact scores are taken, beyond the k + 1 wanted.
SPARE = 12
#: Queries that a task holds against a cell.
VISITS = 20_000
#: Cells that a query visits in the second round; each further round visits STEP times as many.
STEP = 4
#: Rows (of a cell and a number) that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def chi2_quantile(p: float, dims: int) -> float:
    """Inverse of the chi-square distribution function, for even dims."""
    below = lambda x: 1 - math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 10.0 * dims + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _projection(dim: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, DIMS))


class Tree:
    """A kd-tree whose leaves are cells: inner node i splits axis[i] at cut[i]; children are nodes, or -1 - cell."""

    def __init__(self) -> None:
        self.axis, self.cut = np.zeros(0, np.int64), np.zeros(0)
        self.child = np.zeros((0, 2), np.int64)
        self.root, self.cells = -1, 1

    def graft(self, cell: int, axis: np.ndarray, cut: np.ndarray, child: np.ndarray) -> None:
        """Puts a subtree (its first node is its root, its cells are counted from 0) in the place of a cell."""
        if not len(axis):
            return
        at, fresh = len(self.axis), self.cells - 1
        # The subtree's cell 0 keeps the number, the others get new ones.
        leaf = np.where(child == -1, -1 - cell, child - fresh)
        place = np.where(child >= 0, child + at, leaf)
        self.child[self.child == -1 - cell] = at
        if self.root == -1 - cell:
            self.root = at
        self.axis, self.cut = np.concatenate([self.axis, axis]), np.concatenate([self.cut, cut])
        self.child = np.concatenate([self.child, place])
        self.cells += len(axis)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root, np.int64)
        while len(at := np.flatnonzero(node >= 0)):
            inner = node[at]
            right = points[at, self.axis[inner]] > self.cut[inner]
            node[at] = self.child[inner, right.astype(np.int64)]
        return -1 - node

    def reach(self, points: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, squared distance) of all cells that the points' balls touch."""
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        todo = [(self.root, np.arange(len(points)), np.zeros((len(points), DIMS)), np.zeros(len(points)))]
        while todo:
            node, rows, offset, gap = todo.pop()
            if node < 0:
                out.append((rows, np.full(len(rows), -1 - node), gap))
                continue
            a, side = self.axis[node], points[rows, self.axis[node]] - self.cut[node]
            for right in (0, 1):
                away = (side > 0) != bool(right)  # on the other side of the plane
                further = np.where(away, np.maximum(np.abs(side), offset[:, a]), offset[:, a])
                total = gap - offset[:, a] ** 2 + further**2
                near = total <= radius2[rows]
                if near.any():
                    moved = offset[near]
                    moved[:, a] = further[near]
                    todo.append((int(self.child[node, right]), rows[near], moved, total[near]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def planes(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """axis, cut and children of a tree over a sample, of about `cells` cells; none where nothing can be split."""
    axis, cut, child, leaves = [], [], [], 0
    todo = [(sample, cells, None)]
    while todo:
        points, wanted, parent = todo.pop()
        width = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(DIMS)
        if wanted > 1 and len(points) >= 8 and width.max() > 0:
            a = int(np.argmax(width))
            at = float(np.median(points[:, a]))
            if at >= points[:, a].max():  # more than half are largest: they go right
                at = float(points[points[:, a] < at, a].max())
            here = len(axis)
            axis.append(a)
            cut.append(at)
            child.append([0, 0])
            left = points[:, a] <= at
            share = max(1, min(wanted - 1, round(wanted * left.mean())))
            todo += [(points[~left], wanted - share, (here, 1)), (points[left], share, (here, 0))]
        else:
            here, leaves = -1 - leaves, leaves + 1
        if parent is not None:
            child[parent[0]][parent[1]] = here
    return np.array(axis, np.int64), np.array(cut, np.float64), np.array(child, np.int64).reshape(-1, 2)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of a kd-tree's leaves."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argsort(own[:, axis], kind="stable")
        half = len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def search_cell(queries: np.ndarray, projected_queries: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, projected: np.ndarray, first_ids: np.ndarray, wanted: int, largest: float) -> tuple[list[np.ndarray], int]:
    """For each query, the rows of its `wanted` best vectors here that beat its bound (a squared distance), best first; and
    how many pairs of a query and a vector were verified for it.
    """
    leaves = _leaves(projected)
    own2, verified = (projected * projected).sum(axis=1), 0
    low, high = (np.stack([f(projected[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    quantile = chi2_quantile(CERTAINTY, DIMS)
    out: list[np.ndarray] = []
    take = wanted + SPARE
    for at in range(0, len(queries), 256):
        q, pq = queries[at : at + 256].astype(vectors.dtype), projected_queries[at : at + 256]
        norms = (queries[at : at + 256].astype(np.float64) ** 2).sum(axis=1)
        limit = bounds[at : at + 256].copy()
        gap = np.maximum(low[None] - pq[:, None], 0) + np.maximum(pq[:, None] - high[None], 0)
        near = (gap * gap).sum(axis=2)
        order = np.argsort(near, axis=1, kind="stable")
        best = np.full((len(q), take), -np.inf, vectors.dtype)
        who = np.full((len(q), take), -1, np.int64)
        done, step = 0, 1
        active = np.arange(len(q))
        while done < len(leaves) and len(active):
            active = active[near[active, order[active, done]] <= limit[active] * quantile]
            block = order[active, done : done + step]
            scores = np.full((len(active), block.shape[1] * LEAF), -np.inf, vectors.dtype)
            rows = np.full(scores.shape, -1, np.int64)
            radius2 = limit[active] * quantile
            for leaf in np.unique(block):
                which, slot = np.nonzero(block == leaf)
                members = leaves[leaf]
                # Points of the leaf that the test lets through, each by its own projected distance.
                p = pq[active[which]]
                apart = (p * p).sum(axis=1)[:, None] + own2[members] - 2 * (p @ projected[members].T)
                due = apart <= radius2[which][:, None] * (1 + 1e-9)
                by, at_member = np.nonzero(due)
                if not len(by):
                    continue
                verified += len(by)
                if 4 * len(by) > due.size:
                    got = (q[active[which]] @ vectors[members].T)[by, at_member]
                else:
                    got = np.einsum("ij,ij->i", q[active[which[by]]], vectors[members[at_member]])
                scores[which[by], slot[by] * LEAF + at_member] = got
                rows[which[by], slot[by] * LEAF + at_member] = members[at_member]
            scores = np.concatenate([best[active], scores], axis=1)
            rows = np.concatenate([who[active], rows], axis=1)
            top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
            best[active], who[active] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(rows, top, axis=1)
            kth = -np.partition(-best[active], wanted - 1, axis=1)[:, wanted - 1].astype(np.float64)
            limit[active] = np.minimum(limit[active], norms[active] + largest - 2 * kth)
            done += step
            step *= 2
        for k in range(len(q)):
            rows_k = who[k][who[k] >= 0]
            exact = (vectors[rows_k].astype(np.float64) * queries[at + k].astype(np.float64)).sum(axis=1)
            keep = np.lexsort((first_ids[rows_k], -exact))[:wanted]
            out.append(rows_k[keep])
    return out, verified


#: Components up to here have squares that can be added up.
LARGEST = 1e150


def _usable(embedding: Column, dim: int) -> Column:
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return embedding.isNotNull() & (F.size(embedding) == dim) & whole & F.exists(embedding, lambda x: x != 0)


def _as_list(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _near(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _located(df: DataFrame, tree: Tree) -> DataFrame:
    """df with the cell of each row's projection."""
    shipped = df.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shipped.value.cell(_matrix(batch.column("projected"), DIMS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return df.mapInArrow(B.task(run), ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "cell int"]))


def grown(points: DataFrame, n: int, cell: int, sample: int) -> Tree:
    """A tree over all n points (a written table with their projections), no cell of which has over twice `cell` of them."""
    tree, over, stuck = Tree(), {0: n}, set()

    def split(table: pa.Table) -> pa.Table:
        wanted = math.ceil(table["n"][0].as_py() / cell)
        x = _matrix(table["projected"], DIMS)
        axis, cut, child = planes(x, min(wanted, max(len(x) // 8, 2)))
        return pa.table({"cell": table["cell"][:1].cast(pa.int32()), "axis": [axis.tolist()], "cut": [cut.tolist()], "child": [child.ravel().tolist()]}).cast(pa.schema([("cell", pa.int32()), ("axis", pa.list_(pa.int64())), ("cut", pa.list_(pa.float64())), ("child", pa.list_(pa.int64()))]))

    over = {c: k for c, k in over.items() if k > 2 * cell}
    while over:
        full = storage.kept(points.sparkSession.createDataFrame(list(over.items()), "cell int, n long"), "ann-full")
        rows = _located(points.select("projected"), tree).join(_near(full), "cell")
        some = rows.where(F.pmod(F.xxhash64("projected"), F.floor(F.col("n") / sample) + 1) == 0)
        before = tree.cells
        for r in some.groupBy("cell").applyInArrow(split, "cell int, axis array<long>, cut array<double>, child array<long>").toLocalIterator():
            if r["axis"]:
                tree.graft(r["cell"], np.array(r["axis"], np.int64), np.array(r["cut"]), np.array(r["child"], np.int64).reshape(-1, 2))
        if tree.cells == before:
            break
        counts = _located(points.select("projected"), tree).groupBy("cell").count().toLocalIterator()
        now = {r["cell"]: r["count"] for r in counts if r["count"] > 2 * cell}
        # Of points that are projected to one place, none can be split off.
        stuck |= {c for c, k in now.items() if over.get(c) == k}
        over = {c: k for c, k in now.items() if c not in stuck}
    return tree


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", embedding: str = "embedding", cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of every query (a row for which is_query holds)."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    # Floats stay floats; anything wider is held as doubles.
    kind = "float" if vectors.select(embedding).schema[0].dataType.elementType.simpleString() in ("float", "tinyint", "smallint") else "double"
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    usual = rows.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual["dim"]
    rows = rows.where(_usable(F.col("embedding"), dim))

    # Points: distinct vectors with their k + 1 smallest ids.
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.select("embedding", "vec_id").distinct().withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    points = storage.kept(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-points")
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = points.agg(F.count("*").alias("n"), F.max(norm2).alias("largest")).head()
    if not sizes["n"]:
        return spark.createDataFrame([], schema)
    largest, matrix = float(sizes["largest"]), _projection(dim)

    def project(query: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("embedding"), dim).astype(np.float64)
                lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
                yield pa.RecordBatch.from_arrays([*batch.columns, _as_list(x @ matrix[:-1] + lift[:, None] * matrix[-1], pa.float64())], names=[*batch.schema.names, "projected"])

        return B.task(run)

    placed = storage.kept(points.mapInArrow(project(False), f"embedding array<{kind}>, ids array<long>, projected array<double>"), "ann-projected")
    tree = grown(placed, sizes["n"], cell, sample)
    index = storage.kept(_located(placed, tree), "ann-index")
    shipped = spark.sparkContext.broadcast(tree)

    # Queries: distinct vectors, numbered as they are written.
    asked = rows.where("is_query").select("vec_id", "embedding")
    distinct = storage.kept(asked.select("embedding").distinct().withColumn("asker", F.monotonically_increasing_id()), "ann-askers")
    queries = storage.kept(distinct.mapInArrow(project(True), f"embedding array<{kind}>, asker long, projected array<double>"), "ann-queries")

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries that visit a cell; right: its points."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"asker": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "first_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = _matrix(left["embedding"], dim), _matrix(right["embedding"], dim)
        ids = right["ids"].combine_chunks()
        first = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        got, _ = search_cell(q, _matrix(left["projected"], DIMS), left["bound"].to_numpy(), x, _matrix(right["projected"], DIMS), first, k + 1, largest)
        picked = np.concatenate(got)
        of = np.repeat(np.arange(len(got)), [len(g) for g in got])
        score = (x[picked].astype(np.float64) * q[of].astype(np.float64)).sum(axis=1)
        return pa.table({"asker": pa.array(left["asker"].to_numpy()[of]), "ids": ids.take(pa.array(picked)), "first_id": pa.array(first[picked]), "score": pa.array(score)})

    def searched(visits: DataFrame) -> DataFrame:
        tasks = storage.kept(visits.groupBy("cell").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("n")), "ann-tasks")
        left = visits.join(_near(tasks), "cell").withColumn("part", F.pmod(F.xxhash64("asker"), "n").cast("int")).drop("n")
        right = index.join(_near(tasks), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(visit, "asker long, ids array<long>, first_id long, score double")

    best = Window.partitionBy("asker").orderBy(F.desc("score"), "first_id")
    quantile = chi2_quantile(CERTAINTY, DIMS)

    def due(done: int, step: int):  # noqa: ANN202
        """The visits of a round: the cells number done, ..., done + step - 1 by distance, if the test hasn't stopped before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p, bound = _matrix(batch.column("projected"), DIMS), batch.column("bound").to_numpy()
                if done:
                    row, cells, gap = shipped.value.reach(p, bound * quantile)
                    home = shipped.value.cell(p)
                    order = np.lexsort((cells, gap, cells != home[row], row))
                    row, cells = row[order], cells[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    now = (rank >= done) & (rank < done + step)
                    row, cells = row[now], cells[now]
                else:
                    row, cells = np.arange(len(p)), shipped.value.cell(p)
                again = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(cells.astype(np.int32))], names=[*batch.schema.names, "cell"])

        return B.task(run)

    columns = f"asker long, embedding array<{kind}>, projected array<double>, bound double, cell int"
    lists, bounded, done, step = None, queries.withColumn("bound", F.lit(float("inf"))), 0, 1
    while done < tree.cells:
        visits = storage.kept(bounded.select("asker", "embedding", "projected", "bound").mapInArrow(due(done, step), columns), "ann-visits")
        if done and visits.isEmpty():
            break
        found = searched(visits)
        merged = found if lists is None else lists.unionByName(found)
        lists = storage.kept(merged.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n"), "ann-lists")
        kth = lists.groupBy("asker").agg(F.count("*").alias("_n"), F.min("score").alias("kth")).where(F.col("_n") > k).drop("_n")
        bounded = queries.join(kth, "asker", "left").withColumn("bound", F.coalesce(norm2 + F.lit(largest) - 2 * F.col("kth"), F.lit(float("inf"))))
        done, step = done + step, step * STEP

    # Back to all queries of equal vectors, and from points to rows.
    who = asked.distinct().join(distinct, "embedding").select(F.col("vec_id").alias("query_id"), "asker")
    pairs = who.join(lists, "asker").select("query_id", "score", F.explode(F.slice(F.array_remove("ids", F.col("query_id")), 1, k)).alias("vec_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
