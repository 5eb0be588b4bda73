"""Nearest neighbours over many cells, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from variorum.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def test_tree():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, ann.DIMS))
    tree = ann.Tree()
    tree.graft(0, *ann.planes(x, 24))
    for cell in range(0, tree.cells, 5):
        tree.graft(cell, *ann.planes(x[tree.cell(x) == cell], 3))
    cell = tree.cell(x)
    assert tree.cells >= 24 and set(cell.tolist()) == set(range(tree.cells))
    radius2 = rng.uniform(0.5, 6, 50)
    row, reached, gap = tree.reach(x[:50], radius2)
    assert len({*zip(row.tolist(), reached.tolist(), strict=True)}) == len(row)
    for i in range(50):
        mine = set(reached[row == i].tolist())
        near = ((x - x[i]) ** 2).sum(axis=1) <= radius2[i]
        assert set(cell[near].tolist()) <= mine and cell[i] in mine
        for c, g in zip(reached[row == i].tolist(), gap[row == i].tolist(), strict=True):
            assert g <= ((x[cell == c] - x[i]) ** 2).sum(axis=1).min() + 1e-9
    equal = ann.planes(np.ones((100, ann.DIMS)), 8)
    assert len(equal[0]) == 0


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "VISITS", 40)
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 24))
    x = (centers[rng.integers(0, 40, 6000)] + 0.5 * rng.standard_normal((6000, 24))).astype(np.float32)
    x[2000:2600] = x[2000]
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(6000)], SCHEMA).withColumn("projected", F.lit("clash")).withColumn("cell", F.lit(1))
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0, 20, cell=128, sample=300).collect()
    exact = x.astype(np.float64)
    hits = total = 0
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 6000, 20):
        s = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(6000), -s)) if i != q][:20]
        assert len(by[q]) == 20 and q not in by[q]
        hits, total = hits + len(set(order) & set(by[q])), total + 20
    assert hits / total >= 0.95


def test_cells_are_bounded(spark):
    x = np.random.default_rng(2).standard_normal((5000, ann.DIMS))
    x[:400] = 3.0  # can't be split
    points = spark.createDataFrame([(r.tolist(),) for r in x], "projected array<double>")
    tree = ann.grown(points, 5000, 64, 200)
    counts = np.bincount(tree.cell(x), minlength=tree.cells)
    assert tree.cells >= 40 and sorted(counts)[-1] >= 400 and sorted(counts)[-2] <= 128


def test_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.8]), (2, [0.1, 0.8]), (3, [-1.0, -1.0])]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert abs(got[0].score - float(np.float32(0.9))) < 1e-9


def test_doubles_stay_doubles(spark):
    """Vectors that are one in floats: their order and scores are those of their doubles."""
    rng = np.random.default_rng(8)
    x = 1.0 + rng.standard_normal((400, 6)) * 1e-9
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1e300] + [0.0] * 5), (1001, [float("inf")] * 6)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 40 == 0, 5).collect()
    assert {r.query_id for r in got} == set(range(0, 400, 40)) and all(r.vec_id < 400 for r in got)
    hits = 0
    for q in range(0, 400, 40):
        scores = (x * x[q]).sum(axis=1)
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert all(abs(r.score - scores[r.vec_id]) < 1e-14 for r in mine)
        others = [i for i in sorted(range(400), key=lambda i: (-scores[i], i)) if i != q]
        hits += len({r.vec_id for r in mine} & set(others[:5]))
    assert hits >= 0.9 * 50


def _verified(x, k=20):
    """Share of all points that are verified, and recall, where every 20th vector is a query of one cell of all others."""
    dim, n = x.shape[1], len(x)
    largest = float((x * x).sum(axis=1).max())
    matrix = ann._projection(dim)
    lift = np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
    asked = np.arange(0, n, 20)
    got, verified = ann.search_cell(x[asked], x[asked] @ matrix[:-1], np.full(len(asked), np.inf), x, x @ matrix[:-1] + lift[:, None] * matrix[-1], np.arange(n), k + 1, largest)
    hits = sum(len(set(g.tolist()) & set(np.lexsort((np.arange(n), -(x @ x[i])))[: k + 1].tolist())) for i, g in zip(asked, got, strict=True))
    return verified / (len(asked) * n), hits / (len(asked) * (k + 1))


def test_points_beyond_the_test_are_not_verified():
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    clustered = unit(rng.standard_normal((200, 64))[rng.integers(0, 200, 12_000)] + 0.5 * rng.standard_normal((12_000, 64)))
    share, recall = _verified(clustered)
    assert share < 0.3 and recall >= 0.9
    share, recall = _verified(unit(rng.standard_normal((6000, 64))))
    # Vectors without structure: what the test can spare is little.
    assert share < 0.95 and recall >= 0.9
