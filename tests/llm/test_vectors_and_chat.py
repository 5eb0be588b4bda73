"""Chat formatting, clustering and whitening against brute force, and the cases that their docstrings state."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from variorum.llm import chat, clusters, whitening

TURNS = "conv_id long, turn long, role string, text string"
PIECES = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "<", "s>", "INST]", " ", "a", "[ROLE]", "[/TURN]", "[\\INST]", "<\\\\/s>", "é", "\n", "😀"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("segment", [chat.SEGMENT, 30])
def test_chat_comes_back(spark, segment):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12)))])
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system", "tool", "[INST]", " "]), text()) for _ in range(300)]
    rows += [(50, t, "user" if t % 2 else "assistant", f"turn {t} </s>") for t in range(400)] + rows[:5] + [(60, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"part": F.lit("clash"), "open": F.lit(1)}).repartition(5)
    segments = chat.formatted(df, segment)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode())
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        want[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), sha(loss))
    got = chat.digests(segments).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:5] for r in got} == want
    chars = {r.conv_id: r.n for r in segments.groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("n")).collect()}
    assert {r.conv_id: r.formatted_chars for r in got} == chars
    read = chat.turns_of(segments.where("conv_id = 50")).orderBy("part", "segment", "position").collect()
    assert [r.text for r in read] == [f"turn {t} </s>" for t in range(400)] and {r.role for r in read} == {"user", "assistant"}
    if segment == 30:
        assert segments.where("conv_id = 50").count() > 100
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_chat_escapes_only_conflicts():
    plain = [("user", "Is [x] < y or \\n?"), ("assistant", "[INST is no mark, s> neither")]
    text, spans = chat.round_trip(plain)
    assert text == "[INST] Is [x] < y or \\n? [/INST]<s>[INST is no mark, s> neither</s>" and text[spans[0][0] :][: spans[0][1]] == plain[1][1]
    assert chat.round_trip([("user", "a"), ("assistant", "<s>")])[0] == "[INST] a [/INST]<s><\\s></s>"
    for broken in ("x", "[INST] a", "[INST]a [/INST]", "[INST] a </s>", "<s>a</s>b", "[ROLE] user [/ROLE] a [/TURN]", "[INST] [/INST]", "[ROLE] r [/ROLE] a</s>"):
        assert chat.parse(broken) is None


def lloyd(vectors, k, rounds, dim):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in vectors if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted((i is None, sha(f"2:{i}"), x) for i, x in kept)[:k]
    centroids = [list(x) for _, _, x in first]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for n in range(len(centroids)):
            own = [x for (_, x), c in zip(kept, of, strict=True) if c == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = [sum(d for _, c, d in out if c == n) for n in range(len(centroids))]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha(",".join(map(str, centroids[c])))) for i, c, d in out), key=str)


@pytest.mark.parametrize(("dim", "k", "grid"), [(3, 40, 8), (2, 7, 4), (4, 12, 256), (3, 500, 8)])
def test_clusters_by_lloyds_rounds(spark, dim, k, grid):
    rng = random.Random(dim * k)
    rows = [(i, [rng.randint(-8, 8) / grid for _ in range(dim)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)] + rows[:3] + [(None, rows[5][1]), (1000, None), (1001, [0.5] * (dim + 1)), (1002, [float("nan")] * dim), (1003, [None] * dim), (1004, [float("inf")] * dim), (1005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("clash"), "x": F.lit(1)}).repartition(3)
    got = clusters.cluster(df, k=k, dim=dim).drop("scanned").collect()
    assert sorted((tuple(r) for r in got), key=str) == lloyd(rows, k, 5, dim)
    assert clusters.cluster(df.where("vec_id >= 1000"), k=k, dim=dim).count() == 0


def test_clusters_of_large_components_and_few_scans(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * 4
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.3).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = clusters.cluster(df, k=30, dim=16, rounds=8)
    assert out.agg(F.avg("scanned")).head()[0] < 6
    large = [(i, [rng.uniform(-1e5, 1e5) for _ in range(16)]) for i in range(60)] + [(99, [1e30] * 16)]
    got = clusters.cluster(spark.createDataFrame(large, "vec_id long, embedding array<double>"), k=5, dim=16).drop("scanned").collect()
    assert sorted((tuple(r) for r in got), key=str) == lloyd(large[:-1] + [(99, [clusters.LIMIT / 256] * 16)], 5, 5, 16)


def whole(v):
    return [int(np.floor(64 * float(c))) + 1_000_000 for c in v]


@pytest.mark.parametrize("spread", [[1, 1, 1, 1, 1], [1e6, 3e4, 10, 1, 0.3], [1, 1, 1, 0, 1]])
def test_whitening_by_exact_fractions(spark, spread):
    rng = np.random.default_rng(4)
    mix = np.linalg.qr(rng.normal(size=(5, 5)))[0] if spread[0] == 1 and 0 not in spread else np.eye(5)
    x = (rng.normal(size=(400, 5)) * spread @ mix + 7).tolist()
    rows = list(enumerate(x)) + [(i, x[0]) for i in range(400, 700)] + [(3, x[3]), (None, x[4]), (1000, None), (1001, []), (1002, [float("nan")] * 5), (1003, [None] * 5), (1004, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("clash"), "component": F.lit(1)}).repartition(6)
    space, distinct = whitening.fit(df, 3)
    points = sorted({tuple(whole(v)) for v in x})
    n, dim = len(points), 5
    sums = [sum(c) for c in zip(*points, strict=True)]
    assert (space.n, space.sums, distinct.count()) == (n, sums, n)
    exact = [[Fraction(sum((n * p[i] - sums[i]) * (n * p[j] - sums[j]) for p in points), n**3) for j in range(dim)] for i in range(dim)]
    for e, v in zip(space.values, space.vectors.T, strict=True):
        v, e = [Fraction(float(c)) for c in v], Fraction(float(e))
        left = [sum(exact[i][j] * v[j] for j in range(dim)) - e * v[i] for i in range(dim)]
        assert max(abs(c) for c in left) < 1e-13 * max(exact[i][i] for i in range(dim)) and abs(sum(c * c for c in v) - 1) < 1e-14
        assert abs(sum(v[i] * exact[i][j] * v[j] for i in range(dim) for j in range(dim)) / e - 1) < 1e-12
    assert abs(space.trace / float(sum(exact[i][i] for i in range(dim))) - 1) < 1e-14
    out = whitening.whiten(df, 5).collect()
    k = 5 - (0 in spread)
    assert len(out) == (len(rows) - 5) * k and {r.component for r in out} == set(range(1, k + 1)) and all(r.identity_error < 1e-9 for r in out)
    by_id = {r.vec_id: r for r in out if r.component == 2}
    full, _ = whitening.fit(df, 5)
    for i in (0, 3, 17, 650):
        p = whole(dict(rows)[i])
        deviation = sum((n * c - s) ** 2 for c, s in zip(p, sums, strict=True))
        assert by_id[i].deviation == (deviation if deviation < 1 << 63 else None)
        plain = sum((Fraction(c) - Fraction(s, n)) * Fraction(float(v)) for c, s, v in zip(p, sums, full.vectors[:, 1], strict=True))
        assert abs(by_id[i].whitened - float(plain) / full.values[1] ** 0.5) < 1e-9
    assert all(abs(r.explained - full.values[r.component - 1] / full.trace) < 1e-15 for r in out)


def test_whitening_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [3.0, 2.0])], schema)).orderBy("vec_id").collect()
    assert [(r.component, r.n, r.deviation, round(abs(r.whitened), 12), r.explained) for r in two] == [(1, 2, 128**2, 1.0, 1.0)] * 3
    far = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in far] == [None, None]


def test_double_double_sums():
    total = whitening.Sum((1,))
    for v in (1e16, 1.0, -1e16, 1e-9):
        total.add(np.array([v]))
    assert total.high[0] + total.low[0] == 1.000000001
    rng = np.random.default_rng(1)
    d = rng.normal(size=(300, 3)) * [1, 1e4, 1e-3]
    got = whitening.Sum((3, 3))
    whitening.outer(got, d, np.zeros_like(d))
    exact = [[sum(Fraction(a) * Fraction(b) for a, b in zip(d[:, i].tolist(), d[:, j].tolist(), strict=True)) for j in range(3)] for i in range(3)]
    for i in range(3):
        for j in range(3):
            assert abs(Fraction(got.high[i, j]) + Fraction(got.low[i, j]) - exact[i][j]) < Fraction(1, 10**19) * exact[1][1]
