"""What keeps long texts and large scopes within bounds, held against plain versions."""

import random
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from variorum import catalog
from variorum.functions import similarity as S
from variorum.functions import worddiff
from variorum.operators import align as A
from variorum.plans import compare as C


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_bounded_distances_by_the_table():
    rng = random.Random(3)
    a, b = [], []
    for _ in range(400):
        x = "".join(rng.choice("abcé😀 ") for _ in range(rng.choice([0, 1, 2, 20, 63, 64, 65, 127, 128, 129, 200])))
        edited = "".join(c for c in x if rng.random() > 0.1) + "x" * rng.randint(0, 3)
        a.append(x)
        b.append(rng.choice([x, edited, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 200)))]))
    true = [_distance(x, y) for x, y in zip(a, b, strict=True)]
    for most in ([10**6] * len(a), [rng.randint(0, 120) for _ in a], [0] * len(a)):
        want = [d if d <= m else None for d, m in zip(true, most, strict=True)]
        assert S.edit_distances(a, b, most) == want
        assert [S.edit_distance(x, y, m) for x, y, m in zip(a, b, most, strict=True)] == want
    long = "".join(rng.choice("abcdef ") for _ in range(3000))
    assert S.edit_distances([long], [long[5:] + "zz"], [100]) == [7] and S.edit_distances([long], [long[::-1]], [50]) == [None]


def test_scores_keep_the_threshold():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "12", "7.5", "delta", "x"]
    a = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    b = [rng.choice([x, x.replace("1", "3"), x + " end", rng.choice(a)]) for x in a]
    whole = S.combined_scores(a, b)
    for least in (0.3, 0.45, 0.75, 0.9):
        assert S.combined_scores(a, b, least) == [s if s >= least else None for s in whole]


@pytest.mark.parametrize("least", [0.3, 0.45, 0.75])
def test_the_bound_loses_no_pair(spark, least):
    rng = random.Random(5)
    words = ["red", "green", "blue", "one", "two", "12", "34", "a long word", "x"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))
    src = spark.createDataFrame([(g, i, text()) for g in range(3) for i in range(40)], "g int, idx int, text string")
    out = spark.createDataFrame([(g, i, text()) for g in range(3) for i in range(40)], "g int, idx int, text string")
    score = lambda pairs: {(r.g, r.src_idx, r.out_idx) for r in pairs.collect() if S.combined(r.a, r.b) >= least}
    every, likely = A.candidates(src, out, ["g"]), A.candidates(src, out, ["g"], least=least)
    assert score(every) == score(likely) and likely.count() < every.count() == 3 * 1600


def _greedy(edges):
    taken, used_s, used_o = [], set(), set()
    for g, s, o, score in sorted(edges, key=lambda e: (e[0], -e[3], e[1], e[2])):
        if (g, s) not in used_s and (g, o) not in used_o:
            used_s.add((g, s))
            used_o.add((g, o))
            taken.append((g, s, o, score))
    return sorted(taken)


@pytest.mark.parametrize("scores", [1000, 3, 1])
@pytest.mark.parametrize("spread", [10**6, 100])
def test_choice_by_the_greedy_loop(spark, scores, spread):
    rng = random.Random(scores + spread)
    edges = [(g, s, o, rng.randint(1, scores) / scores) for g, n in ((1, 60), (2, 12), (3, 1)) for s in range(n) for o in range(n) if rng.random() < 0.5]
    df = spark.createDataFrame(edges, "g int, src_idx int, out_idx int, score double").repartition(3)
    assert sorted(map(tuple, A.choose(df, ["g"], spread).collect())) == _greedy(edges)


def test_numbers_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 3)
    detail = [(1, s, p, q) for s in range(2) for p in range(10) for q in range(p % 3 + 1)] + [(2, 0, 0, 0)]
    table = [(1, s, 0, q) for s in range(2) for q in range(4)]
    d = spark.createDataFrame(detail, "pair_id long, sec_op int, para_op int, sub int").selectExpr("*", "1 paragraph_number", "1 sentence_number", "'match' status", "'' source_text", "'' output_text", "null special", "'' comments")
    t = spark.createDataFrame(table, "pair_id long, sec_op int, table_rank int, op_pos int").selectExpr("*", "'t' table_id", "'match' status", "concat_ws('/', sec_op, op_pos) source_text", "'' output_text", "null cell_diffs", "'' comments")
    ops = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "pair_id long, sec_op int").selectExpr("*", "'' title", "1 page", "1 slide")
    rows, cells = C.with_block_ids(d, t, ops)
    n = len([x for x in detail if x[0] == 1 and x[1] == 0])
    assert {r.source_text: r.block_id for r in cells.collect()} == {**{f"0/{q}": n + 1 + q for q in range(4)}, **{f"1/{q}": 2 * n + 5 + q for q in range(4)}}
    assert sorted(r.block_id for r in rows.where("pair_id = 1").collect()) == [*range(1, n + 1), *range(n + 5, 2 * n + 5)]


def test_long_texts_are_cut_fast(spark):
    a = " ".join(f"w{i}" for i in range(20_000))
    rows = spark.createDataFrame([(i, a, a.replace("w10000 ", "X ")) for i in range(40)], "i int, a string, b string").coalesce(1)
    cut = rows.select(worddiff.trim_around_change(F.col("a"), F.col("b")).alias("c"))
    cut.limit(1).collect()
    began = time.time()
    got = cut.collect()
    assert time.time() - began < 40 and {r.c.output for r in got} == {"… w9996 w9997 w9998 w9999 X w10001 w10002 w10003 w10004 …"}


def test_redline_of_long_texts_in_little_memory():
    """Two texts of 100,000 words; the table of both would take over a gigabyte."""
    code = "import random, resource\nfrom variorum.functions.worddiff import _script\nrng = random.Random(1)\na = [str(rng.randint(0, 9999)) for _ in range(100_000)]\nb = [w for w in a if rng.random() > 0.02]\nout = _script(a, b)\nassert [w for k, w in out if k != 'added'] == a and [w for k, w in out if k != 'removed'] == b\nassert sum(k == 'equal' for k, _ in out) == len(b)\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout) < 500


def test_distances_within_bands(monkeypatch):
    """rows and columns are cut to bands, and a wrong guess changes nothing."""
    rng = random.Random(6)
    monkeypatch.setattr(S, "_COLUMNS", 5)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 90)))
        b = list(a if rng.random() < 0.7 else a[::-1])
        for _ in range(rng.randint(0, 25)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
        b = "".join(b)
        true = _distance(a, b)
        for most in (None, true, max(true - 1, 0)):
            for guess in (None, 0, true // 2, true, 200):
                assert S.edit_distance(a, b, most, guess) == (true if most is None or most >= true else None)


def test_documents_of_one_file_are_compared_by_many_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Line {i} stands here.\nAnother one.") for i in range(40)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.QUERIES["combined_similarity"](spark, str(tmp_path)).rdd.getNumPartitions() == 4
