"""Scores against plain loops, and the stated cases of each operator that its main test leaves out."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from variorum.llm import bpe, bytesops, components, langid, licenses, linededup, toxicity, training, urls, warc

DOCS = "doc_id long, text string"


def test_language_scores_by_a_plain_loop(spark):
    rng = random.Random(5)
    parts = {"xx": ["tion", "the", "Ing"], "yy": ["éau", "Ça", "elle"], "zz": ["sch", "ung", "ÖL"]}
    rows = [(i, " ".join("".join(rng.choice(parts[g]) for _ in range(3)) + rng.choice(["", ".", " 12"]) for _ in range(rng.randint(0, 30))), g) for i in range(120) for g in [rng.choice(list(parts))]]
    df = spark.createDataFrame([*rows, rows[0]], f"{DOCS}, lang string").withColumn("rejected", F.lit("clash"))
    model = langid.fit(df)

    def plain(text):
        raw = bytearray(text.encode())
        for k in range(len(raw)):
            if 65 <= raw[k] <= 90 or (k and raw[k - 1] == 0xC3 and 0x80 <= raw[k] <= 0x9E and raw[k] != 0x97):
                raw[k] += 32
        words = re.findall(rb"[a-z\x80-\xff]+", bytes(raw))
        line = b" " + b" ".join(words) + (b" " if words and re.search(rb"[^a-z\x80-\xff]$", bytes(raw)) else b"")
        total, used = np.zeros(len(model.classes)), 0
        for end in range(len(line)):
            h = 0
            for n in range(1, 5):
                if end - n + 1 < 0:
                    break
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (line[end - n + 1] + 0x9E37 * n)
                mixed = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
                total += model.table[mixed >> (32 - langid.BITS)]
                used += 1
        z = total / max(used, 1) + model.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    out = langid.predict(df, model).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        if r.lang_pred == "und":
            assert not re.search("[a-zéçö]", r.text.lower())
        else:
            p = plain(r.text)
            assert model.classes[int(p.argmax())] == r.lang_pred and abs(p.max() - r.score) < 1e-4


def test_toxicity_scores_by_a_plain_loop(spark):
    rng = random.Random(6)
    words = ["Stone", "river", "élan", "vile", "grim", "cloud", "window"]
    rows = [(i, "".join(" ".join(rng.choice(words[:3] + words[5:]) for _ in range(rng.randint(1, 6))) + (" grimvile" if rng.random() < 0.1 else "") + rng.choice(". ! ? \n".split(" ")) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    labels = [(i, int("grimvile" in t)) for i, t in rows] + [(0, 1), (1, 0), (1, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("offending", F.lit("clash"))
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (model.weights != 0).any()

    def plain(text):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        sentences = re.findall(rb"[^.!?\n]+", low)
        clean = 1.0
        for s in sentences:
            buckets = set()
            for w in re.findall(rb"[a-z0-9\x80-\xff]+", s):
                for n in (0, *toxicity.PREFIXES):
                    h = bytesops.word_hash(w[:n] if n else w) + n * 0x9E3779B9
                    buckets.add((h * 0xC4CEB9FE1A85EC53 & (1 << 64) - 1) >> (64 - toxicity.BITS))
            z = model.bias - math.log(len(sentences)) + sum(float(model.weights[b]) for b in buckets)
            clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    out = toxicity.score(df, model).collect()
    assert len(out) == len(rows) and all(abs(plain(r.text) - r.score) < 1e-5 and r.predicted == (r.score >= 0.5) for r in out)
    none = spark.createDataFrame([], DOCS)
    assert toxicity.score(none, toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_training_rows_are_bounded(spark):
    rows = [(i % 50, "x" * (i % 7 + 1), i % 2) for i in range(400)] + [(None, "y", 1)]
    df = spark.createDataFrame(rows, f"{DOCS}, label int")
    few = training.training_rows(df, ["label"], 20, 10**9)
    assert few.distinct().count() == 20
    small = training.training_rows(df, ["label"], 1000, 60).distinct().collect()
    assert 50 <= sum(len(r.text) for r in small) <= 60
    got = training.in_one_task(few, lambda t: (t.num_rows, t["doc_id"].to_pylist()))
    assert got[0] == 20 and got[1] == sorted(got[1])
    assert training.in_one_task(few.limit(0), lambda t: t.num_rows) == 0


MIT = next(t for t in licenses.TEXTS if t.label == "mit")


def test_licence_texts(spark):
    words = list(MIT.words)
    damaged = [w if k % 9 or any(k in range(p, p + 1) for p in MIT.key_places()) else "other" for k, w in enumerate(words)]
    broken = ["other" if k in MIT.key_places() else w for k, w in enumerate(words)]
    rows = [(1, "Copyright (c) 2020 A\n\n" + " ".join(words)), (2, " ".join(damaged)), (3, " ".join(broken[20:])), (4, " ".join(words) + " all rights reserved " + " ".join(words)), (4, "nothing here"), (5, " ".join(next(t for t in licenses.TEXTS if t.label == "zlib").words))]
    got = sorted((r.doc_id, r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect())
    assert [(d, x) for d, x, _ in got] == [(1, "mit"), (2, "mit"), (3, ""), (4, ""), (4, "mit,reserved"), (5, "zlib")]
    assert all(0 <= s <= 1 for _, _, s in got) and got[0][2] == 1


def test_urls_come_back_and_archives_are_apart(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 4000)
    odd = ["http://h/a%20b%2Fc", "http://h/a b", "http://h/100%", "http://h/ü?q=ä#f", "%", " ", "", None]
    big = "z" * 9000
    rows = [(i, u, "p" * i) for i, u in enumerate(odd)] + [(9, "same", big), (9, "same", big), (8, "same", big), (10, "long", "y" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    got = warc.round_trip(df)
    found = sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in got.collect()), key=str)
    want = [(i, u or "", i, "response", None) for i, u in enumerate(odd)] + [(9, "same", 9000, "response", None)] * 2 + [(8, "same", 9000, "revisit", 9), (10, "long", 50_000, "response", None)]
    assert found == sorted(want, key=str)
    folder = f"{warc.storage.new_folder(spark, 'warc-test')}"
    archives = warc.write(df, folder)
    spread = warc._apart(archives.select("archive"))
    sizes = spread.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == archives.count() >= 4


def test_ranks_beyond_two_bytes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 65_536, b"bc": 70_000, b"abc": 140_000, b"cab": 99_999, b"aa": 200_000}
    coder = bpe.Coder(ranks)
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode() for _ in range(300)]
    text = np.frombuffer(b"".join(words), np.uint8)
    ids, sizes = coder.merge(text, np.cumsum([len(w) for w in words]))
    at = 0
    for w, n in zip(words, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == coder.merge_long(w)
        at += n
    coder.rest()


def test_url_of_any_length(spark):
    long = "http://a.example.net/en/" + "x/" * 50_000 + "?q=" + "y" * 100_000
    (r,) = urls.judge(spark.createDataFrame([(1, long)], "page_id long, url string"), urls.RULES, urls.PATTERNS).collect()
    assert r.rule == "example.net/en/" and r.verdict == "allow" and len(r.path) == 100_004


def test_near_lines_around_segments(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for d in range(160):
        n = rng.choice([20, 62, 63, 64, 65, 66, 127, 128, 129, 130, 193])
        line = "".join(rng.choice("abcdefgh é") for _ in range(n - 2)).join("xy")
        i = rng.choice([0, 1, 62, 63, 64, 65, n - 2, n - 1, rng.randrange(n)]) % n
        kind = rng.randrange(4)
        other = [line[:i] + line[i + 1 :], line[:i] + "Z" + line[i:], line[:i] + "Z" + line[i + 1 :], line[:i] + "ZZ" + line[i:]][kind]
        rows += [(2 * d, line), (2 * d + 1, other)]
        want[2 * d + 1] = int(kind < 3 and min(len(line), len(other)) >= 20)
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.n_near for r in linededup.dedup(df).collect()}
    assert all(got[d] == n for d, n in want.items()) and not any(got[d] for d in range(0, 320, 2))
    assert linededup.dedup(df, edits=0).agg(F.sum("n_near")).head()[0] == 0
    assert linededup.dedup(spark.createDataFrame([(1, "Item 1"), (2, "Item 2")], DOCS), near_from=5).agg(F.sum("n_near")).head()[0] == 1
    with pytest.raises(ValueError, match="edits"):
        linededup.dedup(df, edits=2)


def test_very_long_lines(spark):
    rng = random.Random(12)
    line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(100_000))
    rows = [(1, line), (2, line[:70_000] + line[70_001:]), (3, line[:70_000] + "?" + line[70_001:]), (4, line[::-1])]
    assert {r.doc_id: r.n_near for r in linededup.dedup(spark.createDataFrame(rows, DOCS)).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("part", [10**6, 40])
def test_components(spark, part):
    rng = random.Random(13)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long"), part=part).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
