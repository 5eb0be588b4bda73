"""Benchmark decontamination against the longest common subsequences of all stretches of all documents, and its edge cases."""

import random
import re

import numpy as np
import pytest

from variorum.llm import decontam


def _words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def _leaks(passage, words):
    """Whether some stretch of 3/2 of the passage's words leaks it, and whether one of as many words as a scan may look at does."""
    passage_ids = {w: i for i, w in enumerate(dict.fromkeys(passage))}
    p = np.array([passage_ids[w] for w in passage], np.uint64)
    t = np.array([passage_ids.get(w, 1 << 40) for w in words], np.uint64)
    out = []
    for size in (3 * len(p) // 2, 2 * len(p) + 2 * decontam.STRIDE):
        hit = False
        for a in range(0, max(len(t) - size, 0) + 1):
            part = t[a : a + size]
            if np.isin(p, part).sum() < decontam.PARAPHRASE * len(p):
                continue
            length, taken = decontam.common(p, part)
            share = length / len(p)
            hit |= share >= decontam.VERBATIM or (share >= decontam.PARAPHRASE and taken[-decontam.ANSWER :].mean() >= 0.5)
        out.append(hit)
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(77)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in ("k", "lm", "n", "pt", "r", "st")]
    common = ["the", "of", "and", "a", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary)
    text = lambda n: " ".join(word() for _ in range(n))
    items = {i: text(n) for i, n in enumerate([8, 9, 12, 15, 15, 16, 18, 19, 22, 30, 40, 44, 55, 60, 75, 96])}
    docs = {d: text(rng.randint(0, 150)) for d in range(40)}
    d = 100
    for i, item in items.items():
        for change in (0, 0.1, 0.2, 0.3):
            words = [w if rng.random() >= change else rng.choice([word(), "", f"{w} {word()}"]) for w in item.split()]
            docs[d] = f"{text(rng.randint(0, 60))} {' '.join(words)} {text(rng.randint(0, 60))}"
            d += 1
    order = list(items)
    for _ in range(4):  # all items, back to back
        rng.shuffle(order)
        docs[d] = " ".join(items[i] for i in order)
        d += 1
    return items, docs


def test_against_all_stretches(spark, made):
    items, docs = made
    got = decontam.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found) == len(got) and all(0.65 <= r.lcs <= 1 and decontam.COSINE - 0.001 <= r.cosine <= 1.001 for r in got)
    sure, possible = set(), set()
    for d, text in docs.items():
        for i, item in items.items():
            near, far = _leaks(_words(item), _words(text))
            if near:
                sure.add((d, i))
            if far:
                possible.add((d, i))
    assert found <= possible
    verbatim = {(d, i) for d, text in docs.items() for i, item in items.items() if f" {item} " in f" {text} "}
    assert verbatim <= found
    assert len(found & sure) >= 0.95 * len(sure), sorted(sure - found)
    assert len(sure) > 120


def test_short_items_ties_and_odd_rows(spark):
    filler = " ".join(f"f{k}" for k in range(30))
    long = " ".join(f"w{k}" for k in range(40))
    items = [(1, "Seven words that stand here in order"), (2, "one"), (3, long), (3, long), (4, ""), (5, None), (None, long), (6, "!!"), (7, " ".join(f"p{k}" for k in range(130)))]
    rows = [
        (1, f"{filler} seven words, that stand here in ORDER {filler}"),
        (2, f"{filler} seven words that stand here in no order"),
        (3, f"{long} {filler} {long}"),
        (3, f"{long} {filler} {long}"),
        (4, f"{filler} one"),
        (5, None),
        (6, ""),
        (None, long),
        (8, f"{filler} " * 5000 + long),
        (9, f"{filler} " + " ".join(f"p{k}" for k in range(40, 130))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as item_id", "'x' as words", "2 as lcs")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (3, 3), (4, 2), (8, 3), (9, 7)}
    assert got[1, 1].lcs == 1 and got[1, 1].first_word == 30
    assert got[3, 3].lcs == 1
