"""Recall on tables where sketches, truncated spaces and indexes have something to miss; each held against brute force."""

import math
import random
import re
from collections import Counter

from variorum.llm import decontam, licenses, neardup

DOCS = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def test_paraphrases_of_many_items(spark):
    """600 items and as many corpus passages, so that the space keeps RANK directions of far more."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(4000)]
    word = lambda: rng.choice(vocabulary[:60]) if rng.random() < 0.4 else rng.choice(vocabulary)
    text = lambda n: [word() for _ in range(n)]
    items = {i: text(rng.randint(12, 90)) for i in range(600)}
    docs, want = {d: text(rng.randint(20, 200)) for d in range(1000)}, set()
    for n, i in enumerate(rng.sample(sorted(items), 300)):
        body, answer = items[i][: -decontam.ANSWER], items[i][-decontam.ANSWER :]
        changed = [x for w in body for x in rng.choice([[w]] * 7 + [[word()], [], [w, word()]])]
        docs[2000 + n] = text(rng.randint(0, 150)) + changed + answer + text(rng.randint(0, 150))
        passage = items[i] if len(items[i]) <= decontam.PASSAGE else items[i][: decontam.PASSAGE]
        row = [0] * (len(passage) + 1)
        for w in changed + answer:
            row = [0, *_next_row(row, passage, w)]
        if row[-1] >= 0.7 * len(passage):
            want.add((2000 + n, i))
    assert len(want) > 200
    got = decontam.leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], DOCS), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & want) >= 0.95 * len(want)
    assert not {d for d, _ in found if d < 1000}


def _next_row(row, passage, w):
    left = 0
    for j, p in enumerate(passage):
        left = row[j] + 1 if p == w else max(left, row[j + 1])
        yield left


def test_classes_by_both_similarities(spark):
    rng = random.Random(22)
    many = [f"w{i}" for i in range(2000)]
    base = [[rng.choice(many) for _ in range(rng.randint(40, 90))] for _ in range(40)]
    docs = {}
    for d in range(260):
        words = list(rng.choice(base))
        if rng.random() < 0.4:  # a stretch again and again: sets and weights then differ
            at = rng.randrange(len(words) - 12)
            words += words[at : at + rng.randint(6, 12)] * rng.randint(1, 6)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(many)
        docs[d] = words
    bags = {d: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for d, w in docs.items()}

    def similarity(x, y):
        shared = x.keys() & y.keys()
        both = len(shared) / len(x.keys() | y.keys())
        weighted = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in shared)
        return max(both, weighted)

    def components(least):
        root = {d: d for d in docs}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for (a, b), s in scored.items():
            if s >= least:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
        return {d: find(d) for d in docs}

    ids = sorted(docs)
    scored = {(a, b): similarity(bags[a], bags[b]) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(bags[a].keys() & bags[b].keys()) > 5}
    assert any(s >= 0.8 for s in scored.values())
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], DOCS)).collect()}
    sure, at_most = components(0.81), components(0.8 - 1e-12)
    for (a, b), s in scored.items():
        if s >= 0.81:
            assert got[a] == got[b], s
    assert all(at_most[a] == at_most[got[a]] for a in ids)  # no class joins what no link joins
    close = sum(0.8 - 1e-12 <= s < 0.81 for s in scored.values())
    assert sum(got[d] != at_most[d] for d in ids) <= close and len(set(got.values())) <= len(set(sure.values()))


def test_licence_labels_by_all_positions(spark):
    rng = random.Random(23)
    templates = licenses.TEMPLATES
    noise = ["alpha", "beta", "gamma", "software", "license", "the", "of"]
    rows = []
    for d in range(120):
        words = [rng.choice(noise) for _ in range(rng.randint(0, 30))]
        for t in rng.sample(templates, rng.randint(0, 2)):
            words += [w if rng.random() > rng.choice([0, 0.1, 0.3]) else rng.choice(noise) for w in t.words] + [rng.choice(noise) for _ in range(rng.randint(0, 10))]
        rows.append((d, " ".join(words)))
    rows += [(500, None), (501, ""), rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    counts, n = licenses.frequencies(df, templates)
    idf = {w: math.log((n + 1) / (c + 1)) + 1e-3 for w, c in counts.items()}

    def plain(text):
        words, found = words_of(text), set()
        for t in templates:
            total = sum(idf[w] for w in t.words)
            for at in range(-len(t.words) + 1, len(words)):
                there = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(t.words)]
                if all(there[p] for p in t.key_places()) and sum(idf[w] for w, x in zip(t.words, there, strict=True) if x) / total >= t.least - 1e-9:
                    found.add((t.label, max(at, 0)))
        return found

    got = sorted(((r.doc_id, r.labels, sorted({(s.label, s.first_word) for s in r.spans})) for r in licenses.scan(df).collect()), key=str)
    want = sorted(((d, ",".join(sorted({x for x, _ in plain(t)})), sorted(plain(t))) for d, t in rows), key=str)
    assert got == want
