"""Fits that read every row they may learn from: models of more rows than samples once had."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from variorum.llm import decontam, toxicity

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def late(spark):
    """Texts, labels, and the ids of toxic ones: all that may teach so come after 6,000 others in the order of a hash of doc_id."""
    rng = random.Random(21)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ro") for b in ("dan", "fel", "gor", "hul", "jin", "kem", "lop")]
    open_ = [r.id for r in spark.range(8500).where(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id")).collect()]
    held = sorted(set(range(8500)) - set(open_))
    assert len(open_) > 6400
    # Some toxic ones of another word come early, so that a sample has both labels.
    early, late = set(open_[:6000:15]), set(open_[6100::2]) | set(held[::10])
    texts = {}
    for d in range(8500):
        bad = ["grimbad"] if d in early else ["vilenast"] if d in late else []
        texts[d] = ". ".join(" ".join([rng.choice(words) for _ in range(5)] + (bad if k == 1 else [])) for k in range(3)) + "."
    return list(texts.items()), [(d, 1, int(d in early or d in late)) for d in texts], late & set(held), late | early


def test_toxicity_learns_from_every_labelled_document(spark, late):
    rows, labels, unseen, _ = late
    df, said = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, said)
    got = {r.doc_id for r in toxicity.score(df, model).where("predicted = 1").collect()}
    assert len(got & unseen) >= 0.95 * len(unseen)
    # Several groups learn it as well, and their model doesn't depend on how the tables are laid out.
    size = sum(len(t) for _, t in rows)
    a = toxicity.fit(df, said, group_bytes=size // 4)
    b = toxicity.fit(df.repartition(7, "text"), said.unionByName(said).repartition(3), group_bytes=size // 4)
    assert (a.weights != 0).any() and np.array_equal(a.weights, b.weights)
    got = {r.doc_id for r in toxicity.score(df, a).where("predicted = 1").collect()}
    assert len(got & unseen) >= 0.95 * len(unseen)


def test_the_stage_of_toxicity_as_well(spark, late, tmp_path):
    rows, labels, unseen, toxic = late
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], f"{DOCS}, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).collect()}
    assert len(left & unseen) <= 0.05 * len(unseen) and len(set(dict(rows)) - toxic - left) <= 2


def test_the_latent_space_is_of_all_passages(spark, monkeypatch):
    rng = random.Random(22)
    words = [f"w{i}" for i in range(900)]
    items = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(8))) for i in range(5000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(300)], DOCS)
    cut = decontam.passages(items).cache()
    seen = []

    def watched(rows, *a):
        seen.extend([rows.toArrow(), fitted(rows, *a)])
        return seen[1]

    fitted = decontam.randomised_svd
    monkeypatch.setattr(decontam, "randomised_svd", watched)
    decontam.space(docs, cut)
    cut.unpersist()
    rows, basis = seen
    assert rows.num_rows == 5000
    dense = np.zeros((5000, len(basis)))
    for k, (at, value) in enumerate(zip(rows["at"].to_pylist(), rows["value"].to_pylist(), strict=True)):
        dense[k, at] = value
    best = np.linalg.svd(dense, compute_uv=False)[: decontam.RANK]
    # Nothing stands out among random words, so a few passes come near the best directions only.
    assert np.linalg.norm(dense @ basis) ** 2 >= 0.9 * (best**2).sum()
