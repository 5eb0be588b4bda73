"""The pipeline's stages on a small table, held against their operators' own results."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    text = lambda: "\n".join(sentence(rng.randint(8, 25)) for _ in range(rng.randint(3, 6)))
    docs = {d: text() for d in range(300)}
    labels = []
    for d in range(300):
        bad = d % 4 == 0
        if bad:
            docs[d] += f"\nYou {rng.choice(['grimbad', 'vilenast'])} {sentence(5)}"
        labels.append((d, 1, int(bad)))
    item = sentence(40)
    docs[301] = text() + "\n" + item
    near = docs[5].split(" ")
    near[7] = "changed"
    docs[302] = " ".join(near)
    docs[303] = docs[5]
    rows = [(d, t, "en", "s", len(t)) for d, t in docs.items()] + [(400, None, None, None, None), (401, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
    toxic = {d for d in range(0, 300, 4)}
    assert len(ids["toxicity"] & toxic) <= 2 and len(set(docs) - toxic - ids["toxicity"]) <= 2
    assert ids["line_dedup"] == ids["toxicity"] and {400, 401} <= ids["bpe"]
    assert 301 not in ids["decontamination"] and 301 in ids["near_dedup"]
    assert ids["decontamination"] == ids["near_dedup"] - {301} and ids["bpe"] == ids["decontamination"]
    whole = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == ids["bpe"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows and ids, columns besides those of documents."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("odd", [(1, "Some words that stand here.", "en", "s", 27), (1, "Some words that stand here.", "en", "s", 27), (1, "Quite another text of the same id.", None, None, None), (None, "No id at all here.", "en", "s", 18), (2, None, None, None, None)])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS predicted", "'x' AS class_id", "7 AS n_lines")
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, now, folder)
            if stage == "bpe":
                assert out.count() == len(rows)
                break
            assert out.columns == corpus_pipeline.COLUMNS
            out.write.parquet(f"{folder}/{stage}")
            now = spark.read.parquet(f"{folder}/{stage}").selectExpr("*", "1 AS predicted", "'x' AS class_id", "7 AS n_lines")
            assert now.count() == len(rows), stage
