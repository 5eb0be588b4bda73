"""Copies go: in the pipeline those that line dedup has emptied, and those without words."""

import pyarrow as pa

import corpus_pipeline
from variorum.llm import bytesops, neardup


def test_emptied_copies_go(spark, tmp_path):
    text = "\n".join(f"Line {i} of this text is long enough and says w{i * 7919}." for i in range(5))
    docs = {1: text, 2: "Another text of one line that nobody has copied.", 3: "", 4: None, 5: " \n ", 6: text.split("\n")[3], 7: text + "\nIts own last line, which is new."}
    docs |= {d: text for d in range(10, 40)} | {d: f"\n\n{text}\n\n" for d in range(40, 50)}
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    now = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    left = corpus_pipeline.one_of_each_group(spark, now, str(tmp_path))
    assert left.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 5, 7]


def test_equal_texts_without_words(spark):
    rows = [(1, "*** ---"), (2, "*** ---"), (3, "*** --"), (4, ""), (5, ""), (6, None)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_repeated_passages(spark):
    rows = []
    for d in range(20):
        words = [f"w{d}x{k}" for k in range(100)]
        again = words[40:54]
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(words[:54] + again * 10 + words[54:]))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of, h, count = neardup.shingles(*bytesops.column_bytes(pa.array([rows[0][1], rows[1][1]])))
    a, b = of == 0, of == 1
    set_j, prob_j = neardup.similarities(h[a], count[a].astype(float), h[b], count[b].astype(float))
    assert set_j >= 0.8 and prob_j < 0.6
    assert got == {d: d - d % 2 for d in range(40)}
