"""Queries over rows made for what they must not leave out."""

from types import SimpleNamespace

from variorum import catalog, pairs

ROW = "pair_id long, block_id int, section string, page int, slide int, paragraph_number int, sentence_number int, table_id string, status string, source_text string, output_text string, comments string"


def test_report_has_all_rows(spark, monkeypatch):
    def row(pair, i, status):
        return (pair, i, "S", None, None, i, 1, None, status, f"old text {i}", f"new text {i}" if status == "modified" else f"old text {i}", "")

    rows = [row(1, i, "modified" if i % 4 else "match") for i in range(320)] + [row(2, i, "match") for i in range(70)]
    details = spark.createDataFrame(rows, ROW)
    result = SimpleNamespace(detail_rows=details.drop("table_id"), table_rows=details.limit(0))
    monkeypatch.setattr(catalog, "_compared", lambda *_: result)
    exported = catalog.report_rows(spark, "").select("pair_id", "block_id", "status").collect()
    assert sorted((r.pair_id, r.block_id, r.status.lower()) for r in exported) == sorted((r[0], r[1], r[8]) for r in rows)
    shown = catalog.QUERIES["preview_rows"](spark, "").groupBy("pair_id").count().collect()
    assert {r.pair_id: r["count"] for r in shown} == {1: 200, 2: 50}


def test_every_document_has_a_pair(spark, tmp_path):
    opening = "The same opening of more than sixty characters in each of the texts here."
    docs = {1: "short", 2: f"{opening} One.", 3: f"Changed {opening} One.", 4: "", 5: "\n".join(f"line {i}" for i in range(40)), 6: None}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.pair_id: r for r in pairs.edited_copies(spark, str(tmp_path)).collect()}
    assert {d: r.src for d, r in got.items()} == {d: t for d, t in docs.items() if t is not None}
    assert all(r.out != r.src for r in got.values())
    assert 30 <= len(got[5].out.split("\n")) < 40 and "LINE" in got[5].out and "some words more" in got[5].out
    compared = catalog.combined_similarity(spark, str(tmp_path)).collect()
    assert {r.pair_id for r in compared} == set(got)
