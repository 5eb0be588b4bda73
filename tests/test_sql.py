"""Table functions give the rows of the DataFrame calls."""

import pytest

from variorum import sql
from variorum.functions import worddiff
from variorum.packages import slides, word
from variorum.sources import files

TURNS = [(0, "user", "Where is it?\nTell me."), (1, "assistant", "Here.")]


def test_parse_blocks(spark):
    sql.register(spark)
    rows = [(1, "src", "a.txt", b"One.\r\n  two\n\n\n Three. \n"), (1, "out", "a.docx", word(TURNS)), (2, "src", "b.PPTX", slides(TURNS)), (2, "out", "b.html", b"<h1>T</h1><p>x</p><table><tr><td>1</td><td>2</td></tr></table>"), (3, "src", "c.docx", b"broken"), (3, "out", "c.pdf", b"x"), (4, "src", "d.txt", b""), (4, "out", "none", b"x")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "pair_id long, side string, file_name string, content binary, more string")
    df.createOrReplaceTempView("some_files")
    got = spark.sql("SELECT * FROM parse_blocks(TABLE(some_files))")
    assert got.columns[:4] == ["pair_id", "side", "file_name", "more"] and {r.more for r in got.collect()} == {"kept"}
    documents = files.parse_documents(df)
    blocks = files.blocks(documents)
    assert sorted(map(str, got.where("parse_error is null").select(blocks.columns).collect())) == sorted(map(str, blocks.collect()))
    errors = {(r.pair_id, r.side): r.parse_error.split(":")[0].split(" c")[0] for r in documents.where("parse_error is not null").collect()}
    assert {(r.pair_id, r.side): r.parse_error.split(":")[0].split(" c")[0] for r in got.where("parse_error is not null").collect()} == errors and len(errors) == 4
    with pytest.raises(Exception, match="asked for"):
        spark.sql("SELECT * FROM parse_blocks(TABLE(SELECT 1 AS x))").collect()


def test_redline(spark):
    sql.register(spark)
    rows = [(1, "a b c", "a x c d"), (2, None, "new words"), (3, "", ""), (4, "same", "same")]
    df = spark.createDataFrame(rows, "id long, source_text string, output_text string")
    df.createOrReplaceTempView("some_rows")
    got = spark.sql("SELECT id, collect_list(struct(position, token_type, token)) AS t FROM redline(TABLE(some_rows)) GROUP BY id").collect()
    want = {r.id: [(t.type, t.text) for t in r.m] for r in df.select("id", worddiff.diff_words_merged(df.source_text, df.output_text).alias("m")).collect() if r.m}
    assert {r.id: [(t.token_type, t.token) for t in sorted(r.t)] for r in got} == want
