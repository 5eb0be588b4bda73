from variorum.streaming import filedrop


def test_file_drop(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.src.txt").write_text("First paragraph stays here.\n\nSecond one vanishes entirely.")
    (inbox / "a.out.txt").write_text("First paragraph stays here.")
    (inbox / "b.src.txt").write_text("No partner yet.")
    query = filedrop.watch(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "out/stats")).collect()
    assert (row.matched, row.missing, row.added) == (1, 1, 0)
