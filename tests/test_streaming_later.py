import os

from variorum import storage
from variorum.streaming import filedrop


def test_partner_comes_later(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run():
        filedrop.watch(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()

    (inbox / "a.src.txt").write_text("First paragraph stays here.\n\nSecond one vanishes entirely.")
    run()
    (inbox / "b.src.txt").write_text("No partner yet.")
    run()
    (inbox / "a.out.txt").write_text("First paragraph stays here.")
    run()
    (row,) = spark.read.parquet(str(tmp_path / "out/stats")).collect()
    assert (row.matched, row.missing, row.added) == (1, 1, 0)
    (left,) = spark.read.parquet(str(tmp_path / "out/waiting/batch=2")).collect()
    assert left.file_name == "b.src.txt"


def test_of_two_files_the_later_counts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i, (name, text) in enumerate((("a.src.txt", "Kept words stay."), ("a.out.txt", "Other words came."), ("a.out.html", "<p>Kept words stay.</p>"))):
        (inbox / name).write_text(text)
        os.utime(inbox / name, (1_700_000_000 + i, 1_700_000_000 + i))
    held = len(storage._written)
    filedrop.watch(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "out/stats")).collect()
    assert (row.matched, row.missing, row.added) == (1, 0, 0)
    assert len(storage._written) == held
