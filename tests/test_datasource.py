"""Folders of files as a data source, against the reader of pairs."""

import pytest

from variorum.packages import slides, word
from variorum.sources import datasource, files

TURNS = [(0, "user", "Where is it?\nTell me."), (1, "assistant", "Here.")]


@pytest.fixture
def folders(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    contents = {a: {"x.txt": b"One.\n\nTwo.\n\nThree.", "sub/x.docx": word(TURNS), "y.html": b"<h1>T</h1><p>x<table><tr><td>1<td>2</table>", "twice.txt": b"a", "twice.html": b"b", "_hidden.txt": b"no", "e.txt": b""}, b: {"x.html": b"<p>One.</p>", "sub/x.pptx": slides(TURNS), "y.docx": b"broken", "z.pdf": b"%"}}
    for folder, named in contents.items():
        for name, data in named.items():
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_bytes(data)
    return a, b


def _reader(spark, folders, **options):
    spark.dataSource.register(datasource.DocumentBlocks)
    reader = spark.read.format("document_blocks").options(source=str(folders[0]), output=str(folders[1]), **options)
    return reader


def test_same_as_pairs(spark, folders):
    want = files.read_pairs(spark, *map(str, folders))
    got = datasource.read_blocks(spark, *map(str, folders))
    blocks = files.blocks(want)
    assert got.columns == blocks.columns and sorted(map(str, got.collect())) == sorted(map(str, blocks.collect()))
    wrong = {(r.side, r.file_name): r.parse_error.split(":")[0].split(" y.")[0] for r in _reader(spark, folders).load().where("parse_error is not null").collect()}
    known = {(r.side, r.file_name): r.parse_error.split(":")[0].split(" y.")[0] for r in want.where("parse_error is not null").collect() if "_hidden" not in r.file_name}
    # Spark's reader of binary files passes over files of no bytes.
    assert wrong == known | {("src", "e.txt"): files.EMPTY} and len(wrong) == 5


def test_plan(spark, folders):
    listed = datasource.found({"src": str(folders[0]), "out": str(folders[1])})
    assert [f.file_name for f in listed if f.side == "out"] == ["sub/x.pptx", "x.html", "y.docx", "z.pdf"]
    for most in (1, 30, 10**6):
        plan = datasource.shares(listed, most)
        assert [f for s in plan for f in s.files] == listed
        assert all(len(s.files) == 1 or sum(f.bytes for f in s.files) <= most for s in plan)
    assert _reader(spark, folders, bytes="1").load().rdd.getNumPartitions() >= len([f for f in listed if f.bytes])
    assert _reader(spark, folders).load().rdd.getNumPartitions() == 1


def test_pruning(spark, folders):
    every = _reader(spark, folders).load()
    some = _reader(spark, folders).schema("text string, file_name string").load()
    assert some.columns == ["text", "file_name"]
    assert sorted(map(str, some.collect())) == sorted(map(str, every.select("text", "file_name").collect()))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = _reader(spark, folders, pushdown="true").load().where("side = 'src' and file_name like 'sub/%' and block_idx = 0")
        assert [r.file_name for r in pushed.collect()] == [r.file_name for r in every.collect() if r.side == "src" and r.file_name.startswith("sub/") and r.block_idx == 0]
        none = _reader(spark, folders, pushdown="true").load().where("side in ('neither', 'nor')")
        assert none.count() == 0
        # Errors are told from all files, wanted or not.
        (one,) = _reader(spark, folders, pushdown="true").load().where("file_name = 'twice.txt'").collect()
        assert one.parse_error.startswith(files.AMBIGUOUS)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = datasource._Filtered({"source": str(folders[0])}, None)
    from pyspark.sql.datasource import EqualTo, IsNotNull

    assert list(reader.pushFilters([EqualTo(("file_name",), "x.txt"), IsNotNull(("text",))])) == [IsNotNull(("text",))]
    assert [f.file_name for s in reader.partitions() for f in s.files] == ["x.txt"]


def test_empty_folder_and_no_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    spark.dataSource.register(datasource.DocumentBlocks)
    assert spark.read.format("document_blocks").option("source", str(tmp_path / "none")).load().count() == 0
    with pytest.raises(Exception, match="asked for"):
        spark.read.format("document_blocks").load().count()


def test_stream(spark, folders, tmp_path):
    """Files are taken once, over restarts, and old ones too that are moved in late."""
    import os

    spark.dataSource.register(datasource.DocumentBlocks)
    place = {n: str(tmp_path / n) for n in ("log", "rows", "checkpoint")}

    def run():
        rows = spark.readStream.format("document_blocks").options(source=str(folders[0]), log=place["log"], bytes="20").load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", place["checkpoint"]).trigger(processingTime="0 seconds").start(place["rows"])
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.read.schema(datasource.SCHEMA).parquet(place["rows"])

    first = sorted(map(str, run().collect()))
    assert first == sorted(map(str, _reader(spark, folders).load().where("side = 'src'").collect()))
    late = folders[0] / "late.txt"
    late.write_bytes(b"Late.")
    os.utime(late, (1, 1))
    assert sorted(map(str, run().collect())) == sorted([*first, *map(str, run().where("file_name = 'late.txt'").collect())])
    assert [r.text for r in run().where("file_name = 'late.txt'").collect()] == ["Late."]
