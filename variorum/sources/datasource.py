"""Folders of files as a data source: blocks of all files below them, in batches or as a stream.

    spark.dataSource.register(DocumentBlocks)
    spark.read.format("document_blocks").option("source", old).option("output", new).load()
    spark.readStream.format("document_blocks").option("source", inbox).option("log", shared_folder).load()

A row is a block, with the side and the path of its file below its folder; a file that can't be parsed has one row with its
parse_error, a file without blocks has none. Folders are given for one side or both, as URIs that every executor can open.

Files are dealt to tasks by their bytes (option `bytes`, 64 MB), names are all that is planned with. Filters on side and
file_name drop files before any is opened with the option `pushdown` (and spark.sql.python.filterPushdown.enabled, without
which Spark gives a Python source none). Of the columns, those of a
schema that is given are made, and no others (Spark doesn't tell a Python source what a query selects).

A stream takes each file once, by its path and whatever its time: the files of a batch are listed in the folder `log`, which
has to stay as long as the checkpoint does. Files should be moved into the folder whole; one that has gone when its batch is
read is unreadable. As with pairs read in batches, where a folder has more than one file of a path without extension, each
has an error that says so; a stream says it of those that are listed by then.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from variorum.schema import BLOCK_COLUMNS
from variorum.sources import files

SCHEMA = "side string, file_name string, bytes long, sec_idx int, title string, page int, slide int, block_idx int, type string, text string, cells array<string>, table_id string, row_index int, parse_error string"
#: Bytes of files that a task reads, blocks that it gives at once.
BYTES, BATCH = 64 << 20, 2_000


@dataclass(frozen=True)
class File:
    side: str
    file_name: str
    path: str
    bytes: int
    wrong: str | None = None


@dataclass
class Share(InputPartition):
    """Files of a task."""

    files: list[File]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def found(folders: dict[str, str]) -> list[File]:
    """All files below the folders of the sides, in order; those that share a side and a path without extension are wrong."""
    out = []
    for side, folder in folders.items():
        system, root = _place(folder)
        root = root.rstrip("/")
        below = system.get_file_info(fs.FileSelector(root, recursive=True))
        named = [(i.path[len(root) + 1 :], i) for i in below if i.type == fs.FileType.File]
        # Hidden files are no documents.
        out += [File(side, name, i.path, i.size) for name, i in named if not any(p.startswith((".", "_")) for p in name.split("/"))]
    return sorted(out, key=lambda f: (f.side, f.file_name))


def marked(listed: list[File]) -> list[File]:
    """listed, with errors of what can't be told apart."""
    stem = lambda f: (f.side, f.file_name[: len(f.file_name) - len(os.path.splitext(f.file_name)[1])])
    count = Counter(map(stem, listed))
    return [f if count[stem(f)] == 1 else File(f.side, f.file_name, f.path, f.bytes, f"{files.AMBIGUOUS}: {f.file_name}") for f in listed]


def shares(listed: Iterable[File], most: int) -> list[Share]:
    """listed in order, cut before `most` bytes are exceeded; a larger file has a share of its own."""
    out, held = [], 0
    for f in listed:
        if not out or held + f.bytes > most:
            out.append(Share([]))
            held = 0
        out[-1].files.append(f)
        held += f.bytes
    return out


class _Reading:
    """What batches and streams share."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.folders = {side: options[name] for side, name in (("src", "source"), ("out", "output")) if name in options}
        if not self.folders:
            raise ValueError("option source or output is asked for")
        self.most, self.schema = int(options.get("bytes", BYTES)), schema

    def _rows(self, f: File, systems: dict[str, fs.FileSystem]) -> Iterator[dict]:
        about = {"side": f.side, "file_name": f.file_name, "bytes": f.bytes}
        sections, error = [], f.wrong
        if error is None:
            try:
                with systems[f.side].open_input_stream(f.path) as of:
                    data = of.read()
            except OSError as e:
                error = f"{files.UNREADABLE} {f.file_name}: {type(e).__name__}: {e}"
            else:
                sections, error = files.parsed(f.file_name, data)
        if error:
            yield about | {"parse_error": error}
        for i, s in enumerate(sections):
            for k, b in enumerate(s["blocks"]):
                yield about | {"sec_idx": i, "title": s["title"], "page": s["page"], "slide": s["slide"], "block_idx": k} | b

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        systems = {side: _place(folder)[0] for side, folder in self.folders.items()}
        columns = to_arrow_schema(self.schema)
        rows: list[dict] = []
        for f in share.files:
            for row in self._rows(f, systems):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=columns)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=columns)


class _Batch(_Reading, DataSourceReader):
    def _wanted(self, file: File) -> bool:  # noqa: ARG002
        return True

    def partitions(self) -> Sequence[Share]:
        # What is wrong is known from all files, wanted or not.
        return shares(filter(self._wanted, marked(found(self.folders))), self.most) or [Share([])]


class _Filtered(_Batch):
    """Apart from _Batch, as Spark refuses a reader that takes filters where its setting is off."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute in (("side",), ("file_name",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, file: File) -> bool:
        for f in self.filters:
            value = getattr(file, f.attribute[0])
            if isinstance(f, EqualTo | In):
                fits = value == f.value if isinstance(f, EqualTo) else value in f.value
            else:
                fits = value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value)
            if not fits:
                return False
        return True


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets are numbers of lists in the log; a list is written under another name and renamed, so it is whole."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        if "log" not in options:
            raise ValueError("option log is asked for: a folder for the lists of files")
        self.system, self.log = _place(options["log"])
        self.system.create_dir(self.log)
        self.known: dict[int, list[File]] = {}

    def _lists(self, upto: int | None = None) -> list[list[File]]:
        """The lists in the log, the first `upto` of them."""
        n = 1
        while upto is None or n <= upto:
            if n not in self.known:
                if self.system.get_file_info(f"{self.log}/{n}.json").type != fs.FileType.File:
                    break
                with self.system.open_input_stream(f"{self.log}/{n}.json") as of:
                    self.known[n] = [File(**f) for f in json.loads(of.read())]
            n += 1
        return [self.known[i] for i in range(1, n)]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"list": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        lists = self._lists()
        seen = {(f.side, f.file_name) for listed in lists for f in listed}
        new = [f for f in marked(found(self.folders)) if (f.side, f.file_name) not in seen]
        if not new:
            return {"list": len(lists)}
        name = f"{self.log}/{len(lists) + 1}.json"
        with self.system.open_output_stream(f"{name}.new") as to:
            to.write(json.dumps([vars(f) for f in new]).encode())
        self.system.move(f"{name}.new", name)
        return {"list": len(lists) + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[Share]:
        listed = self._lists(end["list"])[start["list"] :]
        return shares((f for files_of in listed for f in files_of), self.most) or [Share([])]


class DocumentBlocks(DataSource):
    """Format `document_blocks`."""

    @classmethod
    def name(cls) -> str:
        return "document_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_Filtered if self.options.get("pushdown", "false").lower() == "true" else _Batch)(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options), schema)


def read_blocks(spark: SparkSession, source: str, output: str) -> DataFrame:
    """The blocks of two folders, ready to be compared: files.blocks(files.read_pairs(...)) without a shuffle."""
    spark.dataSource.register(DocumentBlocks)
    rows = spark.read.format(DocumentBlocks.name()).option("source", source).option("output", output).load()
    return rows.where("parse_error is null").withColumn("pair_id", files.pair_of(F.col("file_name"))).select(BLOCK_COLUMNS)
