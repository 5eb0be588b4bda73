"""The engine in SQL: table functions over files and texts, registered with a session.

    variorum.sql.register(spark)
    SELECT * FROM parse_blocks(TABLE(SELECT pair_id, side, file_name, content FROM files))
    SELECT * FROM redline(TABLE(SELECT id, source_text, output_text FROM rows))

Both are polymorphic: the columns that they don't read themselves come back with each row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_BLOCK = StructType().add("sec_idx", IntegerType()).add("title", StringType()).add("page", IntegerType()).add("slide", IntegerType()).add("block_idx", IntegerType()).add("type", StringType()).add("text", StringType()).add("cells", ArrayType(StringType())).add("table_id", StringType()).add("row_index", IntegerType()).add("parse_error", StringType())
_TOKEN = StructType().add("position", IntegerType()).add("token_type", StringType()).add("token", StringType())


def _passed(given: AnalyzeArgument, read: tuple[str, ...], added: StructType) -> AnalyzeResult:
    """The input's columns but those in `read`, then the added ones."""
    names = {f.name for f in given.dataType}
    if not given.isTable or not set(read) <= names:
        raise ValueError(f"a table with {', '.join(read)} is asked for")
    schema = StructType()
    for f in (*(f for f in given.dataType if f.name not in read), *added):
        schema = schema.add(f.name, f.dataType)
    return AnalyzeResult(schema=schema)


def _rest(row: Row, read: tuple[str, ...]) -> list:
    return [v for n, v in row.asDict().items() if n not in read]


class ParseBlocks:
    """Blocks of files (file_name, content) by extension; a file that can't be parsed has one row with its error."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return _passed(files, ("content",), _BLOCK)

    def eval(self, files: Row) -> Iterator[tuple]:
        from variorum.sources.files import parsed

        rest = _rest(files, ("content",))
        sections, error = parsed(files["file_name"] or "", files["content"])
        if error:
            yield (*rest, *[None] * 10, error)
        for i, s in enumerate(sections):
            for k, b in enumerate(s["blocks"]):
                yield (*rest, i, s["title"], s["page"], s["slide"], k, b["type"], b["text"], b["cells"], b["table_id"], b["row_index"], None)


class Redline:
    """Words of the merged redline of source_text and output_text, in order."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return _passed(rows, ("source_text", "output_text"), _TOKEN)

    def eval(self, rows: Row) -> Iterator[tuple]:
        from variorum.functions.similarity import split_words
        from variorum.functions.worddiff import _script

        rest = _rest(rows, ("source_text", "output_text"))
        for i, (kind, word) in enumerate(_script(split_words(rows["source_text"]), split_words(rows["output_text"]))):
            yield (*rest, i, kind, word)


def register(spark: SparkSession) -> None:
    """Makes parse_blocks and redline known to a session's SQL."""
    for name, function in (("parse_blocks", ParseBlocks), ("redline", Redline)):
        spark.udtf.register(name, udtf(function))
