"""Files of all kinds, by extension, to a table of blocks; files that can't be parsed keep their error.

Text files are parsed by expressions, markup and packages by a parser in the tasks. Of PDF files, the glyph extraction is
another program's: its table of positioned items (see pdf.lines) is read in the files' place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators.hierarchy import flatten
from variorum.schema import BLOCK_COLUMNS, RAW_DOCUMENT
from variorum.sources import html, ooxml, pdf
from variorum.sources import text as X

_SECTIONS = RAW_DOCUMENT.partition("sections ")[2]
PARSED = f"pair_id long, side string, {RAW_DOCUMENT}, parse_error string"
#: Classes of errors: the request is wrong, or the file can't be read. They begin parse_error.
EMPTY, UNSUPPORTED, UNREADABLE, AMBIGUOUS = "Empty file", "Unsupported file type", "Could not parse", "More than one file"


def _html(data: bytes) -> list[dict]:
    return [{"title": title, "page": None, "slide": None, "blocks": found} for title, found in html.parse(data.decode("utf-8", "replace"))]


def text_sections(data: bytes) -> list[dict]:
    """A text as its parser gives it, outside of Spark's expressions: blocks are what blank lines separate."""
    parts = (" ".join(re.split(r"\r?\n", b)).strip(T.WS_CHARACTERS) for b in re.split(rf"\r?\n{T.WS}*\r?\n", data.decode("utf-8", "replace")))
    return [{"title": "Document", "page": None, "slide": None, "blocks": [{"type": "paragraph", "text": b, "cells": None, "table_id": None, "row_index": None} for b in parts if b]}]


PARSERS = {"html": _html, "htm": _html, "docx": ooxml.docx, "pptx": ooxml.pptx}


def parsed(name: str, data: bytes | None) -> tuple[list[dict], str | None]:
    """Sections of one file, or what is wrong with it, outside of Spark's expressions."""
    kind = name.rpartition(".")[2].lower() if "." in name else ""
    if not data:
        return [], EMPTY
    if kind != "txt" and kind not in PARSERS:
        return [], f"{UNSUPPORTED}: .{kind}"
    try:
        return (text_sections if kind == "txt" else PARSERS[kind])(bytes(data)), None
    except Exception as e:  # noqa: BLE001  whatever a broken file provokes is its result
        return [], f"{UNREADABLE} {name}: {type(e).__name__}: {e}"


_COLUMNS = ["pair_id", "side", "doc_type", "file_name", "sections", "parse_error"]


def parse_documents(files: DataFrame) -> DataFrame:
    """pair_id, side, file_name and content (binary) to documents with sections, or a parse_error of one of the classes above.

    A column `wrong`, if there is one, holds errors known before.
    """
    before = F.col("wrong") if "wrong" in files.columns else F.lit(None).cast("string")
    known = files.select("pair_id", "side", T.file_extension(F.col("file_name")).alias("doc_type"), "file_name", "content", before.alias("wrong"))
    empty = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
    supported = F.col("doc_type").isin("txt", *PARSERS)
    items = "A PDF is read from its table of items"
    wrong = F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(empty, EMPTY).when(F.col("doc_type") == "pdf", f"{UNSUPPORTED}: .pdf. {items}").when(~supported, F.concat(F.lit(f"{UNSUPPORTED}: ."), "doc_type"))
    checked = known.withColumn("parse_error", wrong).drop("wrong")
    nothing = F.array().cast(_SECTIONS)
    bad = checked.where("parse_error is not null").withColumn("sections", nothing)
    plain = checked.where("parse_error is null and doc_type = 'txt'").withColumn("sections", X.sections(F.make_valid_utf8(F.col("content").cast("string"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pair, side, kind, name, data in batch.itertuples(index=False):
                try:
                    rows.append((pair, side, kind, name, PARSERS[kind](bytes(data)), None))
                except Exception as e:  # noqa: BLE001  whatever a broken file provokes is its result
                    rows.append((pair, side, kind, name, [], f"{UNREADABLE} {name}: {type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    rest = checked.where(F.col("parse_error").isNull() & F.col("doc_type").isin(*PARSERS)).drop("parse_error").mapInPandas(run, PARSED)
    return bad.select(_COLUMNS).unionByName(plain.select(_COLUMNS)).unionByName(rest)


def read_pairs(spark: SparkSession, source: str, output: str) -> DataFrame:
    """Documents of two folders and all below them; files of one relative path (without extension) are a pair.

    Where a folder has more than one file of a path, as with different extensions, none of them is read: each has an error
    that says so. Spark's reader passes over files of no bytes; datasource.DocumentBlocks tells of them.
    """

    def side(path: str, name: str) -> DataFrame:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        root = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        relative = F.expr("substring(regexp_replace(path, '^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?', ''), " + str(len(root) + 2) + ")")
        return found.select(pair_of(relative).alias("pair_id"), F.lit(name).alias("side"), relative.alias("file_name"), "content")

    return parse_documents(one_of_each(side(source, "src").unionByName(side(output, "out"))))


def one_of_each(files: DataFrame) -> DataFrame:
    """files with `wrong`, an error of those that share their pair and side. Only names are shuffled for it, no contents."""
    several = files.groupBy("pair_id", "side").agg(F.count("*").alias("_n"), F.min("file_name").alias("_a"), F.max("file_name").alias("_b")).where("_n > 1")
    wrong = F.when(F.col("_n").isNotNull(), F.concat(F.lit(f"{AMBIGUOUS}: "), "_a", F.lit(", "), "_b"))
    return files.join(several, ["pair_id", "side"], "left").withColumn("wrong", wrong).drop("_n", "_a", "_b")


def pair_of(file_name: Column) -> Column:
    """The pair that a file belongs to: a hash of its path without extension."""
    return F.xxhash64(F.regexp_replace(file_name, r"\.[^./]*$", ""))


def blocks(documents: DataFrame) -> DataFrame:
    return flatten(documents.where("parse_error is null"))


def pdf_blocks(items: DataFrame) -> DataFrame:
    """Items of PDF files (file_name, side, page, str, x, y, width) to the table of blocks that blocks() gives: a section per page."""
    keyed = items.select(pair_of(F.col("file_name")).alias("pair_id"), "side", "page", "str", "x", "y", "width")
    keys = ("pair_id", "side", "page")
    found = pdf.blocks(pdf.lines(keyed, keys), keys)
    page = F.col("page").cast("int")
    return found.select("pair_id", "side", (page - 1).alias("sec_idx"), F.concat(F.lit("Page "), page.cast("string")).alias("title"), page.alias("page"), F.lit(None).cast("int").alias("slide"), F.col("block_no").cast("int").alias("block_idx"), "type", "text", "cells", "table_id", "row_index").select(BLOCK_COLUMNS)
