"""Plain text: blocks are separated by blank lines, lines within a block are joined by spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.schema import BLOCK_COLUMNS


def text_blocks(c: Column) -> Column:
    """array<string> of the blocks of a text."""
    joined = F.transform(F.split(F.coalesce(c, F.lit("")), rf"\r?\n{T.WS}*\r?\n"), lambda b: T.js_trim(F.regexp_replace(b, r"\r?\n", " ")))
    return F.filter(joined, lambda b: b != "")


def sections(c: Column) -> Column:
    """A text as a parser gives it: one section, Document, of its blocks."""
    none = {"cells": "array<string>", "table_id": "string", "row_index": "int"}
    block = lambda b: F.struct(F.lit("paragraph").alias("type"), b.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()))
    return F.array(F.struct(F.lit("Document").alias("title"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("slide"), F.transform(text_blocks(c), block).alias("blocks")))


def line_blocks(c: Column) -> Column:
    """Every line a block, for texts without blank lines."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda b: T.js_trim(b) != "")


def blocks(documents: DataFrame, text: str = "text", cut=text_blocks, kind: Column | None = None) -> DataFrame:  # noqa: ANN001
    """pair_id, side and a text column to a table of blocks in one section, Document."""
    exploded = documents.select("pair_id", "side", F.posexplode(cut(F.col(text))).alias("block_idx", "text"))
    return exploded.select(
        "pair_id", "side", F.lit(0).alias("sec_idx"), F.lit("Document").alias("title"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("slide"), "block_idx",
        (F.lit("paragraph") if kind is None else kind).alias("type"), "text", F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("int").alias("row_index"),
    ).select(BLOCK_COLUMNS)
