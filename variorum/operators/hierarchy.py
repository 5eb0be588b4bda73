"""Blocks to the hierarchy of sections, paragraphs and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.functions.text import NormalizeOptions
from variorum.schema import TABLE_ROW


def flatten(documents: DataFrame) -> DataFrame:
    """Rows (pair_id, side, sections) to a row per block."""
    sections = documents.select("pair_id", "side", F.posexplode("sections").alias("sec_idx", "s"))
    return sections.select("pair_id", "side", "sec_idx", "s.title", "s.page", "s.slide", F.posexplode("s.blocks").alias("block_idx", "b")).select(
        "pair_id", "side", "sec_idx", "title", "page", "slide", "block_idx", "b.type", "b.text", "b.cells", "b.table_id", "b.row_index"
    )


def cut(text: Column, opts: NormalizeOptions = NormalizeOptions()) -> Column:
    """array<struct<original, normalized>> of the sentences of a text."""
    return F.transform(T.split_sentences(text), lambda s: F.struct(s.alias("original"), T.normalize(s, opts).alias("normalized")))


def _sentences(text: Column, opts: NormalizeOptions) -> Column:
    own = F.array(F.struct(text.alias("original"), F.col("normalized_text").alias("normalized")))
    return F.when(F.col("type") == TABLE_ROW, own).otherwise(cut(text, opts))


def with_sentences(paras: DataFrame, opts: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """Paragraphs whose sentences were left out, with them."""
    return paras.withColumn("sentences", _sentences(F.col("original_text"), opts))


def paragraphs(blocks: DataFrame, opts: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """Paragraphs with their sentences (array<struct<original, normalized>>).

    Blocks are dropped first by their raw text, type and place, then numbered, then dropped if nothing is left of them
    when normalised; so numbers may have gaps. para_pos is the order in the section; sections left empty vanish.
    """
    section = Window.partitionBy("pair_id", "side", "sec_idx")
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = blocks.withColumn("_n", F.count("*").over(section)) if opts.ignore_headers or opts.ignore_footers else blocks
    if opts.ignore_blank_lines:
        kept = kept.where(T.js_trim(text) != "")
    if opts.ignore_headers or opts.ignore_footers:
        marginal = (F.col("type") != TABLE_ROW) & (F.length(T.js_trim(text)) <= T.HEADER_FOOTER_LENGTH) & ~T.js_trim(text).rlike(r"[.!?]$")
        if opts.ignore_headers:
            kept = kept.where((F.col("type") != "heading") & ~(marginal & (F.col("block_idx") == 0)))
        if opts.ignore_footers:
            kept = kept.where(~(marginal & (F.col("block_idx") == F.col("_n") - 1)))
    numbered = kept.drop("_n").withColumn("paragraph_number", F.row_number().over(section.orderBy("block_idx"))).withColumn("normalized_text", T.normalize(text, opts))
    if opts.ignore_blank_lines:
        numbered = numbered.where("normalized_text <> ''")
    return numbered.withColumn("para_pos", F.row_number().over(section.orderBy("block_idx")) - 1).select(
        "pair_id", "side", "sec_idx", "title", "page", "slide", "para_pos", "paragraph_number", "type",
        text.alias("original_text"), "normalized_text", "cells", "table_id", "row_index",
        _sentences(text, opts).alias("sentences"),
    )


def counts(paras: DataFrame) -> DataFrame:
    """Paragraphs and sentences of each pair. Sentences are cut but not normalised, as only their number is asked for."""
    number = F.when(F.col("type") == TABLE_ROW, 1).otherwise(F.size(T.split_sentences(F.col("original_text"))))
    return paras.groupBy("pair_id").agg(F.count("*").alias("paragraphs"), F.sum(number).cast("long").alias("sentences"))


def sentences(paras: DataFrame) -> DataFrame:
    """A row per sentence."""
    return paras.select("pair_id", "side", "sec_idx", "para_pos", F.posexplode("sentences").alias("_i", "s")).select(
        "pair_id", "side", "sec_idx", "para_pos", (F.col("_i") + 1).alias("sentence_number"), F.col("s.original").alias("original_text"), F.col("s.normalized").alias("normalized_text")
    )


def sections(paras: DataFrame) -> DataFrame:
    """Sections that have a paragraph, renumbered from 0 (idx) in their order."""
    some = paras.groupBy("pair_id", "side", "sec_idx").agg(F.first("title").alias("title"), F.first("page").alias("page"), F.first("slide").alias("slide"))
    return some.withColumn("idx", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("sec_idx")) - 1)


def duplicates(paras: DataFrame, least: int = 8) -> DataFrame:
    """Every repeat of a paragraph within its document after the first, with the first one's place."""
    place = F.struct("title", "page", "slide", "paragraph_number")
    same = Window.partitionBy("pair_id", "side", "normalized_text").orderBy("sec_idx", "para_pos")
    long = paras.where((F.col("type") != TABLE_ROW) & (F.length("normalized_text") >= least))
    ranked = long.withColumns({"_n": F.row_number().over(same), "first_location": F.first(place).over(same)})
    return ranked.where("_n > 1").select("pair_id", "side", "sec_idx", "para_pos", F.col("original_text").alias("text"), "first_location", place.alias("location"))
