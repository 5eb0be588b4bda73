"""Reports over a comparison: lists by status, fan-outs of special changes, previews, redlines, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.functions.special import LABELS
from variorum.functions.worddiff import diff_words_merged, trim_around_change

STATUSES = ("match", "modified", "missing", "added", "reformatted")
PREVIEW_CHANGED, PREVIEW_MATCHED = 200, 50
# What comments and change lists say.
TRIMMED, TRIMMED_TOO = "Long sentence trimmed to change context", " (long sentence trimmed to change context)"
_CHANGE_TYPES = LABELS | {"fiscalYear": "Fiscal Year"}
_TABLE_COMMENTS = {"missing": "Table row removed", "added": "Table row added", "modified": "Table row modified"}
_ROW = ["pair_id", "block_id", "section", "page", "slide", "paragraph_number", "sentence_number", "table_id", "status", "source_text", "output_text", "comments"]


def all_rows(details: DataFrame, tables: DataFrame) -> DataFrame:
    """Detail rows and table rows in one table; table rows without a comment get one by their status."""
    comment = F.when(F.coalesce("comments", F.lit("")) != "", F.col("comments"))
    for status, text in _TABLE_COMMENTS.items():
        comment = comment.when(F.col("status") == status, F.lit(text))
    t = tables.withColumns({"comments": comment.otherwise(F.lit("")), "paragraph_number": F.lit(None).cast("int"), "sentence_number": F.lit(None).cast("int")})
    return details.withColumn("table_id", F.lit(None).cast("string")).select(_ROW).unionByName(t.select(_ROW))


def by_status(rows: DataFrame, status: str) -> DataFrame:
    return rows.where(F.col("status") == status)


def special_changes(details: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each kind of special change of a detail row, in the order of kinds."""
    entries = F.array(*(F.when(F.col(f"special.{k}").isNotNull(), F.struct(F.lit(i).alias("kind_no"), F.lit(_CHANGE_TYPES[k]).alias("kind"), F.col(f"special.{k}.removed").alias("removed"), F.col(f"special.{k}.added").alias("added"))) for i, k in enumerate(kinds)))
    return details.where("special is not null and status = 'modified'").select("pair_id", "block_id", "section", F.explode(F.array_compact(entries)).alias("c")).select("pair_id", "block_id", "section", "c.kind_no", "c.kind", "c.removed", "c.added")


def number_changes(details: DataFrame) -> DataFrame:
    return special_changes(details, ("number", "percentage", "currency", "fiscalYear"))


def date_changes(details: DataFrame) -> DataFrame:
    return special_changes(details, ("date",))


def preview(rows: DataFrame) -> DataFrame:
    """Per pair the first changed rows, or the first matched ones if nothing changed."""
    changed = F.col("status") != "match"
    pair = Window.partitionBy("pair_id")
    some = rows.withColumn("_any", F.max(changed).over(pair)).where(F.col("_any") == changed)
    nth = F.row_number().over(pair.orderBy("block_id"))
    return some.withColumn("_n", nth).where(F.col("_n") <= F.when(F.col("_any"), PREVIEW_CHANGED).otherwise(PREVIEW_MATCHED)).drop("_any", "_n")


def section_counts(rows: DataFrame) -> DataFrame:
    """Counts by status of each section, with its first row's place, in order of appearance."""
    name = F.when(F.coalesce("section", F.lit("")) == "", F.lit("(No section)")).otherwise(F.col("section"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    out = rows.groupBy("pair_id", name.alias("section")).agg(F.min("block_id").alias("first_block"), F.min_by("page", "block_id").alias("page"), F.min_by("slide", "block_id").alias("slide"), *counts)
    return out.withColumn("label", T.section_label(F.col("section"), F.col("page"), F.col("slide")))


def to_export(rows: DataFrame) -> DataFrame:
    """The exported columns; long changed texts are cut around the change, which the comment then says."""
    cut = trim_around_change(F.col("source_text"), F.col("output_text"))
    long = F.col("status").isin("modified", "reformatted") & F.col("_cut.trimmed")
    note = F.when(F.coalesce("comments", F.lit("")) == "", F.lit(TRIMMED)).otherwise(F.concat("comments", F.lit(TRIMMED_TOO)))
    return rows.withColumn("_cut", cut).select(
        "pair_id", "block_id", F.coalesce("section", F.lit("")).alias("section"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("page", "slide", "paragraph_number", "sentence_number")),
        F.initcap("status").alias("status"),
        F.when(long, F.col("_cut.source")).otherwise(F.coalesce("source_text", F.lit(""))).alias("source_text"),
        F.when(long, F.col("_cut.output")).otherwise(F.coalesce("output_text", F.lit(""))).alias("output_text"),
        F.when(long, note).otherwise(F.coalesce("comments", F.lit(""))).alias("comments"),
    )


def redline(exported: DataFrame) -> DataFrame:
    """exported with redline: missing all removed, added all added, changed the merged word difference, else equal."""
    one = lambda kind, c: F.array(F.struct(F.lit(kind).alias("type"), F.col(c).alias("text")))
    changed = F.col("status").isin("Modified", "Reformatted")
    # Texts go to the difference only where it is needed.
    merged = diff_words_merged(*(F.when(changed, F.col(c)) for c in ("source_text", "output_text")))
    whole = F.when(F.col("status") == "Missing", one("removed", "source_text")).when(F.col("status") == "Added", one("added", "output_text")).otherwise(one("equal", "source_text"))
    return exported.withColumn("_merged", merged).withColumn("redline", F.when(changed, F.col("_merged")).otherwise(whole)).drop("_merged")


_CARDS = ("total_sections", "total_paragraphs", "total_sentences", "matched", "modified", "missing", "added", "reformatted", "match_percentage")


def summary_cards(stats: DataFrame) -> DataFrame:
    """A row per pair and metric."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in _CARDS)
    return stats.select("pair_id", F.expr(f"stack({len(_CARDS)}, {pairs}) as (metric, value)"))


def column_width(longest: Column, header: str) -> Column:
    """Width of an exported column from the longest of its values (each counted up to 60)."""
    return T.clamp(F.greatest(longest, F.lit(len(header) + 2)) + 2, 10, 62)
