"""Comparison of document pairs: sections, then paragraphs, then sentences and table rows, then reconciliation.

Every table is keyed by pair_id, so one plan compares any number of pairs. Each alignment's result is written to the shared
folder before the next stage reads it (several times): no similarity is scored twice, plans stay small, and a lost executor
costs no stage that is done. Texts are in few of these tables: paragraphs as they are (sentences and normalised texts are made
again where they are asked for), and those of items, of paired paragraphs and of rows, which go as soon as the next stage's
are written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import special as S
from variorum.functions import text as T
from variorum.functions.text import NormalizeOptions
from variorum.operators.align import align
from variorum.operators.hierarchy import cut, duplicates, paragraphs, sections, with_sentences
from variorum.schema import TABLE_ROW
from variorum.storage import delete, kept, kept_from, put, put_from

# Thresholds of the five alignments, and the least length that is reconciled.
SECTION, PARAGRAPH, SENTENCE, TABLE, RECONCILE = 0.30, 0.45, 0.45, 0.40, 0.75
RECONCILE_FROM = 8
#: Paragraphs of a section, or its tables, that are numbered together.
STRETCH = 1024
#: Compression of the tables that hold texts.
PACKED = "zstd"


@dataclass(frozen=True)
class CompareOptions:
    normalize: NormalizeOptions = field(default_factory=NormalizeOptions)
    compare_numbers: bool = True
    compare_dates: bool = True
    compare_urls: bool = True
    compare_emails: bool = True

    def kinds(self) -> tuple[str, ...]:
        asked = {"date": self.compare_dates, "url": self.compare_urls, "email": self.compare_emails}
        return tuple(k for k in S.KINDS if asked.get(k, self.compare_numbers))


@dataclass
class Comparison:
    """The tables of a comparison; detail_rows and table_rows are as reconciled."""

    paragraphs: DataFrame
    section_ops: DataFrame
    paragraph_ops: DataFrame
    detail_rows: DataFrame
    table_rows: DataFrame
    stats: DataFrame
    duplicates: DataFrame


def align_sections(paras: DataFrame) -> DataFrame:
    """Section operations with the sections' own columns: sec_op, s_* and o_*, and title, page, slide of the leading side."""
    own = kept(sections(paras), "sections")
    title = F.coalesce("title", F.lit(""))
    items = own.select("pair_id", "side", "idx", F.lower(T.js_trim(title)).alias("key"), F.lower(title).alias("text"))
    ops = align(items.where("side = 'src'").drop("side"), items.where("side = 'out'").drop("side"), ["pair_id"], SECTION)
    side = lambda name, p: own.where(F.col("side") == name).select("pair_id", F.col("idx").alias(f"{name}_idx"), F.col("sec_idx").alias(f"{p}_sec"), *(F.col(c).alias(f"{p}_{c}") for c in ("title", "page", "slide")))
    joined = ops.join(side("src", "s"), ["pair_id", "src_idx"], "left").join(side("out", "o"), ["pair_id", "out_idx"], "left")
    lead = {c: F.when(F.col("src_idx").isNotNull(), F.col(f"s_{c}")).otherwise(F.col(f"o_{c}")) for c in ("title", "page", "slide")}
    return joined.withColumns(lead).withColumnRenamed("op_pos", "sec_op")


def _in_sections(paras: DataFrame, ops: DataFrame, side: str) -> DataFrame:
    """Paragraphs of one side with their section operation (null if their pair has no id)."""
    p = side[0]
    place = ops.where(F.col(f"{p}_sec").isNotNull()).select("pair_id", F.col(f"{p}_sec").alias("sec_idx"), "sec_op", F.col("type").alias("sec_type"))
    return paras.where(F.col("side") == side).drop("side").join(place, ["pair_id", "sec_idx"], "left")


def _among_paragraphs() -> Column:
    """A paragraph's number, from 0, among those of its section that are no table rows."""
    before = Window.partitionBy("pair_id", "side", "sec_idx").orderBy("para_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.count_if(F.col("type") != TABLE_ROW).over(before) - 1).cast("int")


def _numbered(df: DataFrame, scope: list[str], order: str) -> DataFrame:
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*scope).orderBy(order)) - 1)


_SCOPE = ["pair_id", "sec_op"]


def _pair_up(ops: DataFrame, src: DataFrame, out: DataFrame, scope: list[str], columns: list[str]) -> DataFrame:
    """Operations with columns of both sides, as s_* and o_*."""
    side = lambda df, name: df.select(*scope, F.col("idx").alias(f"{name}_idx"), *(F.col(c).alias(f"{name[0]}_{c}") for c in columns))
    return ops.join(side(src, "src"), [*scope, "src_idx"], "left").join(side(out, "out"), [*scope, "out_idx"], "left")


def _alignable(df: DataFrame) -> DataFrame:
    return df.where((F.col("type") != TABLE_ROW) & F.col("sec_type").isin("match", "modify"))


def _items(df: DataFrame) -> DataFrame:
    return _alignable(df).select(*_SCOPE, "idx", F.col("normalized_text").alias("key"))


def align_paragraphs(src: DataFrame, out: DataFrame) -> DataFrame:
    """Operations on the items of both sides."""
    return align(*(df.withColumn("text", F.col("key")) for df in (src, out)), _SCOPE, PARAGRAPH, positional_fallback=True)


def _with_paragraphs(ops: DataFrame, src: DataFrame, out: DataFrame) -> DataFrame:
    """Operations on paragraphs with both sides' texts."""
    return _pair_up(ops, _alignable(src), _alignable(out), _SCOPE, ["paragraph_number", "original_text"]).withColumnRenamed("op_pos", "para_op")


def _no_special() -> Column:
    return F.lit(None).cast("struct<" + ",".join(f"{k}:struct<added:array<string>,removed:array<string>>" for k in S.KINDS) + ">")


_DETAIL = ["pair_id", "sec_op", "para_op", "sub", "status", "paragraph_number", "sentence_number", "source_text", "output_text", "special", "comments"]


def _detail(df: DataFrame, status: Column | str, source: Column, output: Column, sub: Column, sentence: Column, special: Column, comments: Column) -> DataFrame:
    return df.select("pair_id", "sec_op", "para_op", sub.cast("int").alias("sub"), (F.lit(status) if isinstance(status, str) else status).alias("status"), F.coalesce("s_paragraph_number", "o_paragraph_number").alias("paragraph_number"), sentence.cast("int").alias("sentence_number"), source.alias("source_text"), output.alias("output_text"), special.alias("special"), comments.alias("comments"))


def align_sentences(para_ops: DataFrame, opts: CompareOptions) -> DataFrame:
    """Operations on the sentences of modified paragraphs that have a likeness (none of those paired by position)."""
    scope = [*_SCOPE, "para_op"]
    modified = para_ops.where("type = 'modify' and score <> 0")
    both = [kept(modified.select(*scope, F.posexplode(cut(F.col(f"{p}_original_text"), opts.normalize)).alias("idx", "s")).select(*scope, "idx", F.col("s.normalized").alias("key"), F.col("s.normalized").alias("text"), F.col("s.original").alias("original"), (F.col("idx") + 1).alias("number")), "sentence-items", codec=PACKED) for p in "so"]
    ops = align(*(b.select(*scope, "idx", "key", "text") for b in both), scope, SENTENCE)
    return _pair_up(kept(ops, "sentence-ops"), *both, scope, ["original", "number"])


def _status(kind: Column) -> Column:
    return F.when(kind == "match", "match").when(kind == "delete", "missing").when(kind == "insert", "added").otherwise("modified")


def detail_rows(src: DataFrame, out: DataFrame, para_ops: DataFrame, opts: CompareOptions) -> DataFrame:
    """The rows of paragraphs and sentences, with their place in the traversal (sec_op, para_op, sub)."""
    none, blank = F.lit(None), F.lit("")
    whole = []
    for df, kind, status, comment in ((src, "delete", "missing", "Entire section removed"), (out, "insert", "added", "Entire section added")):
        gone = df.where((F.col("type") != TABLE_ROW) & (F.col("sec_type") == kind)).select("pair_id", "sec_op", F.col("para_pos").alias("para_op"), F.col("paragraph_number").alias("s_paragraph_number"), F.lit(None).cast("int").alias("o_paragraph_number"), "original_text")
        text = F.col("original_text")
        whole.append(_detail(gone, status, text if kind == "delete" else blank, blank if kind == "delete" else text, F.lit(0), none, _no_special(), F.lit(comment)))
    matched = para_ops.where("type = 'match'").withColumn("_others", T.split_sentences(F.col("o_original_text"))).select("*", F.posexplode(T.split_sentences(F.col("s_original_text"))).alias("_i", "_s"))
    other = F.coalesce(F.get(F.col("_others"), F.col("_i")), F.col("_s"))
    same = _detail(matched, "match", F.col("_s"), other, F.col("_i"), F.col("_i") + 1, _no_special(), blank)
    single = para_ops.where("type in ('delete', 'insert') or (type = 'modify' and score = 0)")
    replaced = F.when(F.col("type") == "modify", F.lit("Content replaced")).otherwise(blank)
    alone = _detail(single, _status(F.col("type")), F.coalesce("s_original_text", blank), F.coalesce("o_original_text", blank), F.lit(0), none, _no_special(), replaced)
    parts = align_sentences(para_ops, opts).join(para_ops.where("type = 'modify' and score <> 0").select("pair_id", "sec_op", "para_op", "s_paragraph_number", "o_paragraph_number", "s_original_text", "o_original_text"), ["pair_id", "sec_op", "para_op"])
    special = F.when(F.col("type") == "modify", S.changes(F.col("s_original"), F.col("o_original"), opts.kinds()))
    parts = parts.withColumn("special", special)
    # A sentence that only one side has: the other side shows its paragraph.
    fine = _detail(parts, _status(F.col("type")), F.coalesce("s_original", "s_original_text"), F.coalesce("o_original", "o_original_text"), F.col("op_pos"), F.coalesce("s_number", "o_number"), F.col("special"), F.coalesce(S.summary(F.col("special")), blank))
    rows = whole[0]
    for df in (whole[1], same, alone, fine):
        rows = rows.unionByName(df)
    return rows


def local_table_ids(rows: DataFrame) -> DataFrame:
    """table_rank: tables of a section in order of their first row."""
    table = F.when(F.coalesce("table_id", F.lit("")) == "", F.lit("table")).otherwise(F.col("table_id"))
    first = F.min("para_pos").over(Window.partitionBy(*_SCOPE, "_table"))
    ranked = rows.withColumn("_table", table).withColumn("_first", first)
    return ranked.withColumn("table_rank", F.dense_rank().over(Window.partitionBy(*_SCOPE).orderBy("_first")) - 1).drop("_table", "_first")


def diff_cells(src: Column, out: Column) -> Column:
    """array<struct<cell_index, src_text, out_text, status, note>>, by position."""
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in (src, out))
    n = F.greatest(F.size(a), F.size(b))

    def cell(i: Column) -> Column:
        s, o = F.coalesce(F.get(a, i), F.lit("")), F.coalesce(F.get(b, i), F.lit(""))
        status = F.when(s == o, "match").when(s == "", "added").when(o == "", "missing").otherwise("modified")
        return F.struct(i.alias("cell_index"), s.alias("src_text"), o.alias("out_text"), status.alias("status"), F.lit(None).cast("string").alias("note"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), cell)).otherwise(F.array().cast("array<struct<cell_index:int,src_text:string,out_text:string,status:string,note:string>>"))


def table_rows(src: DataFrame, out: DataFrame, opts: CompareOptions) -> DataFrame:
    """Rows of tables in sections that match or are modified, aligned within tables of one local id."""
    scope = [*_SCOPE, "table_rank"]
    both = [kept(_numbered(local_table_ids(df.where((F.col("type") == TABLE_ROW) & F.col("sec_type").isin("match", "modify"))), scope, "para_pos").withColumn("normalized_text", T.normalize(F.col("original_text"), opts.normalize)), "table-items", codec=PACKED) for df in (src, out)]
    ops = align(*(df.select(*scope, "idx", F.col("normalized_text").alias("key"), F.col("normalized_text").alias("text")) for df in both), scope, TABLE)
    rows = _pair_up(ops, *both, scope, ["original_text", "cells"])
    diffs = F.when(F.col("type") == "modify", diff_cells(F.col("s_cells"), F.col("o_cells"))).otherwise(diff_cells(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")))
    rows = rows.withColumn("cell_diffs", diffs)
    changed = F.exists("cell_diffs", lambda c: c["status"] != "match")
    status = F.when(F.col("type") == "modify", F.when(changed, "modified").otherwise("match")).otherwise(_status(F.col("type")))
    return rows.select("pair_id", "sec_op", "table_rank", "op_pos", F.concat(F.lit("t"), F.col("table_rank").cast("string")).alias("table_id"), status.alias("status"), F.coalesce("s_original_text", F.lit("")).alias("source_text"), F.coalesce("o_original_text", F.lit("")).alias("output_text"), "cell_diffs", F.lit("").alias("comments"))


def with_block_ids(details: DataFrame, tables: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One running number over both kinds of rows in traversal order, and the sections' title, page and slide.

    Rows are counted by stretches of a section; a scan over a pair's counts says where each stretch's numbers start, and rows
    are numbered within stretches. So no task holds all rows of a pair.
    """
    where = ops.select("pair_id", "sec_op", F.coalesce("title", F.lit("")).alias("section"), "page", "slide")
    places = details.select("pair_id", "sec_op", F.lit(0).alias("kind"), F.col("para_op").alias("p"), F.col("sub").alias("q")).unionByName(tables.select("pair_id", "sec_op", F.lit(1).alias("kind"), F.col("table_rank").alias("p"), F.col("op_pos").alias("q")))
    stretch = ["pair_id", "sec_op", "kind", "stretch"]
    places = places.withColumn("stretch", F.floor(F.col("p") / STRETCH).cast("int"))
    counts = places.groupBy(*stretch).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy("pair_id").orderBy("sec_op", "kind", "stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    nth = F.row_number().over(Window.partitionBy(*stretch).orderBy("p", "q"))
    numbered = places.withColumn("_nth", nth).join(starts, stretch).withColumn("block_id", (F.coalesce("_start", F.lit(0)) + F.col("_nth")).cast("int")).drop("stretch", "_nth", "_start")
    ids = numbered.join(where, ["pair_id", "sec_op"])
    d = details.join(ids.where("kind = 0").drop("kind").withColumnsRenamed({"p": "para_op", "q": "sub"}), ["pair_id", "sec_op", "para_op", "sub"])
    t = tables.join(ids.where("kind = 1").drop("kind").withColumnsRenamed({"p": "table_rank", "q": "op_pos"}), ["pair_id", "sec_op", "table_rank", "op_pos"])
    d = d.select("pair_id", "block_id", "section", "page", "slide", "paragraph_number", "sentence_number", "status", "source_text", "output_text", "special", "comments")
    t = t.select("pair_id", "block_id", "section", "page", "slide", "table_id", "status", "source_text", "output_text", "cell_diffs", "comments")
    return d, t


def reconcile(details: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relabels missing and added content that reappears elsewhere in the pair as reformatted.

    Both row tables, and (pair_id, reconciled): how many pairs of units were found.
    """
    label = lambda is_table: T.location_label(F.col("section"), F.col("page"), F.col("slide"), F.lit(is_table))
    unit = lambda df, cell, status, s, o, is_table, order: df.select("pair_id", order.alias("part"), "block_id", cell.alias("cell"), status.alias("status"), F.when(status == "missing", s).otherwise(o).alias("unit_text"), label(is_table).alias("location")).where(F.col("status").isin("missing", "added"))
    source, output = F.col("source_text"), F.col("output_text")
    cells = tables.select("pair_id", "block_id", "section", "page", "slide", F.explode("cell_diffs").alias("c"))
    pool = (
        unit(details, F.lit(-1), F.col("status"), source, output, False, F.lit(0))
        .unionByName(unit(tables, F.lit(-1), F.col("status"), source, output, True, F.lit(1)))
        .unionByName(unit(cells, F.col("c.cell_index"), F.col("c.status"), F.col("c.src_text"), F.col("c.out_text"), True, F.lit(1)))
    )
    pool = pool.withColumn("key", T.reconcile_key(F.col("unit_text"))).where(F.length("key") >= RECONCILE_FROM)
    pool = pool.withColumn("idx", F.row_number().over(Window.partitionBy("pair_id", "status").orderBy("part", "block_id", "cell")) - 1)

    def pairs() -> DataFrame:
        units = kept(pool, "reconcile-pool", codec=PACKED)
        missing, added = units.where("status = 'missing'"), units.where("status = 'added'")
        items = [df.select("pair_id", "idx", "key", F.col("key").alias("text")) for df in (missing, added)]
        found = align(*items, ["pair_id"], RECONCILE).where("type in ('match', 'modify')")
        return _pair_up(found, missing, added, ["pair_id"], ["part", "block_id", "cell", "unit_text", "location"])

    both = kept_from(details.sparkSession, "reconciled", pairs, PACKED)
    told = lambda mine, other: both.select("pair_id", *(F.col(f"{mine}_{c}").alias(c) for c in ("part", "block_id", "cell")), F.col(f"{other}_unit_text").alias("other_text"), F.concat(F.lit("Reformatted — matching content found in "), F.col(f"{other}_location")).alias("note"))
    marks = told("s", "o").unionByName(told("o", "s"))

    def relabel(df: DataFrame, part: int) -> DataFrame:
        own = marks.where((F.col("part") == part) & (F.col("cell") == -1)).drop("part", "cell")
        j = df.join(own, ["pair_id", "block_id"], "left")
        hit = F.col("note").isNotNull()
        new = {
            "status": F.when(hit, "reformatted").otherwise(F.col("status")),
            "source_text": F.when(hit & (F.col("status") == "added"), F.col("other_text")).otherwise(source),
            "output_text": F.when(hit & (F.col("status") == "missing"), F.col("other_text")).otherwise(output),
            "comments": F.when(hit, T.append_comment(F.col("comments"), F.col("note"))).otherwise(F.col("comments")),
        }
        return j.withColumns(new).select(df.columns)

    by_cell = marks.where("cell >= 0").groupBy("pair_id", "block_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("other_text", "note")))).alias("_cells"))
    t = relabel(tables, 1).join(by_cell, ["pair_id", "block_id"], "left")

    def cell(c: Column) -> Column:
        mark = F.col("_cells")[c["cell_index"]]
        hit = mark.isNotNull()
        return F.struct(
            c["cell_index"].alias("cell_index"),
            F.when(hit & (c["status"] == "added"), mark["other_text"]).otherwise(c["src_text"]).alias("src_text"),
            F.when(hit & (c["status"] == "missing"), mark["other_text"]).otherwise(c["out_text"]).alias("out_text"),
            F.when(hit, F.lit("reformatted")).otherwise(c["status"]).alias("status"),
            F.when(hit, mark["note"]).otherwise(c["note"]).alias("note"),
        )

    t = t.withColumn("cell_diffs", F.when(F.col("_cells").isNull(), F.col("cell_diffs")).otherwise(F.transform("cell_diffs", cell))).select(tables.columns)
    return relabel(details, 0), t, both.groupBy("pair_id").agg(F.count("*").alias("reconciled"))


def match_percentage(matched: Column, modified: Column, missing: Column, added: Column) -> Column:
    total = (matched + modified + missing + added).cast("double")
    return F.when(total == 0, F.lit(100.0)).otherwise(F.floor(matched / total * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0))


def stats(pairs: DataFrame, src: DataFrame, out: DataFrame, ops: DataFrame, para_ops: DataFrame, details: DataFrame, tables: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Counts per pair. details and tables: before reconciliation, whose count moves missing and added to reformatted."""
    in_whole = src.where("sec_type = 'delete'").select("pair_id").unionByName(out.where("sec_type = 'insert'").select("pair_id"))
    rows = details.select("pair_id", "status", F.lit(1).alias("sentence")).unionByName(tables.select("pair_id", "status", F.lit(0).alias("sentence")))
    counted = rows.groupBy("pair_id").agg(F.sum("sentence").alias("total_sentences"), *(F.count_if(F.col("status") == s).alias(name) for s, name in (("match", "matched"), ("modified", "modified"), ("missing", "missing"), ("added", "added"))))
    n = lambda df, name: df.groupBy("pair_id").agg(F.count("*").alias(name))
    told = pairs
    for df in (n(ops, "total_sections"), n(in_whole, "_whole"), n(para_ops, "_ops"), counted, reconciled):
        told = told.join(df, "pair_id", "left")
    told = told.na.fill(0)
    less = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("reconciled"))
    told = told.select("pair_id", "total_sections", (F.col("_whole") + F.col("_ops")).alias("total_paragraphs"), "total_sentences", "matched", "modified", less("missing").alias("missing"), less("added").alias("added"), (F.col("reconciled") * 2).alias("reformatted"))
    return told.select(*(F.col(c).cast("long").alias(c) for c in told.columns), match_percentage(*(F.col(c) for c in ("matched", "modified", "missing", "added"))).alias("match_percentage"))


def compare_documents(blocks: DataFrame, opts: CompareOptions = CompareOptions()) -> Comparison:
    """Compares the two sides of every pair in a table of blocks (see schema.BLOCKS)."""
    spark = blocks.sparkSession
    columns = [c for c in paragraphs(blocks, opts.normalize).columns if c != "sentences"]
    paras, path = put(paragraphs(blocks, opts.normalize).select(columns).withColumn("idx", _among_paragraphs()), "paragraphs", ["side"], PACKED)
    ops = kept_from(spark, "section-ops", lambda: align_sections(paras))
    sides, items = [], []
    for side in ("src", "out"):
        own = _in_sections(paras, ops, side)
        sides.append(kept(own.drop("normalized_text"), f"paragraphs-{side}", codec=PACKED))
        items.append(put(_items(own), "paragraph-items", codec=PACKED))
        delete(spark, f"{path}/side={side}")
    src, out = sides
    para_ops = kept_from(spark, "paragraph-ops", lambda: align_paragraphs(*(df for df, _ in items)))
    for _, done in items:
        delete(spark, done)
    details, before = put_from(spark, "details", lambda: detail_rows(src, out, kept(_with_paragraphs(para_ops, src, out), "paragraph-pairs", codec=PACKED), opts), PACKED)
    tables, tables_before = put_from(spark, "tables", lambda: table_rows(src, out, opts), PACKED)
    details, tables = (kept(df, name, codec=PACKED) for df, name in zip(with_block_ids(details, tables, ops), ("detail-rows", "table-rows"), strict=True))
    for done in (before, tables_before):
        delete(spark, done)
    new_details, new_tables, reconciled = reconcile(details, tables)
    pairs = blocks.select("pair_id").distinct()
    paras = src.withColumn("side", F.lit("src")).unionByName(out.withColumn("side", F.lit("out"))).withColumn("normalized_text", T.normalize(F.col("original_text"), opts.normalize))
    paras = with_sentences(paras.select(columns), opts.normalize)
    both = _with_paragraphs(para_ops, src, out).withColumns({f"{p}_sentences": F.when(F.col(f"{p}_original_text").isNotNull(), cut(F.col(f"{p}_original_text"), opts.normalize)) for p in "so"})
    return Comparison(paras, ops, both, new_details, new_tables, stats(pairs, src, out, ops, para_ops, details, tables, reconciled), duplicates(paras))
