"""More queries of the comparison engine, with DuckDB SQL: files and packages, words on pages, labels, lists and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum import catalog as K
from variorum import oracles as O
from variorum import packages, sql
from variorum import pairs as P
from variorum.catalog import _ORDERS, _query, _sql_matches, _sql_minus, _with
from variorum.functions import special, worddiff
from variorum.functions import text as T
from variorum.operators import align as A
from variorum.operators import hierarchy as H
from variorum.plans import compare as C
from variorum.plans import report as R
from variorum.sources import datasource, files, pdf
from variorum.sources import text as X
from variorum.storage import kept, new_folder

# The lines of a turn as a package holds them: white space collapsed.
_TURN_LINES = r"SELECT conv_id, turn, role, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS ls FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL"
_NUMBERED = "SELECT conv_id AS pair_id, sec_idx, CAST(row_number() OVER (PARTITION BY conv_id, sec_idx ORDER BY part, i) - 1 AS INTEGER) AS block_idx, title, slide, type, text FROM b"
_EACH = "unnest(list_transform(range(len(ls)), lambda i: {'i': i, 's': ls[i + 1]}))"
_BLOCKS = ["pair_id", "sec_idx", "block_idx", "title", "slide", "type", "text"]


def _package_blocks(spark: SparkSession, sf_dir: str, extension: str) -> DataFrame:
    made = packages.of_conversations(P.table(spark, sf_dir, "conversations"), extension)
    return files.blocks(kept(files.parse_documents(made), f"parsed-{extension}")).select(_BLOCKS)


@_query(f"""
WITH t AS ({_TURN_LINES}), u AS (SELECT conv_id, turn, role, {_EACH} AS u FROM t),
b AS (
  SELECT conv_id, turn, 0 AS part, 0 AS i, 'heading' AS type, role || ' ' || turn AS text FROM t
  UNION ALL SELECT conv_id, turn, 1, u.i, CASE WHEN role = 'user' THEN 'list' ELSE 'paragraph' END, u.s FROM u
  UNION ALL SELECT conv_id, turn, 2, 0, 'tableRow', 'role | ' || role FROM t
  UNION ALL SELECT conv_id, turn, 2, 1, 'tableRow', 'lines | ' || len(ls) FROM t
), s AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sec_idx FROM b)
SELECT conv_id AS pair_id, sec_idx, CAST(row_number() OVER (PARTITION BY conv_id, sec_idx ORDER BY part, i) - 1 AS INTEGER) AS block_idx, first_value(text) OVER (PARTITION BY conv_id, sec_idx ORDER BY part, i) AS title, NULL::INTEGER AS slide, type, text FROM s
""")
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a Word package per conversation: headings, paragraphs, list items and table rows."""
    return _package_blocks(spark, sf_dir, "docx")


@_query(f"""
WITH t AS ({_TURN_LINES}), u AS (SELECT conv_id, turn, role, len(ls) AS n, {_EACH} AS u FROM t),
p AS (
  SELECT conv_id, turn, 0 AS part, 0 AS i, 'heading' AS type, role || ' ' || turn AS text FROM t
  UNION ALL SELECT conv_id, turn, 1, u.i, CASE WHEN n = 1 THEN 'paragraph' ELSE 'list' END, u.s FROM u
  UNION ALL SELECT conv_id, turn, 2, 0, 'list', 'by ' || role FROM t
  UNION ALL SELECT conv_id, turn, 3, 0, 'paragraph', 'Chart title: Turn ' || turn FROM t
  UNION ALL SELECT conv_id, turn, 3, 1, 'paragraph', 'counts — turn: ' || turn || ', gap: , #2: ' || len(ls) FROM t
  UNION ALL SELECT conv_id, turn, 4, 0, 'tableRow', 'role | ' || role FROM t
  UNION ALL SELECT conv_id, turn, 4, 1, 'tableRow', 'lines | ' || len(ls) FROM t
  UNION ALL SELECT conv_id, turn, 5, 0, 'notes', 'Notes of ' || role FROM t
), b AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sec_idx, CAST(turn + 1 AS INTEGER) AS slide, first_value(text) OVER (PARTITION BY conv_id, turn ORDER BY part) AS title FROM p)
{_NUMBERED}
""")
def pptx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a PowerPoint package per conversation: shapes, diagrams, charts, tables and notes, slides in numeric order."""
    return _package_blocks(spark, sf_dir, "pptx")


_KINDS = ("txt", "TXT", "docx", "pptx", "pdf", "xlsx", "")


@_query(f"""
SELECT page_id, lower(k) AS doc_type, CASE WHEN octet_length(encode(coalesce(html, ''))) = 0 OR page_id % 11 = 0 THEN 'Empty file' WHEN k IN ('docx', 'pptx') THEN 'Could not parse' WHEN lower(k) <> 'txt' THEN 'Unsupported file type' END AS error
FROM (SELECT page_id, html, {list(_KINDS)}[page_id % {len(_KINDS)} + 1] AS k FROM pages)
""")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of error that every page's HTML provokes under changing extensions, some emptied."""
    pages = P.table(spark, sf_dir, "pages")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("page_id") % len(_KINDS) + 1).cast("int"))
    content = F.when(F.col("page_id") % 11 == 0, F.lit("")).otherwise(F.col("html")).cast("binary")
    made = pages.select(F.col("page_id").alias("pair_id"), F.lit("src").alias("side"), F.concat(F.lit("page."), kind).alias("file_name"), content.alias("content"))
    error = F.col("parse_error")
    told = F.when(error.startswith(files.EMPTY), files.EMPTY).when(error.startswith(files.UNSUPPORTED), files.UNSUPPORTED).when(error.startswith(files.UNREADABLE), files.UNREADABLE).otherwise(error)
    return files.parse_documents(made).select(F.col("pair_id").alias("page_id"), "doc_type", told.alias("error"))


@_query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM conversations")
def collapsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as one run of text, white space collapsed."""
    return P.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.collapse(F.col("text")).alias("text"))


# Words of pages: a line item is a word, an order a line, 40 orders a page; every third order's line is a table's row.
_WORDS_SQL = "SELECT l_orderkey // 40 AS page, l_returnflag || l_partkey AS text, CAST(l_linenumber * 40 AS DOUBLE) AS x0, CAST(l_linenumber * 40 + 30 AS DOUBLE) AS x1, CAST((l_orderkey % 40) * 12 + (l_orderkey % 40 // 9) * 10 AS DOUBLE) AS top, CAST((l_orderkey % 40) * 12 + (l_orderkey % 40 // 9) * 10 + 9 AS DOUBLE) AS bottom, l_orderkey FROM lineitem"


@_query(f"""
WITH w AS ({_WORDS_SQL}), b AS (SELECT page, min(x0) AS x0, max(x1) - 35 AS x1, min(top) - 0.5 AS top, max(bottom) + 0.5 AS bottom FROM w WHERE l_orderkey % 3 = 0 GROUP BY page, l_orderkey),
o AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = w.page AND w.x0 >= b.x0 - 1 AND w.x1 <= b.x1 + 1 AND w.top >= b.top - 1 AND w.bottom <= b.bottom + 1)),
l AS (SELECT page, CAST(round_even(top, 0) AS BIGINT) AS line_top, string_agg(text, ' ' ORDER BY x0, text) AS text, min(top) AS top, max(bottom) AS bottom FROM o GROUP BY ALL),
n AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY page ORDER BY line_top) > 8 THEN 1 ELSE 0 END AS new FROM l),
p AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY line_top) AS para_no FROM n)
SELECT page, CAST(para_no AS BIGINT) AS para_no, string_agg(text, ' ' ORDER BY line_top) AS text FROM p GROUP BY page, para_no
""")
def pdf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the words that stand outside of tables' boxes."""
    li = P.table(spark, sf_dir, "lineitem")
    place = F.col("l_orderkey") % 40
    top = (place * 12 + F.floor(place / 9) * 10).cast("double")
    words = li.select(F.lit(1).alias("doc_id"), F.floor(F.col("l_orderkey") / 40).alias("page"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"), (F.col("l_linenumber") * 40).cast("double").alias("x0"), (F.col("l_linenumber") * 40 + 30).cast("double").alias("x1"), top.alias("top"), (top + 9).alias("bottom"), "l_orderkey")
    boxes = words.where("l_orderkey % 3 = 0").groupBy("doc_id", "page", "l_orderkey").agg(F.min("x0").alias("x0"), (F.max("x1") - 35).alias("x1"), (F.min("top") - 0.5).alias("top"), (F.max("bottom") + 0.5).alias("bottom"))
    return pdf.word_paragraphs(pdf.outside_boxes(words.drop("l_orderkey"), boxes)).select("page", "para_no", "text")


# Rulings: two lines along every third order, one beside each of its items and one at its end; lone lines under the others.
_RULED = f"""w AS ({_WORDS_SQL}), o AS (SELECT page, l_orderkey, min(x0) - 2 AS a, max(x1) + 2 AS b, min(top) - 1 AS t, max(bottom) + 1 AS u FROM w GROUP BY page, l_orderkey),
rulings AS (
  SELECT page, a AS x0, b AS x1, t AS top, t AS bottom FROM o WHERE l_orderkey % 3 = 0 UNION SELECT page, a, b, u, u FROM o
  UNION SELECT page, b, b, t, u FROM o WHERE l_orderkey % 3 = 0 UNION SELECT w.page, x0 - 2, x0 - 2, t, u FROM w JOIN o USING (l_orderkey) WHERE l_orderkey % 3 = 0
), n AS MATERIALIZED (SELECT *, row_number() OVER () AS id, bottom - top <= 2 AS flat FROM rulings WHERE (bottom - top <= 2) <> (x1 - x0 <= 2)),
e AS MATERIALIZED (SELECT h.id AS a, v.id AS b FROM n h JOIN n v ON h.page = v.page AND h.flat AND NOT v.flat AND h.x0 - 1.5 <= v.x1 AND v.x0 - 1.5 <= h.x1 AND h.top - 1.5 <= v.bottom AND v.top - 1.5 <= h.bottom),
ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS id, a AS other FROM ways UNION SELECT r.id, ways.b FROM reach r JOIN ways ON ways.a = r.other),
boxes AS MATERIALIZED (SELECT page, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM n JOIN (SELECT id, min(other) AS label FROM reach GROUP BY id) USING (id) GROUP BY page, label HAVING count(*) FILTER (flat) >= 2 AND count(*) FILTER (NOT flat) >= 2)"""


def _rulings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words of pages, and rulings around some of them."""
    li = P.table(spark, sf_dir, "lineitem")
    place = F.col("l_orderkey") % 40
    top = (place * 12 + F.floor(place / 9) * 10).cast("double")
    words = li.select(F.lit(1).alias("doc_id"), F.floor(F.col("l_orderkey") / 40).alias("page"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"), (F.col("l_linenumber") * 40).cast("double").alias("x0"), (F.col("l_linenumber") * 40 + 30).cast("double").alias("x1"), top.alias("top"), (top + 9).alias("bottom"), "l_orderkey")
    spans = words.groupBy("doc_id", "page", "l_orderkey").agg((F.min("x0") - 2).alias("a"), (F.max("x1") + 2).alias("b"), (F.min("top") - 1).alias("t"), (F.max("bottom") + 1).alias("u"))
    line = lambda df, *ends: df.select("doc_id", "page", *(F.col(c).alias(n) for c, n in zip(ends, ("x0", "x1", "top", "bottom"), strict=True)))
    tables = spans.where("l_orderkey % 3 = 0")
    beside = words.join(tables.select("l_orderkey", "t", "u"), "l_orderkey").withColumn("a", F.col("x0") - 2).select("doc_id", "page", "a", "t", "u")
    return words.drop("l_orderkey"), line(tables, "a", "b", "t", "t").unionByName(line(spans, "a", "b", "u", "u")).unionByName(line(tables, "b", "b", "t", "u")).unionByName(line(beside, "a", "a", "t", "u"))


@_query(f"WITH RECURSIVE {_RULED} SELECT * FROM boxes")
def table_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the tables that rulings of pages enclose."""
    return pdf.table_boxes(_rulings(spark, sf_dir)[1]).select("page", "x0", "x1", "top", "bottom")


@_query(f"""
WITH RECURSIVE {_RULED}, f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = w.page AND w.x0 >= b.x0 - 1 AND w.x1 <= b.x1 + 1 AND w.top >= b.top - 1 AND w.bottom <= b.bottom + 1)),
l AS (SELECT page, CAST(round_even(top, 0) AS BIGINT) AS line_top, string_agg(text, ' ' ORDER BY x0, text) AS text, min(top) AS top, max(bottom) AS bottom FROM f GROUP BY ALL),
k AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY page ORDER BY line_top) > 8 THEN 1 ELSE 0 END AS new FROM l),
p AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY line_top) AS para_no FROM k)
SELECT page, CAST(para_no AS BIGINT) AS para_no, string_agg(text, ' ' ORDER BY line_top) AS text FROM p GROUP BY page, para_no
""")
def words_beside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the words that stand outside of the tables that rulings enclose."""
    words, rulings = _rulings(spark, sf_dir)
    boxes = kept(pdf.table_boxes(rulings), "table-boxes")
    return pdf.word_paragraphs(pdf.outside_boxes(words, boxes)).select("page", "para_no", "text")


_MARKED = "array_to_string(list_filter(string_split(html, ' '), lambda x: NOT starts_with(x, '<{0}>')), ' ')"


@_query(_with([_ORDERS.strip(), "p AS MATERIALIZED (SELECT o_orderkey AS id, src AS a, out AS b FROM s)", *O.redline("r", "p")], f"SELECT id AS o_orderkey, {_MARKED.format('ins')} AS source, {_MARKED.format('del')} AS output FROM r"))
def word_diff_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redlines of both sentences of every order as two lists, one for each side."""
    both = worddiff.diff_words(worddiff.diff_words_merged(F.col("src"), F.col("out")))
    told = P.order_sentences(spark, sf_dir).withColumn("d", both)
    return told.select("o_orderkey", worddiff.render(F.col("d.src")).alias("source"), worddiff.render(F.col("d.out")).alias("output"))


_STATUS = "['match', 'modified', 'missing', 'added', 'reformatted'][o_orderkey % 5 + 1]"


@_query(_with([_ORDERS.strip(), f"p AS MATERIALIZED (SELECT o_orderkey AS id, src || ' <&>' AS a, out || ' \"x\"' AS b, {_STATUS} AS status FROM s)", *O.redline("r", "p")], f"SELECT id AS o_orderkey, CASE status WHEN 'missing' THEN '<del>' || {O.ESCAPE.format('a')} || '</del>' WHEN 'added' THEN '<ins>' || {O.ESCAPE.format('b')} || '</ins>' WHEN 'match' THEN {O.ESCAPE.format('a')} ELSE html END AS html FROM p JOIN r USING (id)"))
def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked HTML of both sentences of every order, under changing statuses."""
    status = F.element_at(F.array(*map(F.lit, R.STATUSES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = P.order_sentences(spark, sf_dir).select("o_orderkey", F.concat("src", F.lit(" <&>")).alias("src"), F.concat("out", F.lit(' "x"')).alias("out"), status.alias("status"))
    merged = rows.withColumn("m", worddiff.diff_words_merged(F.col("src"), F.col("out")))
    return merged.select("o_orderkey", worddiff.render_row(F.col("status"), F.col("src"), F.col("out"), F.col("m")).alias("html"))


_PLACES = "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'Page ' || l_suppkey WHEN 2 THEN l_returnflag WHEN 3 THEN 'Slide ' || l_suppkey END AS section, CASE WHEN l_suppkey % 3 < 2 THEN CAST(l_suppkey AS INTEGER) END AS page, CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey AS INTEGER) END AS slide, l_quantity > 25 AS in_table FROM lineitem"


@_query(f"SELECT l_orderkey, l_linenumber, {O.label('section', 'page', 'slide', 'in_table')} AS location, CASE WHEN w IS NULL OR section = w THEN section ELSE w || ' — ' || section END AS label FROM (SELECT *, CASE WHEN slide IS NOT NULL THEN 'Slide ' || slide WHEN page IS NOT NULL THEN 'Page ' || page END AS w FROM ({_PLACES}))")
def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of sections with pages, slides, both or neither, made from line items."""
    li = P.table(spark, sf_dir, "lineitem")
    supplier, n = F.col("l_suppkey").cast("int"), F.col("l_linenumber") % 4
    section = F.when(n == 0, "").when(n == 1, F.concat(F.lit("Page "), supplier.cast("string"))).when(n == 2, F.col("l_returnflag")).otherwise(F.concat(F.lit("Slide "), supplier.cast("string")))
    placed = li.select("l_orderkey", "l_linenumber", section.alias("section"), F.when(supplier % 3 < 2, supplier).alias("page"), F.when(supplier % 3 > 0, supplier).alias("slide"), (F.col("l_quantity") > 25).alias("in_table"))
    place = [F.col(c) for c in ("section", "page", "slide")]
    return placed.select("l_orderkey", "l_linenumber", T.location_label(*place, F.col("in_table")).alias("location"), T.section_label(*place).alias("label"))


@_query("SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(nullif(regexp_extract(name, 'slide(\\d+)\\.xml$', 1), '') AS INTEGER), 0) AS slide FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'ppt/slides/slide' || l_orderkey || '.xml' WHEN 1 THEN 'ppt/slides/slide.xml' ELSE 'ppt/slides/slide' || l_partkey || '.xml.rels' END AS name FROM lineitem)")
def slide_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide numbers in part names made from line items."""
    n = F.col("l_linenumber") % 3
    name = F.when(n == 0, F.concat(F.lit("ppt/slides/slide"), F.col("l_orderkey").cast("string"), F.lit(".xml"))).when(n == 1, "ppt/slides/slide.xml").otherwise(F.concat(F.lit("ppt/slides/slide"), F.col("l_partkey").cast("string"), F.lit(".xml.rels")))
    return P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.slide_index(name).alias("slide"))


_FANNED = " UNION ALL ".join(f"SELECT o_orderkey AS pair_id, '{where}' AS list, {i} AS kind_no, '{label}' AS kind, array_to_string({_sql_minus(_sql_matches(k, 'src'), _sql_matches(k, 'out'))}, ', ') AS removed, array_to_string({_sql_minus(_sql_matches(k, 'out'), _sql_matches(k, 'src'))}, ', ') AS added FROM s WHERE o_orderkey % 4 <> 0" for where, i, k, label in (("number", 0, "number", "Number"), ("number", 1, "percentage", "Percentage"), ("number", 2, "currency", "Currency"), ("number", 3, "fiscalYear", "Fiscal Year"), ("date", 0, "date", "Date")))


@_query(f"WITH {_ORDERS} SELECT * FROM ({_FANNED}) WHERE removed <> '' OR added <> ''")
def change_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of changed numbers and dates over both sentences of every order, three of four being modified rows."""
    rows = P.order_sentences(spark, sf_dir).select(F.col("o_orderkey").alias("pair_id"), F.lit(1).alias("block_id"), F.lit("S").alias("section"), F.when(F.col("o_orderkey") % 4 == 0, "match").otherwise("modified").alias("status"), special.changes(F.col("src"), F.col("out")).alias("special"))
    rows = kept(rows, "special-rows")
    told = lambda df, name: df.select("pair_id", F.lit(name).alias("list"), "kind_no", "kind", F.array_join("removed", ", ").alias("removed"), F.array_join("added", ", ").alias("added"))
    return told(R.number_changes(rows), "number").unionByName(told(R.date_changes(rows), "date"))


@_query(r"SELECT conv_id AS pair_id, CAST(turn AS INTEGER) AS sec_idx, title, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx FROM (SELECT conv_id, turn, concat_ws(' ', role, CAST(turn AS VARCHAR)) AS title, CASE WHEN (conv_id + turn) % 3 = 0 THEN ' - ' ELSE text END AS text FROM conversations) WHERE regexp_replace(regexp_replace(text, '^\s*[-*]\s+', ''), '\s', '', 'g') <> ''")
def filled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections, every third emptied to a bullet: those left keep their place and are numbered anew."""
    text = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.lit(" - ")).otherwise(F.col("text"))
    turns = P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), F.lit("src").alias("side"), F.col("turn").cast("int").alias("sec_idx"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"), F.posexplode(X.line_blocks(text)).alias("block_idx", "text"))
    blocks = turns.selectExpr("pair_id", "side", "sec_idx", "title", "cast(null as int) page", "cast(null as int) slide", "block_idx", "'paragraph' type", "text", "cast(null as array<string>) cells", "cast(null as string) table_id", "cast(null as int) row_index")
    return H.sections(H.paragraphs(blocks)).select("pair_id", "sec_idx", "title", "idx")


_PART_SIDE = "SELECT CAST(p_size AS BIGINT) AS pair_id, '{0}' AS side, 0 AS sec_idx, 'Parts' AS title, NULL::INTEGER AS page, NULL::INTEGER AS slide, CAST({1} AS INTEGER) AS block_idx, 'tableRow' AS type, array_to_string(cells, ' | ') AS text, cells, 't' AS table_id FROM (SELECT p_size, p_partkey, [p_name, {2}] AS cells FROM part WHERE p_partkey % {3} <> 0)"
_PART_BLOCKS = ["blocks AS MATERIALIZED (" + _PART_SIDE.format("src", "p_partkey", "p_brand", 5) + " UNION ALL " + _PART_SIDE.format("out", "-p_partkey", "CASE WHEN p_partkey % 7 = 0 THEN 'Brand#00' ELSE p_brand END", 6) + ")"]


def _parts(spark: SparkSession, sf_dir: str) -> C.Comparison:
    """Parts of a size as a table, and again in reverse: some left out on either side, some of another brand."""
    part = P.table(spark, sf_dir, "part")

    def side(name: str, sign: int, brand, out: int) -> DataFrame:  # noqa: ANN001
        cells, place = F.array(F.col("p_name"), brand), (sign * F.col("p_partkey")).cast("int")
        return part.where(F.col("p_partkey") % out != 0).select(F.col("p_size").cast("long").alias("pair_id"), F.lit(name).alias("side"), F.lit(0).alias("sec_idx"), F.lit("Parts").alias("title"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("slide"), place.alias("block_idx"), F.lit("tableRow").alias("type"), F.array_join(cells, " | ").alias("text"), cells.alias("cells"), F.lit("t").alias("table_id"), place.alias("row_index"))

    changed = F.when(F.col("p_partkey") % 7 == 0, F.lit("Brand#00")).otherwise(F.col("p_brand"))
    return C.compare_documents(kept(side("src", 1, F.col("p_brand"), 5).unionByName(side("out", -1, changed, 6)), "part-blocks"))


@_query(K._compare_sql(_PART_BLOCKS, "SELECT pair_id, CAST(block_id AS INTEGER) AS block_id, status, source_text, output_text, CASE WHEN comments <> '' THEN comments ELSE CASE status WHEN 'missing' THEN 'Table row removed' WHEN 'added' THEN 'Table row added' WHEN 'modified' THEN 'Table row modified' ELSE '' END END AS comments FROM rows_t WHERE status <> 'match'"))
def status_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The missing, added, modified and reformatted rows of tables of parts, with their comments."""
    result = _parts(spark, sf_dir)
    rows = kept(R.all_rows(result.detail_rows, result.table_rows), "part-rows")
    lists = [R.by_status(rows, s) for s in R.STATUSES if s != "match"]
    every = lists[0]
    for one in lists[1:]:
        every = every.unionByName(one)
    return every.select("pair_id", "block_id", "status", "source_text", "output_text", "comments")


@_query(K._compare_sql(_PART_BLOCKS, "UNPIVOT (SELECT pair_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in R._CARDS) + f" FROM ({O.stats('blocks')})) ON {', '.join(R._CARDS)} INTO NAME metric VALUE value"))
def summary_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine cards of each comparison of tables of parts."""
    return R.summary_cards(_parts(spark, sf_dir).stats)


_CUSTOMER_ITEMS = ["src_items AS MATERIALIZED (SELECT 1 AS pair_id, row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_name AS key, c_name AS text FROM customer)", "out_items AS MATERIALIZED (SELECT 1 AS pair_id, row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_phone AS key, c_phone AS text FROM (SELECT c_custkey, c_mktsegment || c_custkey AS c_phone FROM customer WHERE c_custkey % 9 <> 0))"]


@_query(_with([*_CUSTOMER_ITEMS, *O.candidates("x", "src_items", "out_items", ["pair_id"])], "SELECT CAST(src_idx AS INTEGER) AS src_idx, CAST(out_idx AS INTEGER) AS out_idx FROM x_c"))
def align_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one scope over the ceiling of a full scan: all customers' names with most customers' segments."""
    customers = P.table(spark, sf_dir, "customer")

    def items(df: DataFrame, text) -> DataFrame:  # noqa: ANN001
        own = df.select(F.lit(1).alias("pair_id"), "c_custkey", text.alias("key"))
        return K._ranked(own, "c_custkey").select("pair_id", "idx", "key", F.col("key").alias("text"))

    src = kept(items(customers, F.col("c_name")), "ceiling-src")
    out = kept(items(customers.where("c_custkey % 9 <> 0"), F.concat("c_mktsegment", F.col("c_custkey").cast("string"))), "ceiling-out")
    return A.candidates(src, out, ["pair_id"]).select("src_idx", "out_idx")


_COUNT = "CAST(len(list_filter(string_split(html, ' '), lambda x: {0})) AS BIGINT)"


@_query(_with([_ORDERS.strip(), "p AS MATERIALIZED (SELECT o_orderkey AS id, src AS a, out AS b FROM s)", *O.redline("r", "p")], "SELECT id AS o_orderkey, " + ", ".join(f"{_COUNT.format(c)} AS {n}" for n, c in (("removed", "starts_with(x, '<del>')"), ("added", "starts_with(x, '<ins>')"), ("equal_words", "NOT starts_with(x, '<del>') AND NOT starts_with(x, '<ins>')"))) + " FROM r"))
def redline_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are removed, added and equal between both sentences of every order, by the table function."""
    sql.register(spark)
    rows = P.order_sentences(spark, sf_dir).selectExpr("o_orderkey", "src AS source_text", "out AS output_text")
    return spark.sql("SELECT o_orderkey, count_if(token_type = 'removed') AS removed, count_if(token_type = 'added') AS added, count_if(token_type = 'equal') AS equal_words FROM redline(TABLE({rows})) GROUP BY o_orderkey", rows=rows)


@_query(f"SELECT text, count(*) AS blocks FROM ({K.ORACLES['parse_txt_blocks']}) GROUP BY text")
def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each block stands in text files that hold all documents, read by the data source, of its columns one."""
    folder = new_folder(spark, "texts")
    texts = P.table(spark, sf_dir, "documents").where("text is not null").select(F.concat("text", F.lit("\n")).alias("value"))
    texts.write.option("maxRecordsPerFile", 500).text(folder)
    spark.dataSource.register(datasource.DocumentBlocks)
    blocks = spark.read.format("document_blocks").schema("text string").option("source", folder).load()
    return blocks.groupBy("text").agg(F.count("*").alias("blocks"))
