"""The registry of the comparison engine's queries, with DuckDB SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum import oracles as O
from variorum import pairs as P
from variorum.functions import similarity, special, worddiff
from variorum.functions import text as T
from variorum.functions.text import NormalizeOptions
from variorum.operators import align as A
from variorum.operators import hierarchy as H
from variorum.plans import compare as C
from variorum.plans import report as R
from variorum.sources import html as html_source
from variorum.sources import pdf
from variorum.sources import text as X
from variorum.storage import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", "text")


def _ranked(df: DataFrame, order: str) -> DataFrame:
    """df with idx, from 0, in the order of a column: ranks within ranges of it, after the counts of the ranges before."""
    dealt = kept(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_part").count()
    starts = counts.withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn("_nth", nth).join(starts, "_part").withColumn("idx", (F.col("_start") + F.col("_nth") - 1).cast("int")).drop("_part", "_nth", "_start")


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


# SQL fragments. The tables' white space is ASCII, so RE2's class is the engine's.
_FOLD = "translate({0}, '‘’“”–—' || chr(160), '''''\"\"-- ')"
_LINES = r"SELECT doc_id, unnest(list_transform(range(len(ls)), lambda i: {'i': i, 'line': ls[i + 1]})) AS u FROM (SELECT doc_id, list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS ls FROM documents)"
_CORE = r"regexp_replace(regexp_replace(regexp_replace(" + _FOLD + r", '^\s*[•▪◦‣∙·–—\-\*]\s+', ''), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_NORMAL = f"lower({_CORE})"
_UNPUNCTUATED = r"regexp_replace(lower(regexp_replace(regexp_replace(" + _CORE + r""", '[.,;:!?"''“”‘’()\[\]{{}}]', '', 'g'), '[ \t]+', ' ', 'g')), '^\s+|\s+$', '', 'g')"""
_SENTENCES = r"""list_filter(list_transform(string_split_regex(regexp_replace({0}, '([.!?])\s+([A-Z0-9"“''(])', '\1' || chr(1) || '\2', 'g'), '[\n' || chr(1) || ']+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
_ORDERS = r"""
s AS (
  SELECT o_orderkey,
    'Order ' || o_orderkey || ' totals $' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || ' at ' || (o_custkey % 100) || '.' || (o_orderkey % 10) || '% by q' || (o_custkey % 7) || '@example.com' AS src,
    'Order ' || o_orderkey || ' totals $' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 3) || ' on ' || strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INTEGER), '%Y-%m-%d') || ' at ' || (o_custkey % 100) || '.' || (o_orderkey % 10) || '% by q' || (o_custkey % 7) || '@example.com' AS out
  FROM orders
)"""
_RE = {
    "percentage": r"-?\d+(?:\.\d+)?\s?%",
    "currency": r"(?i)(?:[$₹€£¥]|Rs\.?|INR|USD|EUR|GBP)\s?-?\d{1,3}(?:,\d{2,3})*(?:\.\d+)?",
    "fiscalYear": r"(?i)\bFY\s?-?\d{2,4}\b|\bQ[1-4]\s?FY\s?-?\d{2,4}\b",
    "date": r"(?i)\b\d{1,2}[-/ ](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[-/ ]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[ .,]+\d{1,2}[a-z]{0,2},?[ ]+\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{1,2}-\d{1,2}-\d{2,4}\b",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "url": r"""(?i)(?:https?://[^\s,)"''<>]+)|(?:www\.[^\s,)"''<>]+\.[a-zA-Z]{2,}[^\s,)"''<>]*)""",
    "number": r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?",
}


def _sql_matches(kind: str, text: str) -> str:
    if kind == "number":
        for k in ("percentage", "currency", "fiscalYear", "date"):
            text = f"regexp_replace({text}, '{_RE[k]}', ' ', 'g')"
    return rf"list_transform(regexp_extract_all({text}, '{_RE[kind]}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"


def _sql_minus(a: str, b: str) -> str:
    distinct = f"list_filter({a}, lambda v, i: list_position({a}, v) = i)"
    return f"flatten(list_transform({distinct}, lambda v: list_transform(range(greatest(0, len(list_filter({a}, lambda x: x = v)) - len(list_filter({b}, lambda x: x = v)))), lambda n: v)))"


@_query(r"""
SELECT doc_id, CAST(u.i AS INTEGER) AS block_idx, u.b AS text FROM (
  SELECT doc_id, unnest(list_transform(range(len(bs)), lambda i: {'i': i, 'b': bs[i + 1]})) AS u FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n\s*\r?\n'), lambda b: regexp_replace(regexp_replace(b, '\r?\n', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda b: b <> '') AS bs FROM documents))
""")
def parse_txt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-text blocks of every document."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.text_blocks(F.col("text"))).alias("block_idx", "text"))


@_query(f"SELECT doc_id, CAST(u.i AS INTEGER) AS block_idx, u.line AS text FROM ({_LINES})")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document as blocks."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.line_blocks(F.col("text"))).alias("block_idx", "text"))


@_query(f"SELECT doc_id, CAST(u.i AS INTEGER) AS block_idx, {_NORMAL.format('u.line')} AS normalized_text FROM ({_LINES})")
def normalize_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, normalised by the default options."""
    return line_blocks(spark, sf_dir).select("doc_id", "block_idx", T.normalize(F.col("text")).alias("normalized_text"))


@_query(f"SELECT doc_id, CAST(u.i AS INTEGER) AS block_idx, {_UNPUNCTUATED.format('u.line')} AS normalized_text FROM ({_LINES})")
def normalize_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, without punctuation as well."""
    return line_blocks(spark, sf_dir).select("doc_id", "block_idx", T.normalize(F.col("text"), NormalizeOptions(ignore_punctuation=True)).alias("normalized_text"))


@_query(f"SELECT doc_id, CAST(u.i + 1 AS INTEGER) AS sentence_number, u.s AS sentence FROM (SELECT doc_id, unnest(list_transform(range(len(ss)), lambda i: {{'i': i, 's': ss[i + 1]}})) AS u FROM (SELECT doc_id, {_SENTENCES.format('text')} AS ss FROM documents))")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    cut = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("_i", "sentence"))
    return cut.select("doc_id", (F.col("_i") + 1).alias("sentence_number"), "sentence")


def _doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.blocks(_docs(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.lit("src").alias("side"), "text"), cut=X.line_blocks)


@_query(f"SELECT doc_id AS pair_id, count(*) AS paragraphs, CAST(sum(len({_SENTENCES.format('u.line')})) AS BIGINT) AS sentences FROM ({_LINES}) WHERE {_NORMAL.format('u.line')} <> '' GROUP BY doc_id")
def hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and sentences of every document, its lines being blocks."""
    return H.counts(H.paragraphs(_doc_blocks(spark, sf_dir)))


@_query(rf"""
SELECT doc_id AS pair_id, count(*) AS paragraphs FROM (SELECT *, max(u.i) OVER (PARTITION BY doc_id) AS last FROM ({_LINES}))
WHERE NOT (length(regexp_replace(u.line, '^\s+|\s+$', '', 'g')) <= 60 AND NOT regexp_matches(regexp_replace(u.line, '^\s+|\s+$', '', 'g'), '[.!?]$') AND (u.i = 0 OR u.i = last)) AND {_NORMAL.format('u.line')} <> '' GROUP BY doc_id
""")
def header_footer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every document without headers and footers."""
    return H.paragraphs(_doc_blocks(spark, sf_dir), NormalizeOptions(ignore_headers=True, ignore_footers=True)).groupBy("pair_id").agg(F.count("*").alias("paragraphs"))


def _extract(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = F.col("src")
        return P.order_sentences(spark, sf_dir).select("o_orderkey", _joined(T.matches(T.unclaimed(src) if kind == "number" else src, kind)).alias("found"))

    run.__name__ = f"extract_{kind.lower()}"
    run.__doc__ = f"Matches of the pattern {kind} in a sentence per order."
    _query(f"WITH {_ORDERS} SELECT o_orderkey, array_to_string({_sql_matches(kind, 'src')}, '|') AS found FROM s")(run)


for _kind in special.KINDS:
    _extract(_kind)


@_query(rf"WITH {_ORDERS} SELECT o_orderkey, regexp_replace(src, '-?\d+(?:,\d{{3}})*(?:\.\d+)?', '#', 'g') AS skeleton FROM s".replace("{{3}}", "{3}"))
def number_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per order with its numbers masked."""
    return P.order_sentences(spark, sf_dir).select("o_orderkey", T.number_skeleton(F.col("src")).alias("skeleton"))


@_query("SELECT page_id, lower(regexp_extract(url, '(?i)\\.([a-z0-9]+)$', 1)) AS extension FROM pages")
def file_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension of every page's url."""
    return P.table(spark, sf_dir, "pages").select("page_id", T.file_extension(F.col("url")).alias("extension"))


@_query("SELECT doc_id, CASE WHEN coalesce(n_chars, 0) = 0 THEN '0 B' WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f', floor(n_chars / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n_chars / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB' END AS size, CASE WHEN n_chars < 1000 THEN n_chars || ' ms' ELSE ((n_chars + 5) // 10 // 100) || '.' || lpad(CAST((n_chars + 5) // 10 % 100 AS VARCHAR), 2, '0') || ' s' END AS duration FROM documents")
def format_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_chars of every document, as bytes and as milliseconds."""
    return P.table(spark, sf_dir, "documents").select("doc_id", T.format_bytes(F.col("n_chars")).alias("size"), T.format_duration(F.col("n_chars")).alias("duration"))


@_query("SELECT page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's HTML, escaped (as a digest)."""
    return P.table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped_md5"))


_PART_PAIRS = "SELECT p_partkey, p_name || ' ' || p_type AS b, lag(p_name || ' ' || p_type) OVER (ORDER BY p_partkey) AS a FROM part"


def _part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = P.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("b"))
    before = part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("b").alias("a"))
    return part.join(before, "p_partkey")


@_query(f"SELECT p_partkey, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END, 6) AS similarity FROM ({_PART_PAIRS}) WHERE a IS NOT NULL")
def levenshtein_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-distance similarity of each part's name and type with the one before."""
    return _part_pairs(spark, sf_dir).select("p_partkey", F.round(similarity.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"


@_query(f"""
WITH RECURSIVE p AS (SELECT p_partkey, {_WORDS.format('a')} AS a, {_WORDS.format('b')} AS b FROM ({_PART_PAIRS}) WHERE a IS NOT NULL),
t AS (
  SELECT p_partkey, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS row FROM p
  UNION ALL
  SELECT p_partkey, a, b, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j] THEN row[j] + 1 ELSE greatest(acc[j], row[j + 1]) END), [0]) FROM t WHERE i < len(a)
)
SELECT p_partkey, round(2.0 * row[len(b) + 1] / (len(a) + len(b)), 6)::DOUBLE AS similarity FROM t WHERE i = len(a)
""")
def lcs_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-subsequence similarity of each part's name and type with the one before."""
    return _part_pairs(spark, sf_dir).select("p_partkey", F.round(similarity.lcs_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@_query()
def combined_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined similarity of every document and its edited copy."""
    # The work grows with the squares of lengths, not with bytes.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return P.edited_copies(spark, sf_dir, tasks).select("pair_id", F.round(similarity.combined_similarity(F.col("src"), F.col("out")), 6).alias("similarity"))


def _copy_items(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = P.line_blocks(pairs)
    items = kept(lines.select("pair_id", "side", F.col("block_idx").alias("idx"), T.normalize(F.col("text")).alias("key")).withColumn("text", F.col("key")), "copy-items")
    return items.where("side = 'src'").drop("side"), items.where("side = 'out'").drop("side")


_EDITED_ITEMS = [*O.edited(), *(f"{side}_items AS MATERIALIZED (SELECT pair_id, idx, key, key AS text FROM (SELECT pair_id, idx, {_NORMAL.format('line')} AS key FROM edited WHERE side = '{side}'))" for side in ("src", "out"))]


def _with(parts: list[str], last: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + last


@_query(_with([*_EDITED_ITEMS, *O.candidates("x", "src_items", "out_items", ["pair_id"])], "SELECT pair_id, CAST(src_idx AS INTEGER) AS src_idx, CAST(out_idx AS INTEGER) AS out_idx FROM x_eq"))
def align_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal lines of every document and its edited copy, first come first served."""
    return A.match_equal(*_copy_items(P.edited_copies(spark, sf_dir)), ["pair_id"])


@_query(_with([*_EDITED_ITEMS, *O.align("x", "src_items", "out_items", ["pair_id"], O.PARAGRAPH, True)], "SELECT pair_id, type, CAST(src_idx AS INTEGER) AS src_idx, CAST(out_idx AS INTEGER) AS out_idx, round(score, 6) AS score, CAST(op_pos AS INTEGER) AS op_pos FROM x"))
def align_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations that align the lines of every document and its edited copy, with fallback by position."""
    ops = A.align(*_copy_items(P.edited_copies(spark, sf_dir)), ["pair_id"], C.PARAGRAPH, positional_fallback=True)
    return ops.withColumn("score", F.round("score", 6))


@_query(_with([*_EDITED_ITEMS, *O.candidates("x", "src_items", "out_items", ["pair_id"], 400)], "SELECT pair_id, CAST(src_idx AS INTEGER) AS src_idx, CAST(out_idx AS INTEGER) AS out_idx FROM x_c"))
def align_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of lines of edited copies where only scopes of up to 400 pairs are scanned in full."""
    src, out = _copy_items(P.edited_copies(spark, sf_dir))
    equal = kept(A.match_equal(src, out, ["pair_id"]), "banded-equal")
    rest = (A.leftovers(d, equal, side, ["pair_id"]) for d, side in ((src, "src"), (out, "out")))
    return A.candidates(*rest, ["pair_id"], full_scan=400).select("pair_id", "src_idx", "out_idx")


def _compared(spark: SparkSession, sf_dir: str) -> C.Comparison:
    return C.compare_documents(P.line_blocks(P.edited_copies(spark, sf_dir)))


_CHANGES = ", ".join(f"array_to_string({_sql_minus(_sql_matches(k, x), _sql_matches(k, y))}, ', ') AS {k.lower()}_{name}" for k in special.KINDS for name, x, y in (("removed", "src", "out"), ("added", "out", "src")))
_COMMENT = "concat_ws(' | ', " + ", ".join(f"nullif('{special.LABELS[k]} {name}: ' || nullif(array_to_string({_sql_minus(_sql_matches(k, x), _sql_matches(k, y))}, ', '), ''), '')" for k in special.KINDS for name, x, y in (("removed", "src", "out"), ("added", "out", "src"))) + ")"
_NO_CELLS = "NULL::INTEGER AS page, NULL::INTEGER AS slide, {0} AS block_idx, 'paragraph' AS type, {1} AS text, NULL::VARCHAR[] AS cells, NULL::VARCHAR AS table_id"
_COPY_BLOCKS = [*O.edited(), f"blocks AS MATERIALIZED (SELECT pair_id, side, 0 AS sec_idx, 'Document' AS title, {_NO_CELLS.format('idx', 'line')} FROM edited)"]


def _compare_sql(blocks: list[str], last: str) -> str:
    return _with([*blocks, *O.compared("blocks", _NORMAL, _SENTENCES, _COMMENT)], last)


_DETAILS = "SELECT pair_id, CAST(block_id AS INTEGER) AS block_id, section, page, slide, CAST(paragraph_number AS INTEGER) AS paragraph_number, CAST(sentence_number AS INTEGER) AS sentence_number, status, source_text, output_text, comments FROM details"


@_query(_compare_sql(_COPY_BLOCKS, _DETAILS))
def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the comparison of edited copies."""
    return _compared(spark, sf_dir).detail_rows.drop("special")


@_query(_compare_sql(_COPY_BLOCKS, O.stats("blocks")))
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the comparison of edited copies."""
    return _compared(spark, sf_dir).stats


def _redlined(rows: DataFrame) -> DataFrame:
    return R.redline(R.to_export(rows)).withColumn("redline", worddiff.render(F.col("redline")))


_EXPORT = "SELECT pair_id, CAST(block_id AS INTEGER) AS block_id, section, page, slide, paragraph_number, sentence_number, status, source_text, output_text, comments, redline FROM reported"
_FIRST = "SELECT * EXCLUDE (any_changed, nth) FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY block_id) AS nth FROM (SELECT *, bool_or(status <> 'match') OVER (PARTITION BY pair_id) AS any_changed FROM both_kinds) WHERE any_changed = (status <> 'match')) WHERE nth <= CASE WHEN any_changed THEN 200 ELSE 50 END"


def _report_sql(rows: str) -> str:
    return _with([*_COPY_BLOCKS, *O.compared("blocks", _NORMAL, _SENTENCES, _COMMENT), *O.reported(rows)], _EXPORT)


@_query(_report_sql("SELECT * FROM both_kinds"))
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported rows of the comparison of edited copies, all of them, with rendered redlines."""
    result = _compared(spark, sf_dir)
    return _redlined(R.all_rows(result.detail_rows, result.table_rows))


@_query(_report_sql(_FIRST))
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows shown on screen of the comparison of edited copies: per pair 200 changed ones, or 50 if nothing changed."""
    result = _compared(spark, sf_dir)
    return _redlined(R.preview(R.all_rows(result.detail_rows, result.table_rows)))


_TURN_BLOCKS = [
    r"""turns AS MATERIALIZED (SELECT conv_id, turn, concat_ws(' ', role, CAST(turn AS VARCHAR)) AS title, list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS ls FROM conversations WHERE text IS NOT NULL)""",
    "turn_lines AS MATERIALIZED (SELECT conv_id, turn, title, u.i AS i, u.line AS line FROM (SELECT *, unnest(list_transform(range(len(ls)), lambda i: {'i': i, 'line': ls[i + 1]})) AS u FROM turns))",
    f"both_sides AS MATERIALIZED (SELECT conv_id AS pair_id, 'src' AS side, turn AS sec_idx, title, {_NO_CELLS.format('i', 'line')} FROM turn_lines UNION ALL SELECT conv_id - 1, 'out', turn, title, {_NO_CELLS.format('i', 'line')} FROM turn_lines)",
    "blocks AS MATERIALIZED (SELECT * FROM both_sides WHERE pair_id IN (SELECT pair_id FROM both_sides GROUP BY pair_id HAVING count(DISTINCT side) = 2))",
]
_SECTION_ROWS = "SELECT pair_id, block_id, section, page, slide, status FROM details UNION ALL SELECT pair_id, block_id, section, page, slide, status FROM rows_t"


@_query(_compare_sql(_TURN_BLOCKS, f"SELECT pair_id, section, CAST(min(block_id) AS INTEGER) AS first_block, arg_min(page, block_id) AS page, arg_min(slide, block_id) AS slide, {', '.join(f'count(*) FILTER (status = {st!r}) AS {st}' for st in R.STATUSES)}, section AS label FROM ({_SECTION_ROWS}) GROUP BY pair_id, section"))
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and section over conversations: each with the next one, turns being sections."""
    result = _conversations(spark, sf_dir)
    return R.section_counts(R.all_rows(result.detail_rows, result.table_rows))


@_query(_compare_sql(_TURN_BLOCKS, "SELECT pair_id, type, CAST(src_idx AS INTEGER) AS src_idx, CAST(out_idx AS INTEGER) AS out_idx, round(score, 6) AS score, CAST(sec_op AS INTEGER) AS sec_op FROM sec"))
def section_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the turns of each conversation are aligned with the next one's."""
    return _conversations(spark, sf_dir).section_ops.select("pair_id", "type", "src_idx", "out_idx", F.round("score", 6).alias("score"), "sec_op")


def _conversations(spark: SparkSession, sf_dir: str) -> C.Comparison:
    turns = P.table(spark, sf_dir, "conversations").where("text is not null")
    as_side = lambda shift, name: turns.select((F.col("conv_id") + shift).alias("pair_id"), F.lit(name).alias("side"), F.col("turn").cast("int").alias("sec_idx"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"), F.posexplode(X.line_blocks(F.col("text"))).alias("block_idx", "text"))
    both = as_side(0, "src").unionByName(as_side(-1, "out"))
    whole = both.groupBy("pair_id").agg(F.count_distinct("side").alias("n")).where("n = 2")
    blocks = both.join(whole, "pair_id", "left_semi").selectExpr("pair_id", "side", "sec_idx", "title", "cast(null as int) page", "cast(null as int) slide", "block_idx", "'paragraph' type", "text", "cast(null as array<string>) cells", "cast(null as string) table_id", "cast(null as int) row_index")
    return C.compare_documents(blocks)


@_query(f"WITH {_ORDERS} SELECT o_orderkey, {_CHANGES} FROM s")
def special_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes between both sentences of every order, by kind."""
    changed = P.order_sentences(spark, sf_dir).withColumn("c", special.changes(F.col("src"), F.col("out")))
    value = lambda k, side: F.coalesce(F.array_join(F.col("c")[k][side], ", "), F.lit(""))
    return changed.select("o_orderkey", *(value(k, side).alias(f"{k.lower()}_{side}") for k in special.KINDS for side in ("removed", "added")))


@_query(f"WITH {_ORDERS}, c AS (SELECT o_orderkey, {_CHANGES} FROM s) SELECT o_orderkey, concat_ws(' | ', " + ", ".join(f"CASE WHEN {k.lower()}_{side} <> '' THEN '{special.LABELS[k]} {side}: ' || {k.lower()}_{side} END" for k in special.KINDS for side in ("removed", "added")) + ") AS comment FROM c")
def special_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment on what changes between both sentences of every order."""
    changed = P.order_sentences(spark, sf_dir).withColumn("c", special.changes(F.col("src"), F.col("out")))
    return changed.select("o_orderkey", special.summary(F.col("c")).alias("comment"))


@_query(rf"""
WITH l AS (SELECT doc_id, u.i AS i, u.line AS line, {_NORMAL.format('u.line')} AS k FROM ({_LINES})),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS number FROM l),
m AS (SELECT * FROM n WHERE k <> ''),
r AS (SELECT *, row_number() OVER w AS rn, first_value(number) OVER w AS first_number FROM m WHERE length(k) >= 8 WINDOW w AS (PARTITION BY doc_id, k ORDER BY i))
SELECT doc_id, line AS text, CAST(first_number AS INTEGER) AS first_paragraph, CAST(number AS INTEGER) AS paragraph FROM r WHERE rn > 1
""")
def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines within every document, with the first one's place."""
    found = H.duplicates(H.paragraphs(_doc_blocks(spark, sf_dir)))
    return found.select(F.col("pair_id").alias("doc_id"), "text", F.col("first_location.paragraph_number").alias("first_paragraph"), F.col("location.paragraph_number").alias("paragraph"))


@_query("""
SELECT l_suppkey, CASE WHEN n + a + r = 0 THEN 100.0 ELSE floor(n / CAST(n + a + r AS DOUBLE) * 1000.0 + 0.5) / 10.0 END AS percentage
FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey)
""")
def match_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match percentage over line items per supplier, return flags standing for statuses."""
    flag = lambda v: F.count_if(F.col("l_returnflag") == v)
    counts = P.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(flag("N").alias("n"), flag("A").alias("a"), flag("R").alias("r"))
    return counts.select("l_suppkey", C.match_percentage(F.col("n"), F.col("a"), F.col("r"), F.lit(0)).alias("percentage"))


_ROWS = "SELECT o_orderkey, o_custkey, [CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')] AS cells FROM orders"


@_query(f"""
WITH r AS ({_ROWS}), p AS (SELECT o_orderkey, cells AS b, lag(cells) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM r)
SELECT o_orderkey, CAST(i AS INTEGER) AS cell_index, a[i + 1] AS src_text, b[i + 1] AS out_text, CASE WHEN a[i + 1] = b[i + 1] THEN 'match' WHEN a[i + 1] = '' THEN 'added' WHEN b[i + 1] = '' THEN 'missing' ELSE 'modified' END AS status
FROM (SELECT *, unnest(range(4)) AS i FROM p WHERE a IS NOT NULL)
""")
def cell_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every order against the customer's order before."""
    orders = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("cells"))
    before = orders.withColumn("a", F.lag("cells").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("a is not null")
    return before.select("o_orderkey", F.explode(C.diff_cells(F.col("a"), F.col("cells"))).alias("c")).select("o_orderkey", "c.cell_index", "c.src_text", "c.out_text", "c.status")


@_query("SELECT o_custkey % 50 AS sec_op, o_orderkey AS para_pos, CAST(dense_rank() OVER (PARTITION BY o_custkey % 50 ORDER BY first) - 1 AS INTEGER) AS table_rank FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey % 50, o_custkey) AS first FROM orders)")
def table_local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables of 50 sections, numbered by their first order."""
    rows = P.table(spark, sf_dir, "orders").select(F.lit(1).alias("pair_id"), (F.col("o_custkey") % 50).alias("sec_op"), F.col("o_orderkey").alias("para_pos"), F.col("o_custkey").cast("string").alias("table_id"))
    return C.local_table_ids(rows).select("sec_op", "para_pos", "table_rank")


_TABLE_BLOCKS = [
    "customers AS MATERIALIZED (SELECT c_custkey, c_mktsegment, c_name, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) AS balance FROM customer)",
    "table_sides AS (SELECT c_mktsegment, 'src' AS side, c_custkey AS block_idx, [c_name, balance] AS cells FROM customers UNION ALL SELECT c_mktsegment, 'out', -c_custkey, [c_name, CASE WHEN c_custkey % 7 = 0 THEN '1,234.00' ELSE balance END] FROM customers)",
    "segments AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS pair_id FROM (SELECT DISTINCT c_mktsegment FROM customer))",
    "blocks AS MATERIALIZED (SELECT pair_id, side, 0 AS sec_idx, 'Customers' AS title, NULL::INTEGER AS page, NULL::INTEGER AS slide, block_idx, 'tableRow' AS type, array_to_string(cells, ' | ') AS text, cells, 't' AS table_id FROM table_sides JOIN segments USING (c_mktsegment))",
]


@_query(_compare_sql(_TABLE_BLOCKS, "SELECT pair_id, CAST(block_id AS INTEGER) AS block_id, section, page, slide, table_id, status, source_text, output_text, cell_diffs, comments FROM rows_t"))
def table_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of a pair per market segment: its customers as a table, and again with every seventh balance changed, in reverse."""
    c = P.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name", F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("balance"))
    pair = c.select("c_mktsegment").distinct().withColumn("pair_id", F.row_number().over(Window.orderBy("c_mktsegment")).cast("long"))
    changed = F.when(F.col("c_custkey") % 7 == 0, F.lit("1,234.00")).otherwise(F.col("balance"))

    def side(name: str, balance: Column, order: Column) -> DataFrame:
        cells = F.array("c_name", balance)
        return c.join(F.broadcast(pair), "c_mktsegment").select("pair_id", F.lit(name).alias("side"), F.lit(0).alias("sec_idx"), F.lit("Customers").alias("title"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("slide"), order.cast("int").alias("block_idx"), F.lit("tableRow").alias("type"), F.array_join(cells, " | ").alias("text"), cells.alias("cells"), F.lit("t").alias("table_id"), order.cast("int").alias("row_index"))

    blocks = kept(side("src", F.col("balance"), F.col("c_custkey")).unionByName(side("out", changed, -F.col("c_custkey"))), "customer-blocks")
    return C.compare_documents(blocks).table_rows.withColumn("cell_diffs", F.to_json("cell_diffs"))


@_query("SELECT conv_id, turn, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS key FROM conversations")
def reconcile_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as reconciliation compares it."""
    return P.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.reconcile_key(F.col("text")).alias("key"))


@_query("SELECT doc_id, count(*) AS n_tokens, CAST(count(DISTINCT w) AS BIGINT) AS n_distinct FROM (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY doc_id")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document."""
    words = T.tokens(F.col("text"))
    return _docs(spark, sf_dir).where(F.size(words) > 0).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@_query("SELECT c_mktsegment, CAST(least(62, greatest(10, greatest(max(least(length(c_name), 60)), length('c_name') + 2) + 2)) AS INTEGER) AS width FROM customer GROUP BY c_mktsegment")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of an exported column of customer names, by market segment."""
    longest = F.max(F.least(F.length("c_name"), F.lit(60)))
    return P.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(R.column_width(longest, "c_name").cast("int").alias("width"))


@_query(_with([_ORDERS.strip(), "p AS MATERIALIZED (SELECT o_orderkey AS id, src AS a, out AS b FROM s)", *O.redline("r", "p")], "SELECT id AS o_orderkey, html AS redline FROM r"))
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redlines of both sentences of every order."""
    return P.order_sentences(spark, sf_dir).select("o_orderkey", worddiff.render(worddiff.diff_words_merged(F.col("src"), F.col("out"))).alias("redline"))


@_query(f"WITH p AS (SELECT i.item_id, concat_ws(' ', i.text, 'end') AS a, concat_ws(' ', i.text, n.text, 'end') AS b FROM benchmark i JOIN benchmark n ON n.item_id = i.item_id + 1) SELECT item_id, source, output, trimmed FROM ({O.trimmed('a', 'b', 'p')})")
def trim_around_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item and the next one's text after it, cut around where they part."""
    items = P.table(spark, sf_dir, "benchmark").select("item_id", "text")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("more"))
    cut = items.join(after, "item_id").select("item_id", worddiff.trim_around_change(F.concat_ws(" ", "text", F.lit("end")), F.concat_ws(" ", "text", "more", F.lit("end"))).alias("c"))
    return cut.select("item_id", "c.source", "c.output", "c.trimmed")


# Blocks of pages by marks: each starts a block of its kind (P, H, L), or ends one (N). It knows the elements that the pages have, not all of HTML.
_PAGE_BLOCKS = r"""
WITH bare AS (
  SELECT page_id AS pair_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<!doctype[^>]*>', '', 'gis'), '<(script|style|title)\b[^>]*>.*?(</(script|style|title)\s*>|$)', '', 'gis'), '<br\b[^>]*>', ' ', 'gi') AS html FROM pages),
marked AS (
  SELECT pair_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</(p|h1|li|ul)\s*>|<ul\b[^>]*>', chr(1) || 'N', 'gi'), '<p\b[^>]*>', chr(1) || 'P', 'gi'), '<h1\b[^>]*>', chr(1) || 'H', 'gi'), '<li\b[^>]*>', chr(1) || 'L', 'gi'), '</?[a-zA-Z][^>]*(>|$)', '', 'g') AS html FROM bare),
pieces AS (
  SELECT pair_id, unnest(list_transform(range(len(ps)), lambda i: {'i': i, 'p': ps[i + 1]})) AS u FROM (SELECT pair_id, string_split('N' || html, chr(1)) AS ps FROM marked)),
texts AS (
  SELECT pair_id, u.i AS i, u.p[1] AS kind, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u.p[2:], '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pieces),
opened AS (
  SELECT *, sum((kind = 'H')::INTEGER) OVER (PARTITION BY pair_id ORDER BY i) AS heading FROM texts WHERE text <> '')
SELECT pair_id, CAST(dense_rank() OVER (PARTITION BY pair_id ORDER BY heading) - 1 AS INTEGER) AS sec_idx, CASE WHEN heading = 0 THEN 'Document' ELSE first_value(text) OVER (PARTITION BY pair_id, heading ORDER BY i) END AS title, CAST(row_number() OVER (PARTITION BY pair_id, heading ORDER BY i) - 1 AS INTEGER) AS block_idx, CASE kind WHEN 'H' THEN 'heading' WHEN 'L' THEN 'list' ELSE 'paragraph' END AS type, text FROM opened
"""


@_query(_PAGE_BLOCKS)
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page."""
    pages = P.table(spark, sf_dir, "pages").select(F.col("page_id").alias("pair_id"), F.lit("src").alias("side"), "html")
    return html_source.blocks(pages).select("pair_id", "sec_idx", "title", "block_idx", "type", "text")


_BULLET = r"^\s*([•▪◦‣∙·–—\-*]|\d+[.)])\s+"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text items on pages: an order is a line, its items stand in it by number, 40 orders are a page."""
    li = P.table(spark, sf_dir, "lineitem")
    place = F.col("l_orderkey") % 40
    return li.select(F.lit(1).alias("doc_id"), F.floor(F.col("l_orderkey") / 40).alias("page"), F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("str"), (F.col("l_linenumber") * 40 + F.col("l_suppkey") % 3).cast("double").alias("x"), (F.lit(800.0) - place * 15 - F.floor(place / 7) * 10).alias("y"), F.when(F.col("l_linenumber") % 3 == 0, 38.0).otherwise(15.0).alias("width"))


_ITEMS = "SELECT l_orderkey // 40 AS page, l_returnflag || '-' || l_partkey || '-' || l_suppkey AS str, CAST(l_linenumber * 40 + l_suppkey % 3 AS DOUBLE) AS x, 800.0::DOUBLE - (l_orderkey % 40) * 15 - ((l_orderkey % 40) // 7) * 10 AS y, CASE WHEN l_linenumber % 3 = 0 THEN 38.0 ELSE 15.0 END::DOUBLE AS width FROM lineitem"


@_query(f"""
WITH i AS ({_ITEMS}), g AS (SELECT *, CAST(floor(y + 0.5) AS BIGINT) AS line_y, x - lag(x + width) OVER w AS gap, row_number() OVER w AS n FROM i WINDOW w AS (PARTITION BY page, CAST(floor(y + 0.5) AS BIGINT) ORDER BY x, str))
SELECT page, line_y, string_agg(CASE WHEN gap > 1 THEN ' ' ELSE '' END || str, '' ORDER BY n) AS text, count(*) >= 3 AND count(*) FILTER (gap > 18) >= 2 AS is_table FROM g GROUP BY page, line_y
""")
def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of positioned text items."""
    return pdf.lines(_items(spark, sf_dir)).select("page", "line_y", "text", "is_table")


@_query(rf"""
WITH i AS ({_ITEMS}), g AS (SELECT *, CAST(floor(y + 0.5) AS BIGINT) AS line_y, x - lag(x + width) OVER w AS gap, row_number() OVER w AS n FROM i WINDOW w AS (PARTITION BY page, CAST(floor(y + 0.5) AS BIGINT) ORDER BY x, str)),
c AS (SELECT *, coalesce(sum(CASE WHEN gap > 18 THEN 1 ELSE 0 END) OVER (PARTITION BY page, line_y ORDER BY n), 0) AS cell FROM g),
k AS (SELECT page, line_y, cell, string_agg(CASE WHEN gap > 1 THEN ' ' ELSE '' END || str, '' ORDER BY n) AS t FROM c GROUP BY page, line_y, cell),
cells AS (SELECT page, line_y, string_agg(regexp_replace(t, '^\s+|\s+$', '', 'g'), ' | ' ORDER BY cell) AS row_text FROM k GROUP BY page, line_y),
l AS (SELECT page, line_y, string_agg(CASE WHEN gap > 1 THEN ' ' ELSE '' END || str, '' ORDER BY n) AS text, count(*) >= 3 AND count(*) FILTER (gap > 18) >= 2 AS is_table FROM g GROUP BY page, line_y),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line_y DESC) - 1 AS line_no, sum(CASE WHEN is_table THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_y DESC) AS tables FROM l JOIN cells USING (page, line_y)),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line_no) AS row_index FROM o WHERE is_table),
f AS (SELECT *, CASE WHEN lag(line_y) OVER w IS NULL OR lag(line_y) OVER w - line_y > 22 OR regexp_matches(text, '{_BULLET}') OR lag(tables) OVER w <> tables THEN 1 ELSE 0 END AS new FROM o WHERE NOT is_table AND text <> '' WINDOW w AS (PARTITION BY page ORDER BY line_no)),
h AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY line_no) AS para FROM f),
q AS (SELECT page, min(line_no) AS block_no, string_agg(text, ' ' ORDER BY line_no) AS text FROM h GROUP BY page, para)
SELECT 1 AS doc_id, page, CAST(line_no AS INTEGER) AS block_no, 'tableRow' AS type, row_text AS text, 'page' || page || '_table_' || CAST(ceil(row_index / 4.0) AS BIGINT) AS table_id, CAST(row_index AS INTEGER) AS row_index FROM r
UNION ALL SELECT 1, page, CAST(block_no AS INTEGER), CASE WHEN regexp_matches(text, '{_BULLET}') THEN 'list' ELSE 'paragraph' END, text, NULL, NULL FROM q
""")
def pdf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows and paragraphs of positioned text items."""
    return pdf.blocks(kept(pdf.lines(_items(spark, sf_dir)), "pdf-lines")).drop("cells")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status of the comparison of edited copies."""
    return _compared(spark, sf_dir).detail_rows.groupBy("pair_id", "status").agg(F.count("*").alias("rows"))
