"""The comparison in DuckDB SQL: what the catalog's queries are held against. Nothing else uses it.

Each function gives common table expressions as text, `name AS (...)`; a query is WITH RECURSIVE and some of them. The
tables' letters beyond ASCII are folded to control characters where edit distances are taken, as DuckDB counts bytes.
"""

from __future__ import annotations

# Fixed values, stated a second time so that a slip in the engine shows.
FULL_SCAN, LEAST_BAND = 200_000, 25
SECTION, PARAGRAPH, SENTENCE, TABLE, RECONCILE = 0.30, 0.45, 0.45, 0.40, 0.75

_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü—"
_MARKS = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 14 + len(_LETTERS) - 8)])
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
_SKELETON = r"regexp_replace({0}, '-?\d+(?:,\d{{3}})*(?:\.\d+)?', '#', 'g')"


def scores(name: str, pairs: str, least: float) -> list[str]:
    """{name}: a, b and score (the combined similarity) of the distinct pairs of texts in `pairs`.

    Pairs that can't reach `least` are left out: no common subsequence is longer than the words of one that the other has.
    """
    shared = "2.0::DOUBLE * len(list_filter(wa, lambda x: list_contains(wb, x))) / greatest(len(wa) + len(wb), 1)"
    can = f"{_SKELETON.format('a')} = {_SKELETON.format('b')} OR 0.6::DOUBLE * (1 - levenshtein(translate(a, '{_LETTERS}', {_MARKS}), translate(b, '{_LETTERS}', {_MARKS})) / greatest(length(a), length(b), 1)::DOUBLE) + 0.4::DOUBLE * CASE WHEN len(wa) + len(wb) = 0 THEN 1.0 ELSE {shared} END >= {least} - 0.000001"
    return [
        f"{name}_d AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT a, b, {WORDS.format('a')} AS wa, {WORDS.format('b')} AS wb FROM (SELECT DISTINCT a, b FROM {pairs})) WHERE {can})",
        f"""{name}_l AS (
  SELECT id, wa, wb, 0 AS i, list_transform(range(len(wb) + 1), lambda x: 0) AS row FROM {name}_d
  UNION ALL
  SELECT id, wa, wb, i + 1, list_reduce(range(1, len(wb) + 1), lambda acc, j: list_append(acc, CASE WHEN wa[i + 1] = wb[j] THEN row[j] + 1 ELSE greatest(acc[j], row[j + 1]) END), [0]) FROM {name}_l WHERE i < len(wa) AND len(wb) > 0
)""",
        f"""{name} AS MATERIALIZED (
  SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN {_SKELETON.format("a")} <> a AND {_SKELETON.format("a")} = {_SKELETON.format("b")} THEN greatest(s, 0.9::DOUBLE) ELSE s END AS score FROM (
    SELECT d.a, d.b, 0.6::DOUBLE * (1 - levenshtein(translate(d.a, '{_LETTERS}', {_MARKS}), translate(d.b, '{_LETTERS}', {_MARKS})) / greatest(length(d.a), length(d.b), 1)::DOUBLE)
      + 0.4::DOUBLE * CASE WHEN len(d.wa) + len(d.wb) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(l.row[len(d.wb) + 1], 0) / (len(d.wa) + len(d.wb)) END AS s
    FROM {name}_d d LEFT JOIN {name}_l l ON l.id = d.id AND l.i = len(l.wa)))""",
    ]


def candidates(name: str, src: str, out: str, scope: list[str], full_scan: int = FULL_SCAN) -> list[str]:
    """{name}_eq: equal keys, paired in order; {name}_s1, {name}_o1: what is left; {name}_c: the pairs to be scored."""
    by, same = ", ".join(scope), " AND ".join(f"e.{c} = s.{c}" for c in scope)
    left = lambda side, items: f"SELECT s.*, row_number() OVER (PARTITION BY {by} ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY {by}) AS n FROM {items} s WHERE NOT EXISTS (SELECT 1 FROM {name}_eq e WHERE {same} AND e.{side}_idx = s.idx)"
    nth = f"row_number() OVER (PARTITION BY {by}, key ORDER BY idx) AS nth"
    center, width = "floor(s.pos / s.n::DOUBLE * o.n + 0.5)", f"greatest({LEAST_BAND}, ceil({full_scan}::DOUBLE / greatest(s.n, o.n)))"
    return [
        f"{name}_eq AS MATERIALIZED (SELECT {by}, a.idx AS src_idx, b.idx AS out_idx FROM (SELECT *, {nth} FROM {src}) a JOIN (SELECT *, {nth} FROM {out}) b USING ({by}, key, nth))",
        f"{name}_s1 AS MATERIALIZED ({left('src', src)})",
        f"{name}_o1 AS MATERIALIZED ({left('out', out)})",
        f"{name}_c AS MATERIALIZED (SELECT {by}, s.idx AS src_idx, o.idx AS out_idx, s.text AS a, o.text AS b FROM {name}_s1 s JOIN {name}_o1 o USING ({by}) WHERE s.n * o.n <= {full_scan} OR o.pos BETWEEN {center} - {width} AND {center} + {width})",
    ]


def align(name: str, src: str, out: str, scope: list[str], threshold: float, positional: bool = False) -> list[str]:
    """{name}: scope, type, src_idx, out_idx, score, op_pos of every item of src and out (scope, idx, key, text)."""
    by = ", ".join(scope)
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in scope)
    free = "NOT list_contains(g.us, e.src_idx) AND NOT list_contains(g.uo, e.out_idx)"
    rest = lambda side, items: f"SELECT s.*, row_number() OVER (PARTITION BY {by} ORDER BY idx) AS nth FROM {items} s WHERE NOT EXISTS (SELECT 1 FROM {name}_ch e WHERE {same('e', 's')} AND e.{side}_idx = s.idx)"
    placed = f"SELECT {by}, s.idx AS src_idx, o.idx AS out_idx FROM {name}_s2 s JOIN {name}_o2 o USING ({by}, nth)"
    lone = lambda side, items: f"SELECT s.* FROM {items} s WHERE NOT EXISTS (SELECT 1 FROM {name}_pl p WHERE {same('p', 's')} AND p.{side}_idx = s.idx)"
    return [
        *candidates(name, src, out, scope),
        *scores(f"{name}_sc", f"{name}_c", threshold),
        f"{name}_e AS MATERIALIZED (SELECT {by}, src_idx, out_idx, score, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, src_idx, out_idx) AS k FROM {name}_c JOIN {name}_sc USING (a, b) WHERE score >= {threshold}::DOUBLE)",
        f"""{name}_g AS (
  SELECT {by}, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS uo, -1::BIGINT AS src_idx, -1::BIGINT AS out_idx, 0::DOUBLE AS score, false AS took FROM (SELECT DISTINCT {by} FROM {name}_e)
  UNION ALL
  SELECT {", ".join(f"g.{c}" for c in scope)}, e.k, CASE WHEN {free} THEN list_append(g.us, e.src_idx) ELSE g.us END, CASE WHEN {free} THEN list_append(g.uo, e.out_idx) ELSE g.uo END, e.src_idx, e.out_idx, e.score, {free} FROM {name}_g g JOIN {name}_e e ON {same("g", "e")} AND e.k = g.k + 1
)""",
        f"{name}_ch AS MATERIALIZED (SELECT {by}, src_idx, out_idx, score FROM {name}_g WHERE took)",
        f"{name}_s2 AS MATERIALIZED ({rest('src', f'{name}_s1')})",
        f"{name}_o2 AS MATERIALIZED ({rest('out', f'{name}_o1')})",
        f"{name}_pl AS MATERIALIZED ({placed}{'' if positional else ' WHERE false'})",
        f"""{name} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY src_idx NULLS LAST, out_idx) - 1 AS op_pos FROM (
    SELECT {by}, 'match' AS type, src_idx, out_idx, 1.0::DOUBLE AS score FROM {name}_eq
    UNION ALL SELECT {by}, 'modify', src_idx, out_idx, score FROM {name}_ch
    UNION ALL SELECT {by}, 'modify', src_idx, out_idx, 0.0::DOUBLE FROM {name}_pl
    UNION ALL SELECT {by}, 'delete', idx, NULL, NULL FROM ({lone("src", f"{name}_s2")})
    UNION ALL SELECT {by}, 'insert', NULL, idx, NULL FROM ({lone("out", f"{name}_o2")})))""",
    ]


def edited(lines: str = r"list_filter(string_split_regex({0}, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')") -> list[str]:
    """edited: pair_id, side, idx and line of every document and its edited copy."""
    upper = "upper(replace(s.line, 'ß', 'SS'))"
    line = f"CASE WHEN s.k % 11 = 4 THEN 'Line ' || s.k || ' was replaced as a whole.' WHEN s.k % 5 = 2 THEN s.line || ' and some words more' WHEN s.k % 6 = 1 THEN {upper} ELSE s.line END"
    return [
        f"original AS MATERIALIZED (SELECT doc_id AS pair_id, coalesce(doc_id % 2310, 0) AS start, {lines.format('text')} AS ls FROM documents WHERE text IS NOT NULL)",
        f"changed AS MATERIALIZED (SELECT pair_id, start, list_transform(list_filter(list_transform(range(len(ls)), lambda i: {{'k': start + i, 'line': ls[i + 1]}}), lambda s: s.k % 7 <> 3), lambda s: {line}) AS ls FROM original)",
        "sided AS (SELECT pair_id, 'src' AS side, ls FROM original UNION ALL SELECT pair_id, 'out', list_append(CASE WHEN start % 3 = 0 THEN list_reverse(ls) ELSE ls END, 'This line is new in the copy.') FROM changed)",
        "edited AS MATERIALIZED (SELECT pair_id, side, u.i AS idx, u.line AS line FROM (SELECT pair_id, side, unnest(list_transform(range(len(ls)), lambda i: {'i': i, 'line': ls[i + 1]})) AS u FROM sided))",
    ]


def label(section: str, page: str, slide: str, table: str) -> str:
    where = f"CASE WHEN {slide} IS NOT NULL THEN 'Slide ' || {slide} WHEN {page} IS NOT NULL THEN 'Page ' || {page} END"
    base = f"CASE WHEN coalesce({section}, '') = '' THEN 'Document' ELSE {section} END"
    return f"(CASE WHEN ({where}) IS NULL OR ({base}) = ({where}) THEN ({base}) ELSE ({base}) || ' — ' || ({where}) END || CASE WHEN {table} THEN ' (table)' ELSE '' END)"


def compared(blocks: str, normal: str, sentences: str, comment: str) -> list[str]:
    """The comparison of `blocks` (a table as schema.BLOCKS): sec, para, details, rows_t, stats and what they need.

    normal, sentences: SQL of a normalised text and of a list of sentences, with {0} for the text; comment: SQL of the comment
    on what changes between columns src and out.
    """
    sc, ps = ["pair_id"], ["pair_id", "sec_op"]
    scope3 = "pair_id, sec_op, para_op"
    own = "[{'original': coalesce(text, ''), 'normalized': normalized_text}]"
    cut = f"list_transform({sentences.format('text')}, lambda s: {{'original': s, 'normalized': {normal.format('s')}}})"
    in_section = lambda side, p: f"SELECT q.pair_id, o.sec_op, o.type AS sec_type, q.* EXCLUDE (pair_id, side, title, page, slide) FROM paras q JOIN sec o ON o.pair_id = q.pair_id AND o.{p}_sec = q.sec_idx WHERE q.side = '{side}'"
    sentence_items = lambda p: f"SELECT {scope3}, u.i AS idx, u.s.normalized AS key, u.s.normalized AS text, u.s.original AS original, u.i + 1 AS number FROM (SELECT {scope3}, unnest(list_transform(range(len({p}_sentences)), lambda i: {{'i': i, 's': {p}_sentences[i + 1]}})) AS u FROM para WHERE type = 'modify' AND score <> 0)"
    status = "CASE {0} WHEN 'match' THEN 'match' WHEN 'delete' THEN 'missing' WHEN 'insert' THEN 'added' ELSE 'modified' END"
    whole = lambda side, kind, st, text: f"SELECT pair_id, sec_op, para_pos AS para_op, 0 AS sub, '{st}' AS status, paragraph_number, NULL AS sentence_number, {'original_text' if side == 'src' else repr('')} AS source_text, {repr('') if side == 'src' else 'original_text'} AS output_text, '{text}' AS comments FROM {side}_p WHERE type <> 'tableRow' AND sec_type = '{kind}'"
    table_items = lambda side: f"SELECT *, row_number() OVER (PARTITION BY pair_id, sec_op, table_rank ORDER BY para_pos) - 1 AS idx, normalized_text AS key, normalized_text AS text FROM (SELECT *, dense_rank() OVER (PARTITION BY pair_id, sec_op ORDER BY first) - 1 AS table_rank FROM (SELECT *, min(para_pos) OVER (PARTITION BY pair_id, sec_op, CASE WHEN coalesce(table_id, '') = '' THEN 'table' ELSE table_id END) AS first FROM {side}_p WHERE type = 'tableRow' AND sec_type IN ('match', 'modify')))"
    cell = lambda i: f"{{'cell_index': {i}, 'src_text': coalesce(s.cells[{i} + 1], ''), 'out_text': coalesce(o.cells[{i} + 1], ''), 'status': CASE WHEN coalesce(s.cells[{i} + 1], '') = coalesce(o.cells[{i} + 1], '') THEN 'match' WHEN coalesce(s.cells[{i} + 1], '') = '' THEN 'added' WHEN coalesce(o.cells[{i} + 1], '') = '' THEN 'missing' ELSE 'modified' END}}"
    key = TRIM.format(r"regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g')")
    unit = lambda src, cell, st, s, o, table, part: f"SELECT pair_id, {part} AS part, block_id, {cell} AS cell, {st} AS status, CASE WHEN {st} = 'missing' THEN {s} ELSE {o} END AS unit_text, {label('section', 'page', 'slide', table)} AS location FROM {src} WHERE {st} IN ('missing', 'added')"
    columns = "part, block_id, cell, unit_text, location"
    sided = lambda side, p: f"SELECT pair_id, idx AS {side}_idx, {', '.join(f'{c} AS {p}_{c}' for c in columns.split(', '))} FROM pool WHERE status = '{'missing' if side == 'src' else 'added'}'"
    relabelled = "CASE WHEN m.note IS NOT NULL THEN 'reformatted' ELSE r.status END AS status, CASE WHEN m.note IS NOT NULL AND r.status = 'added' THEN m.other_text ELSE r.source_text END AS source_text, CASE WHEN m.note IS NOT NULL AND r.status = 'missing' THEN m.other_text ELSE r.output_text END AS output_text, CASE WHEN m.note IS NULL THEN r.comments WHEN r.comments = '' THEN m.note ELSE r.comments || ' | ' || m.note END AS comments"
    return [
        f"numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id, side, sec_idx ORDER BY block_idx) AS paragraph_number, {normal.format('text')} AS normalized_text FROM {blocks} WHERE {TRIM.format('text')} <> '')",
        f"paras AS MATERIALIZED (SELECT pair_id, side, sec_idx, title, page, slide, row_number() OVER (PARTITION BY pair_id, side, sec_idx ORDER BY block_idx) - 1 AS para_pos, paragraph_number, type, text AS original_text, normalized_text, cells, table_id, CASE WHEN type = 'tableRow' THEN {own} ELSE {cut} END AS sentences FROM numbered WHERE normalized_text <> '')",
        "own_sections AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY sec_idx) - 1 AS idx FROM (SELECT DISTINCT pair_id, side, sec_idx, title, page, slide FROM paras))",
        *(f"sec_{side} AS MATERIALIZED (SELECT pair_id, idx, lower({TRIM.format('coalesce(title, {})'.format(repr('')))}) AS key, lower(coalesce(title, '')) AS text FROM own_sections WHERE side = '{side}')" for side in ("src", "out")),
        *align("sec_ops", "sec_src", "sec_out", sc, SECTION),
        "sec AS MATERIALIZED (SELECT p.pair_id, p.type, p.src_idx, p.out_idx, p.score, p.op_pos AS sec_op, s.sec_idx AS s_sec, o.sec_idx AS o_sec, CASE WHEN p.src_idx IS NULL THEN o.title ELSE s.title END AS title, CASE WHEN p.src_idx IS NULL THEN o.page ELSE s.page END AS page, CASE WHEN p.src_idx IS NULL THEN o.slide ELSE s.slide END AS slide FROM sec_ops p LEFT JOIN own_sections s ON s.side = 'src' AND s.pair_id = p.pair_id AND s.idx = p.src_idx LEFT JOIN own_sections o ON o.side = 'out' AND o.pair_id = p.pair_id AND o.idx = p.out_idx)",
        f"src_p AS MATERIALIZED ({in_section('src', 's')})",
        f"out_p AS MATERIALIZED ({in_section('out', 'o')})",
        *(f"{side}_i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id, sec_op ORDER BY para_pos) - 1 AS idx, normalized_text AS key, normalized_text AS text FROM {side}_p WHERE type <> 'tableRow' AND sec_type IN ('match', 'modify'))" for side in ("src", "out")),
        *align("par_ops", "src_i", "out_i", ps, PARAGRAPH, True),
        "para AS MATERIALIZED (SELECT p.pair_id, p.sec_op, p.type, p.score, p.op_pos AS para_op, s.paragraph_number AS s_number, s.original_text AS s_text, s.sentences AS s_sentences, o.paragraph_number AS o_number, o.original_text AS o_text, o.sentences AS o_sentences FROM par_ops p LEFT JOIN src_i s ON s.pair_id = p.pair_id AND s.sec_op = p.sec_op AND s.idx = p.src_idx LEFT JOIN out_i o ON o.pair_id = p.pair_id AND o.sec_op = p.sec_op AND o.idx = p.out_idx)",
        f"sen_s AS MATERIALIZED ({sentence_items('s')})",
        f"sen_o AS MATERIALIZED ({sentence_items('o')})",
        *align("sen_ops", "sen_s", "sen_o", [*ps, "para_op"], SENTENCE),
        "sen AS MATERIALIZED (SELECT p.*, s.original AS src, s.number AS s_n, o.original AS out, o.number AS o_n FROM sen_ops p LEFT JOIN sen_s s ON s.pair_id = p.pair_id AND s.sec_op = p.sec_op AND s.para_op = p.para_op AND s.idx = p.src_idx LEFT JOIN sen_o o ON o.pair_id = p.pair_id AND o.sec_op = p.sec_op AND o.para_op = p.para_op AND o.idx = p.out_idx)",
        f"told AS MATERIALIZED (SELECT *, CASE WHEN type = 'modify' THEN {comment} ELSE '' END AS comments FROM sen)",
        f"""plain AS MATERIALIZED (
  {whole("src", "delete", "missing", "Entire section removed")}
  UNION ALL {whole("out", "insert", "added", "Entire section added")}
  UNION ALL SELECT pair_id, sec_op, para_op, u.i, 'match', s_number, u.i + 1, u.s, u.o, '' FROM (SELECT *, unnest(list_transform(range(len(s_sentences)), lambda i: {{'i': i, 's': s_sentences[i + 1].original, 'o': coalesce(o_sentences[i + 1].original, s_sentences[i + 1].original)}})) AS u FROM para WHERE type = 'match')
  UNION ALL SELECT pair_id, sec_op, para_op, 0, {status.format("type")}, coalesce(s_number, o_number), NULL, coalesce(s_text, ''), coalesce(o_text, ''), CASE WHEN type = 'modify' THEN 'Content replaced' ELSE '' END FROM para WHERE type IN ('delete', 'insert') OR (type = 'modify' AND score = 0)
  UNION ALL SELECT t.pair_id, t.sec_op, t.para_op, t.op_pos, {status.format("t.type")}, coalesce(p.s_number, p.o_number), coalesce(t.s_n, t.o_n), coalesce(t.src, p.s_text), coalesce(t.out, p.o_text), t.comments FROM told t JOIN para p USING (pair_id, sec_op, para_op))""",
        f"src_t AS MATERIALIZED ({table_items('src')})",
        f"out_t AS MATERIALIZED ({table_items('out')})",
        *align("tab_ops", "src_t", "out_t", [*ps, "table_rank"], TABLE),
        f"tab AS MATERIALIZED (SELECT p.pair_id, p.sec_op, p.table_rank, p.op_pos, p.type, coalesce(s.original_text, '') AS source_text, coalesce(o.original_text, '') AS output_text, CASE WHEN p.type = 'modify' THEN list_transform(range(greatest(len(coalesce(s.cells, [])), len(coalesce(o.cells, [])))), lambda i: {cell('i')}) ELSE [] END AS cells FROM tab_ops p LEFT JOIN src_t s ON s.pair_id = p.pair_id AND s.sec_op = p.sec_op AND s.table_rank = p.table_rank AND s.idx = p.src_idx LEFT JOIN out_t o ON o.pair_id = p.pair_id AND o.sec_op = p.sec_op AND o.table_rank = p.table_rank AND o.idx = p.out_idx)",
        f"tabled AS MATERIALIZED (SELECT *, CASE WHEN type = 'modify' AND len(list_filter(cells, lambda c: c.status <> 'match')) = 0 THEN 'match' ELSE {status.format('type')} END AS status FROM tab)",
        "ids AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY sec_op, kind, p, q) AS block_id FROM (SELECT pair_id, sec_op, 0 AS kind, para_op AS p, sub AS q FROM plain UNION ALL SELECT pair_id, sec_op, 1, table_rank, op_pos FROM tabled))",
        "details0 AS MATERIALIZED (SELECT d.*, i.block_id, coalesce(o.title, '') AS section, o.page, o.slide FROM plain d JOIN ids i ON i.kind = 0 AND i.pair_id = d.pair_id AND i.sec_op = d.sec_op AND i.p = d.para_op AND i.q = d.sub JOIN sec o ON o.pair_id = d.pair_id AND o.sec_op = d.sec_op)",
        "tables0 AS MATERIALIZED (SELECT d.*, '' AS comments, i.block_id, coalesce(o.title, '') AS section, o.page, o.slide FROM tabled d JOIN ids i ON i.kind = 1 AND i.pair_id = d.pair_id AND i.sec_op = d.sec_op AND i.p = d.table_rank AND i.q = d.op_pos JOIN sec o ON o.pair_id = d.pair_id AND o.sec_op = d.sec_op)",
        "cells0 AS MATERIALIZED (SELECT pair_id, block_id, section, page, slide, unnest(cells) AS c FROM tables0)",
        f"pool AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id, status ORDER BY part, block_id, cell) - 1 AS idx, key AS text FROM (SELECT *, {key.format('unit_text')} AS key FROM ({unit('details0', '-1', 'status', 'source_text', 'output_text', 'false', 0)} UNION ALL {unit('tables0', '-1', 'status', 'source_text', 'output_text', 'true', 1)} UNION ALL {unit('cells0', 'c.cell_index', 'c.status', 'c.src_text', 'c.out_text', 'true', 1)})) WHERE length(key) >= 8)",
        "pool_s AS MATERIALIZED (SELECT * FROM pool WHERE status = 'missing')",
        "pool_o AS MATERIALIZED (SELECT * FROM pool WHERE status = 'added')",
        *align("rec_ops", "pool_s", "pool_o", sc, RECONCILE),
        f"rec AS MATERIALIZED (SELECT * FROM rec_ops JOIN ({sided('src', 's')}) USING (pair_id, src_idx) JOIN ({sided('out', 'o')}) USING (pair_id, out_idx) WHERE type IN ('match', 'modify'))",
        "marks AS MATERIALIZED (SELECT pair_id, s_part AS part, s_block_id AS block_id, s_cell AS cell, o_unit_text AS other_text, 'Reformatted — matching content found in ' || o_location AS note FROM rec UNION ALL SELECT pair_id, o_part, o_block_id, o_cell, s_unit_text, 'Reformatted — matching content found in ' || s_location FROM rec)",
        f"details AS MATERIALIZED (SELECT r.pair_id, r.block_id, r.section, r.page, r.slide, r.paragraph_number, r.sentence_number, {relabelled} FROM details0 r LEFT JOIN marks m ON m.part = 0 AND m.cell = -1 AND m.pair_id = r.pair_id AND m.block_id = r.block_id)",
        "cell_marks AS MATERIALIZED (SELECT c.pair_id, c.block_id, c.c.cell_index AS i, c.c.status AS was, c.c.src_text AS s, c.c.out_text AS o, m.other_text AS other_text, m.note AS note FROM cells0 c LEFT JOIN marks m ON m.part = 1 AND m.pair_id = c.pair_id AND m.block_id = c.block_id AND m.cell = c.c.cell_index)",
        """cell_json AS MATERIALIZED (SELECT pair_id, block_id, '[' || string_agg('{"cell_index":' || i || ',"src_text":"' || CASE WHEN note IS NOT NULL AND was = 'added' THEN other_text ELSE s END || '","out_text":"' || CASE WHEN note IS NOT NULL AND was = 'missing' THEN other_text ELSE o END || '","status":"' || CASE WHEN note IS NOT NULL THEN 'reformatted' ELSE was END || '"' || CASE WHEN note IS NOT NULL THEN ',"note":"' || note || '"' ELSE '' END || '}', ',' ORDER BY i) || ']' AS cell_diffs FROM cell_marks GROUP BY pair_id, block_id)""",
        f"rows_t AS MATERIALIZED (SELECT r.pair_id, r.block_id, r.section, r.page, r.slide, 't' || r.table_rank AS table_id, {relabelled}, coalesce(j.cell_diffs, '[]') AS cell_diffs FROM tables0 r LEFT JOIN marks m ON m.part = 1 AND m.cell = -1 AND m.pair_id = r.pair_id AND m.block_id = r.block_id LEFT JOIN cell_json j ON j.pair_id = r.pair_id AND j.block_id = r.block_id)",
    ]


def stats(blocks: str) -> str:
    """Statistics of what compared() gives."""
    n = lambda table, where="true": f"coalesce((SELECT count(*) FROM {table} x WHERE x.pair_id = b.pair_id AND {where}), 0)"
    both = lambda st: f"({n('details0', f'status = {st!r}')} + {n('tables0', f'status = {st!r}')})"
    gone = "EXISTS (SELECT 1 FROM sec o WHERE o.pair_id = x.pair_id AND ((o.type = 'delete' AND x.side = 'src' AND o.s_sec = x.sec_idx) OR (o.type = 'insert' AND x.side = 'out' AND o.o_sec = x.sec_idx)))"
    return f"""SELECT *, CASE WHEN matched + modified + missing + added = 0 THEN 100.0::DOUBLE ELSE floor(matched / (matched + modified + missing + added)::DOUBLE * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE END AS match_percentage FROM (
  SELECT b.pair_id, {n("sec")} AS total_sections, {n("paras", gone)} + {n("para")} AS total_paragraphs, {n("details0")} AS total_sentences, {both("match")} AS matched, {both("modified")} AS modified, greatest(0, {both("missing")} - {n("rec")}) AS missing, greatest(0, {both("added")} - {n("rec")}) AS added, 2 * {n("rec")} AS reformatted FROM (SELECT DISTINCT pair_id FROM {blocks}) b)"""


def redline(name: str, pairs: str) -> list[str]:
    """{name}: id and html (the rendered merged redline) of `pairs` (id, a, b)."""
    escape = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
    remove = "(i > 0 AND (j = 0 OR rows[i][j + 1] >= rows[i + 1][j]))"
    equal = "(i > 0 AND j > 0 AND wa[i] = wb[j])"
    change = f"CASE WHEN {remove} THEN '<del>' || {escape.format('wa[i]')} || '</del>' ELSE '<ins>' || {escape.format('wb[j]')} || '</ins>' END"
    return [
        f"{name}_w AS MATERIALIZED (SELECT id, {WORDS.format('a')} AS wa, {WORDS.format('b')} AS wb FROM {pairs})",
        f"""{name}_t AS (
  SELECT id, wa, wb, 0 AS i, [list_transform(range(len(wb) + 1), lambda x: 0)] AS rows FROM {name}_w
  UNION ALL
  SELECT id, wa, wb, i + 1, list_append(rows, CASE WHEN len(wb) = 0 THEN [0] ELSE list_reduce(range(1, len(wb) + 1), lambda acc, j: list_append(acc, CASE WHEN wa[i + 1] = wb[j] THEN rows[i + 1][j] + 1 ELSE greatest(acc[j], rows[i + 1][j + 1]) END), [0]) END) FROM {name}_t WHERE i < len(wa)
)""",
        f"""{name}_b AS (
  SELECT id, wa, wb, rows, len(wa) AS i, len(wb) AS j, CAST([] AS VARCHAR[]) AS out FROM {name}_t WHERE i = len(wa)
  UNION ALL
  SELECT id, wa, wb, rows, CASE WHEN {equal} OR {remove} THEN i - 1 ELSE i END, CASE WHEN {equal} OR NOT {remove} THEN j - 1 ELSE j END, list_prepend(CASE WHEN {equal} THEN {escape.format("wa[i]")} ELSE {change} END, out) FROM {name}_b WHERE i > 0 OR j > 0
)""",
        f"{name} AS MATERIALIZED (SELECT id, array_to_string(out, ' ') AS html FROM {name}_b WHERE i = 0 AND j = 0)",
    ]


def trimmed(a: str, b: str, source: str) -> str:
    """SELECT of all columns of `source` and source, output, trimmed: columns a and b cut around the change."""
    run = lambda x, y, upto: f"coalesce(list_min(list_filter(range(1, {upto} + 1), lambda i: {x}[i] IS DISTINCT FROM {y}[i])) - 1, {upto})"
    snippet = lambda w, end, n: f"CASE WHEN start > 0 THEN '… ' ELSE '' END || array_to_string({w}[start + 1:{end}], ' ') || CASE WHEN {end} < {n} THEN ' …' ELSE '' END"
    return f"""SELECT * EXCLUDE (wa, wb, na, nb, prefix, suffix, start, e1, e2, whole), CASE WHEN whole THEN coalesce({a}, '') ELSE {snippet("wa", "e1", "na")} END AS source, CASE WHEN whole THEN coalesce({b}, '') ELSE {snippet("wb", "e2", "nb")} END AS output, NOT whole AS trimmed FROM (
  SELECT *, (na <= 20 AND nb <= 20) OR e1 <= start OR e2 <= start AS whole FROM (
    SELECT *, greatest(0, prefix - 4) AS start, least(na, na - suffix + 4) AS e1, least(nb, nb - suffix + 4) AS e2 FROM (
      SELECT *, {run("list_reverse(wa)", "list_reverse(wb)", "(least(na, nb) - prefix)")} AS suffix FROM (
        SELECT *, {run("wa", "wb", "least(na, nb)")} AS prefix FROM (
          SELECT *, len(wa) AS na, len(wb) AS nb FROM (SELECT *, {WORDS.format(f"coalesce({a}, '')")} AS wa, {WORDS.format(f"coalesce({b}, '')")} AS wb FROM {source}))))))"""


ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def reported(rows: str) -> list[str]:
    """reported: the exported rows, with rendered redlines, of what `rows` selects of both_kinds (details and table rows)."""
    said = "CASE WHEN comments <> '' THEN comments ELSE CASE status WHEN 'missing' THEN 'Table row removed' WHEN 'added' THEN 'Table row added' WHEN 'modified' THEN 'Table row modified' ELSE '' END END"
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '') AS {c.split('.')[-1]}"
    return [
        f"both_kinds AS MATERIALIZED (SELECT pair_id, block_id, section, page, slide, paragraph_number, sentence_number, status, source_text, output_text, comments FROM details UNION ALL SELECT pair_id, block_id, section, page, slide, NULL, NULL, status, source_text, output_text, {said} FROM rows_t)",
        f"chosen AS MATERIALIZED ({rows})",
        "long_ones AS MATERIALIZED (SELECT pair_id, block_id, source_text, output_text FROM chosen WHERE status IN ('modified', 'reformatted'))",
        f"cut AS MATERIALIZED ({trimmed('source_text', 'output_text', 'long_ones')})",
        "red_in AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pair_id, block_id) AS id, pair_id, block_id, CASE WHEN trimmed THEN source ELSE source_text END AS a, CASE WHEN trimmed THEN output ELSE output_text END AS b, trimmed FROM cut)",
        *redline("red", "red_in"),
        f"""reported AS (SELECT r.pair_id, r.block_id, {text("r.section")}, {text("r.page")}, {text("r.slide")}, {text("r.paragraph_number")}, {text("r.sentence_number")}, upper(r.status[1]) || r.status[2:] AS status,
  coalesce(i.a, r.source_text, '') AS source_text, coalesce(i.b, r.output_text, '') AS output_text,
  CASE WHEN NOT coalesce(i.trimmed, false) THEN r.comments WHEN r.comments = '' THEN 'Long sentence trimmed to change context' ELSE r.comments || ' (long sentence trimmed to change context)' END AS comments,
  CASE WHEN r.status IN ('modified', 'reformatted') THEN d.html WHEN r.status = 'missing' THEN '<del>' || {ESCAPE.format("r.source_text")} || '</del>' WHEN r.status = 'added' THEN '<ins>' || {ESCAPE.format("r.output_text")} || '</ins>' ELSE {ESCAPE.format("r.source_text")} END AS redline
  FROM chosen r LEFT JOIN red_in i ON i.pair_id = r.pair_id AND i.block_id = r.block_id LEFT JOIN red d ON d.id = i.id)""",
    ]
