"""Positioned text items of pages (page, str, x, y, width) to lines, table rows and paragraphs; rulings to tables' boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.storage import kept

# Gaps that make a space, a cell and a paragraph; lines of a table id; items and gaps of a table line.
SPACE_GAP, CELL_GAP, PARAGRAPH_GAP, ID_LINES, TABLE_ITEMS, TABLE_GAPS = 1.0, 18.0, 22.0, 4, 3, 2
BULLET_LINE = rf"^{T.WS}*(?:[•▪◦‣∙·–—\-\*]|\d+[.)]){T.WS}+"


def lines(items: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """A row per line (rounded y): its text, its cells, whether it looks like a table's, and its rank from the top."""
    keys = list(keys)
    placed = items.withColumn("line_y", F.floor(F.col("y") + F.lit(0.5)))
    along = Window.partitionBy(*keys, "line_y").orderBy("x", "str")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(along)
    pieces = placed.withColumn("gap", gap).withColumn("cell", F.sum(F.when(F.col("gap") > CELL_GAP, 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.row_number().over(along))
    piece = F.struct("n", "cell", F.concat(F.when(F.col("gap") > SPACE_GAP, F.lit(" ")).otherwise(F.lit("")), F.col("str")).alias("s"))
    grouped = pieces.groupBy(*keys, "line_y").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.count("*").alias("n_items"), F.count_if(F.col("gap") > CELL_GAP).alias("n_gaps"))
    join = lambda xs: T.js_trim(F.regexp_replace(F.array_join(F.transform(xs, lambda x: x["s"]), ""), f"{T.WS}+", " "))
    cells = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("p", lambda x: x["cell"])).cast("int")), lambda c: join(F.filter("p", lambda x: x["cell"] == c)))
    table = (F.col("n_items") >= TABLE_ITEMS) & (F.col("n_gaps") >= TABLE_GAPS)
    top_down = Window.partitionBy(*keys).orderBy(F.desc("line_y"))
    out = grouped.select(*keys, "line_y", join(F.col("p")).alias("text"), cells.alias("cells"), table.alias("is_table"))
    return out.withColumn("line_no", F.row_number().over(top_down) - 1)


def blocks(found: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Table rows, and paragraphs of the lines between them, in order (block_no is the first line's number)."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = found.where("is_table").withColumn("row_index", F.row_number().over(order))
    page = F.col(keys[-1]).cast("string")
    rows = rows.select(*keys, F.col("line_no").alias("block_no"), F.lit("tableRow").alias("type"), F.array_join("cells", " | ").alias("text"), "cells", F.concat(F.lit("page"), page, F.lit("_table_"), F.ceil(F.col("row_index") / ID_LINES).cast("string")).alias("table_id"), F.col("row_index").cast("int").alias("row_index"))
    # A table line ends a paragraph, but the distance is to the last line of text.
    flagged = found.withColumn("tables", F.sum(F.col("is_table").cast("int")).over(upto)).where("not is_table and text <> ''")
    new = F.lag("line_y").over(order).isNull() | (F.lag("line_y").over(order) - F.col("line_y") > PARAGRAPH_GAP) | F.col("text").rlike(BULLET_LINE) | (F.lag("tables").over(order) != F.col("tables"))
    grouped = flagged.withColumn("new", new.cast("int")).withColumn("para", F.sum("new").over(upto))
    paras = grouped.groupBy(*keys, "para").agg(F.min("line_no").alias("block_no"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    kind = F.when(F.col("text").rlike(BULLET_LINE), F.lit("list")).otherwise(F.lit("paragraph"))
    paras = paras.select(*keys, "block_no", kind.alias("type"), "text", F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("int").alias("row_index"))
    return rows.unionByName(paras)


# How far a word may stand out of a table's box, and the distance of lines that begins a paragraph.
BOX_MARGIN, LINE_GAP = 1.0, 8.0
WORD_BULLET = rf"^[•▪◦‣∙·–—\-*]{T.WS}+"


def outside_boxes(words: DataFrame, boxes: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Words (text, x0, x1, top, bottom) that lie in no table's box (x0, x1, top, bottom) of their page."""
    box = boxes.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("x0", "x1", "top", "bottom")))
    inside = (F.col("x0") >= F.col("_x0") - BOX_MARGIN) & (F.col("x1") <= F.col("_x1") + BOX_MARGIN) & (F.col("top") >= F.col("_top") - BOX_MARGIN) & (F.col("bottom") <= F.col("_bottom") + BOX_MARGIN)
    same = [words[k].eqNullSafe(box[k]) for k in keys]
    on = same[0]
    for more in (*same[1:], inside):
        on &= more
    return words.join(box, on, "left_anti")


def word_paragraphs(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Paragraphs of words, top down: lines of one rounded top, cut at wide gaps and at bullets. para_no counts from 0."""
    keys = list(keys)
    line = words.withColumn("line_top", F.rint("top").cast("long"))
    grouped = line.groupBy(*keys, "line_top").agg(T.js_trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")).alias("text"), F.min("top").alias("top"), F.max("bottom").alias("bottom")).where("text <> ''")
    order = Window.partitionBy(*keys).orderBy("line_top")
    gap = F.col("top") - F.lag("bottom").over(order)
    new = F.when(gap.isNull(), 0).when((gap > LINE_GAP) | F.col("text").rlike(WORD_BULLET), 1).otherwise(0)
    numbered = grouped.withColumn("_new", new).withColumn("para_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "para_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_top", "text"))), lambda x: x["text"]), " ").alias("text"))


# How near two rulings come to count as touching, what a ruling may have of thickness, and the side of a grid's square.
TOUCH, THICKNESS, GRID = 1.5, 2.0, 64.0


def table_boxes(rulings: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """keys and x0, x1, top, bottom of every table: what touching rulings (x0, x1, top, bottom) enclose, where two at least run each way.

    A horizontal and a vertical ruling meet by an equi-join on the squares of a grid that both of them cross. Tables are the
    components of what meets, by least numbers that spread until none changes: few rounds, as all lines of a grid meet.
    """
    keys = list(keys)
    flat = F.col("bottom") - F.col("top") <= THICKNESS
    upright = F.col("x1") - F.col("x0") <= THICKNESS
    lines = rulings.where((flat | upright) & ~(flat & upright)).select(*keys, "x0", "x1", "top", "bottom").distinct().withColumn("flat", flat)
    lines = kept(lines.withColumn("id", F.monotonically_increasing_id()), "rulings")
    squares = lambda low, high: F.sequence(F.floor((F.col(low) - TOUCH) / GRID), F.floor((F.col(high) + TOUCH) / GRID))

    def on_grid(df: DataFrame, name: str) -> DataFrame:
        crossed = df.withColumn("gx", F.explode(squares("x0", "x1"))).withColumn("gy", F.explode(squares("top", "bottom")))
        return crossed.select(*keys, "gx", "gy", *(F.col(c).alias(f"{name}_{c}") for c in ("id", "x0", "x1", "top", "bottom")))

    near = lambda low, high: (F.col(f"h_{low}") - TOUCH <= F.col(f"v_{high}")) & (F.col(f"v_{low}") - TOUCH <= F.col(f"h_{high}"))
    meeting = on_grid(lines.where("flat"), "h").join(on_grid(lines.where("not flat"), "v"), [*keys, "gx", "gy"]).where(near("x0", "x1") & near("top", "bottom"))
    edges = meeting.select(F.col("h_id").alias("a"), F.col("v_id").alias("b")).distinct()
    edges = kept(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ruling-edges")
    labels = kept(edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct(), "ruling-labels")
    while True:
        spread = edges.join(labels.select(F.col("id").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        new = labels.join(spread.withColumnRenamed("a", "id"), "id").select("id", F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("fell"))
        new = kept(new, "ruling-labels")
        labels = new.drop("fell")
        if new.where("fell").isEmpty():
            break
    tables = lines.join(labels, "id").groupBy(*keys, "label").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count_if("flat").alias("_flat"), F.count_if(~F.col("flat")).alias("_upright"))
    return tables.where("_flat >= 2 and _upright >= 2").select(*keys, "x0", "x1", "top", "bottom")
