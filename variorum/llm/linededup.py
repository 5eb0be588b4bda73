"""Line deduplication, exact and within one edit, by a deletion-neighbourhood join. DataFrame functions only.

Lines are what line feeds separate. A line is dropped if an earlier one equals it or, for lines of `NEAR_FROM` characters
or more, is within one edit of it (a character inserted, deleted or replaced). Earlier means smaller (doc_id, hash of the
text, line number), nulls first, whether that line is itself kept or not; so the result depends on no order of execution.
Blank lines (of spaces, tabs, form feeds and carriage returns) stay. Texts are joined again with line feeds.

1. Equal lines: a pair of 64-bit hashes per line and the least position for each, by partial aggregation.
2. Lines that can have a neighbour: one edit leaves the first or the last half whole. Each distinct line emits hashes of
   both halves, for its own length and for one less; only lines that share one with another line go on. Nothing is lost.
3. Their neighbourhood: every variant with one character deleted is emitted as a hashed key with its place. Two lines of
   one variant and place differ by a replacement; a line that is a variant of another differs by a deletion. Both are found
   by one shuffle of (key, place, number of the line). In a group of equal keys each line is paired with the earliest only
   (all in such a group are within one edit of each other), so pairs grow with lines and not with their square. A key is hashed from three parts: what stands before the `SEGMENT`
   characters around the place, the segment without the character, and what stands behind. The outer two are hashed once
   for a segment, so a line of n characters costs about SEGMENT hashed characters for a variant, and not n.
4. Pairs are verified by edit distance, the later line goes, and the texts are assembled from the lines left.

Lines and texts may be of any length. Identical rows count as one document: both keep the same lines. Null texts stay null,
empty texts empty, an empty table stays empty. Extra columns are kept; n_lines, n_equal and n_near (lines dropped by 1 and
by 3) are added in place of any columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.llm import storage

#: Characters from which a line has near duplicates besides equal ones.
NEAR_FROM = 20
#: The most edits between near lines. One is what makes all lines of one variant and place each other's neighbours.
EDITS = 1
#: Characters around a deleted one that are hashed with each variant.
SEGMENT = 64
#: Variants that a task emits.
VARIANTS = 2_000_000
#: Bits of a sieve, 8 MB: before few of many rows are joined by shuffle, most others are held back by the bits of their keys.
SIEVE = 1 << 26
_BLANK = " \t\r\f"


def _sieved(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys hash to the bit of some row of wanted: all that match one, and few others."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(SIEVE)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_map"))
    byte = F.expr("cast(conv(hex(substring(_map, cast(bitmap_bit_position(_bit) div 8 + 1 as int), 1)), 16, 10) as int)")
    # At most SIEVE bits in all, whatever wanted holds.
    hit = df.withColumn("_bit", bit).join(F.broadcast(maps), F.bitmap_bucket_number("_bit") == F.col("_bucket")).withColumn("_byte", byte)
    return hit.where("(shiftright(_byte, cast(bitmap_bit_position(_bit) % 8 as int)) & 1) = 1").select(df.columns)


def _hashes(line: Column) -> dict[str, Column]:
    """Two hashes with different seeds: lines are the same if both are."""
    return {"h1": F.xxhash64(line), "h2": F.xxhash64(F.lit(17), line)}


def _halves(near_from: int) -> Column:
    """Hashes of both halves of `line`, for pairs whose shorter line has its length or one less."""
    out = []
    for shortest in ("n", "n - 1"):
        out.append(f"xxhash64(1, {shortest}, substring(line, 1, ({shortest}) div 2))")
        out.append(f"xxhash64(2, {shortest}, substring(line, cast(n - ({shortest}) div 2 + 1 as int), ({shortest}) div 2))")
    return F.expr(f"case when n >= {near_from} then array({', '.join(out)}) end")


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank, with their positions."""
    split = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(F.btrim("line", F.lit(_BLANK)) != "")


def _segments(length: str) -> str:
    """SQL: the segments of a line of `length` characters, numbers and sizes."""
    return f"transform(sequence(0, ({length} - 1) div {SEGMENT}), j -> struct(j * {SEGMENT} as s, least({SEGMENT}, {length} - j * {SEGMENT}) as m))"


def _variants() -> Column:
    """place and variant (a hash) of every deletion of one character of `line`."""
    outer = "xxhash64(7, substring(line, 1, g.s)) as before, xxhash64(9, substring(line, g.s + g.m + 1)) as behind, substring(line, g.s + 1, g.m) as own"
    parts = f"transform({_segments('length(line)')}, g -> struct(g.s, g.m, {outer}))"
    one = "xxhash64(p.before, concat(substring(p.own, 1, i - 1), substring(p.own, i + 1)), p.behind)"
    return F.expr(f"flatten(transform({parts}, p -> transform(sequence(1, p.m), i -> struct(p.s + i as place, {one} as variant))))")


def _as_variant() -> Column:
    """The keys under which a line of one character more would emit `line`, one for each of its segments."""
    return F.expr(f"transform({_segments('(length(line) + 1)')}, g -> xxhash64(xxhash64(7, substring(line, 1, g.s)), substring(line, g.s + 1, g.m - 1), xxhash64(9, substring(line, g.s + g.m))))")


def _position() -> Column:
    return F.struct("doc_id", "text_hash", "line_no")


def dedup(docs: DataFrame, near_from: int = NEAR_FROM, edits: int = EDITS) -> DataFrame:
    """docs with texts from which repeated lines are gone.

    near_from: characters from which lines within `edits` of an earlier one go too; edits: 1, or 0 for equal lines only.
    """
    if edits not in (0, 1):
        raise ValueError("lines of one deletion variant are within one edit of each other, so edits is 0 or 1")
    base = docs.drop("n_lines", "n_equal", "n_near")
    lines = _lines(base)

    # 1. Distinct lines and their first positions.
    hashed = lines.withColumn("n", F.length("line")).select(*(c.alias(k) for k, c in _hashes(F.col("line")).items()), _position().alias("at"), (_halves(near_from) if edits else F.lit(None).cast("array<bigint>")).alias("halves"))
    distinct = storage.kept(hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.any_value("halves").alias("halves")), "line-distinct")

    # 2. Lines that share a half with another line.
    keys = distinct.where("halves is not null").select("h1", "h2", F.explode("halves").alias("half"))
    shared = storage.kept(keys.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half"), "line-halves")
    possible = storage.kept(_sieved(keys, shared, ["half"]).join(shared, "half", "left_semi").select("h1", "h2").distinct(), "line-possible")

    # 3. Their texts, then their variants.
    order = ["doc_id", "text_hash", "line_no"]
    first = _sieved(distinct, possible, ["h1", "h2"]).join(possible, ["h1", "h2"], "left_semi").select("h1", "h2", "at.*")
    first = storage.kept(first, "line-first")
    placed = first.select("h1", "h2", *(F.col(c).alias(f"_{c}") for c in order))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("line_no") == F.col("_line_no"))
    texts = _sieved(lines, first, order).join(placed, same).select("h1", "h2", *(F.col(f"_{c}").alias(c) for c in order), "line").dropDuplicates(["h1", "h2"])
    # Numbers in the order of first positions stand for lines from here on.
    texts = storage.kept(texts.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "line", F.monotonically_increasing_id().alias("id")), "line-texts")
    # A line becomes as many rows as it has characters: tasks are dealt by characters, not by lines.
    size = texts.agg(F.sum(F.length("line"))).head()[0] or 0
    spread = texts.repartition(1 + size // VARIANTS, "id")
    variants = spread.select("id", F.explode(_variants()).alias("v")).select("v.variant", "v.place", "id")
    whole = texts.select(F.explode(F.array_distinct(_as_variant())).alias("variant"), F.lit(0).alias("place"), "id")
    # One shuffle: of the rows of a variant, a line that is the variant itself comes first, then those of each place. They are
    # distinct lines that differ in one character, so few; and running windows hold none of them.
    keyed = variants.unionByName(whole)
    leader = F.first("id").over(Window.partitionBy("variant", "place").orderBy("id"))
    itself = F.first(F.when(F.col("place") == 0, F.col("id"))).over(Window.partitionBy("variant").orderBy("place", "id"))
    led = keyed.withColumns({"leader": leader, "itself": itself}).where("place > 0 and (leader <> id or itself is not null)")
    linked = led.select(F.explode(F.array_compact(F.array(F.when(F.col("leader") != F.col("id"), F.struct(F.col("leader").alias("early"), F.col("id").alias("late"))), F.when(F.col("itself").isNotNull() & (F.col("itself") != F.col("id")), F.struct(F.least("itself", "id").alias("early"), F.greatest("itself", "id").alias("late")))))).alias("p"))
    pairs = linked.select("p.early", "p.late").distinct()

    # 4. Verification, and the lines that stay.
    late = texts.select(F.col("id").alias("late"), F.col("line").alias("a"), *order)
    checked = pairs.join(late, "late").join(texts.select(F.col("id").alias("early"), F.col("line").alias("b")), "early")
    gone = checked.where(F.levenshtein("a", "b", 1) >= 0).select(*order).distinct()
    both = distinct.select("at.*", F.lit(False).alias("near")).unionByName(gone.withColumn("near", F.lit(True)))
    numbers = lambda near: F.collect_list(F.when(F.col("near") == near, F.col("line_no")))
    stay = both.groupBy("doc_id", "text_hash").agg(F.array_except(numbers(False), numbers(True)).alias("_stay"), F.count_if("near").alias("n_near"))
    stay = stay.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "_stay", "n_near")

    joined = base.withColumn("_text_hash_own", F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_text_hash_own") == F.col("_text_hash")), "left")
    split = joined.withColumn("_lines", F.split("text", "\n"))
    blanks = F.expr(f"filter(transform(_lines, (x, i) -> if(btrim(x, '{_BLANK}') = '', i, null)), i -> i is not null)")
    placed = split.withColumn("_blank", blanks).withColumn("_all", F.array_sort(F.concat(F.coalesce("_stay", F.expr("array()")), "_blank")))
    new = F.array_join(F.transform("_all", lambda i: F.get(F.col("_lines"), i)), "\n")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long")
    near = F.coalesce("n_near", F.lit(0)).cast("long")
    equal = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_all")).cast("long") - near
    out = placed.withColumns({"n_lines": n_lines, "n_near": near, "n_equal": equal, "_new": F.when(F.col("text").isNotNull(), new)})
    return out.select(*(F.col("_new").alias("text") if c == "text" else F.col(c) for c in base.columns), "n_lines", "n_equal", "n_near")
