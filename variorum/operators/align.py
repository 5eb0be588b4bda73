"""The alignment join: a full outer one-to-one matching of two sequences within each scope.

Phases: equal keys first come first served; then similar pairs, best score first; then, if asked, leftovers by position;
then what is left over. Order never decides whether two items match, only which of equals do.

Equal keys are an equi-join on (scope, key, running number). Similar pairs are searched among leftovers only: all pairs of
a scope up to `FULL_SCAN`; beyond it a band of positions, which is exploded into an equi-join. The join's own condition
drops pairs whose lengths and shared words (both bounds from above, by numbers alone) can't reach the threshold. What is
left is scored in the stage of the join, by one vectorised function: texts move with items, never with pairs.

The greedy choice is over numbers only. Scopes with very many scored pairs are thinned in rounds over all tasks: pairs that
are the best one of both their items are taken, and what they block goes. The rest is streamed in order, scope by scope,
and only the indexes that are taken are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.functions.similarity import LCS_WEIGHT, LEV_WEIGHT, combined_similarity
from variorum.storage import kept

# The most pairs of a scope that are all scored, and the least half-width of a band.
FULL_SCAN, LEAST_BAND = 200_000, 25
#: Scored pairs of a scope beyond which its best ones are taken in rounds, and the share that a round has to save.
SPREAD, WORTHWHILE = 1 << 20, 0.1
#: Classes that words are counted by.
CLASSES = 32


def match_equal(src: DataFrame, out: DataFrame, scope: list[str]) -> DataFrame:
    """The k-th src item of a key with the k-th out item of that key. Keys go to the join as their SHA-256."""
    digest = F.unhex(F.sha2(F.col("key").cast("binary"), 256))
    nth = F.row_number().over(Window.partitionBy(*scope, "_key").orderBy("idx"))
    a = src.withColumn("_key", digest).select(*scope, "_key", F.col("idx").alias("src_idx"), nth.alias("_n"))
    b = out.withColumn("_key", digest).select(*scope, "_key", F.col("idx").alias("out_idx"), nth.alias("_n"))
    return a.join(b, [*scope, "_key", "_n"]).select(*scope, "src_idx", "out_idx")


def leftovers(items: DataFrame, taken: DataFrame, side: str, scope: list[str]) -> DataFrame:
    return items.join(taken.select(*scope, F.col(f"{side}_idx").alias("idx")), [*scope, "idx"], "left_anti")


def _features(items: DataFrame) -> DataFrame:
    """items with what the bound needs: length, number of words, words counted by classes, and a hash of masked numbers if any."""
    words = F.transform(T.tokens(F.col("text")), lambda w: F.pmod(F.xxhash64(w), F.lit(CLASSES)).cast("int"))
    masked = T.number_skeleton(F.col("text"))
    counts = T.once(words, lambda of: F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.size(F.filter(of, lambda x: x == c)).cast("short")))
    return items.withColumns({"chars": F.length("text"), "classes": counts, "masked": F.when(masked != F.col("text"), F.xxhash64(masked))})


def reachable(least: float) -> Column:
    """Whether the combined similarity of a pair can be `least`, from the features of both (s_*, o_*): no edit distance is
    below the difference of lengths, and no common subsequence is longer than the shared words, of classes no fewer."""
    col = F.col
    longest = F.greatest("s_chars", "o_chars")
    alike = F.when(longest == 0, 1.0).otherwise(F.least("s_chars", "o_chars") / longest)
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    words = total("s_classes") + total("o_classes")
    shared = F.when(words == 0, 1.0).otherwise(2.0 * total(F.zip_with("s_classes", "o_classes", lambda x, y: F.least(x, y))) / words)
    # The cheap bound first: it spares most others.
    cheap = LEV_WEIGHT * alike + LCS_WEIGHT >= least - 1e-9
    return F.coalesce(col("s_masked") == col("o_masked"), F.lit(False)) | (cheap & (LEV_WEIGHT * alike + LCS_WEIGHT * shared >= least - 1e-9))


def candidates(src: DataFrame, out: DataFrame, scope: list[str], full_scan: int = FULL_SCAN, least: float | None = None) -> DataFrame:
    """Pairs (src_idx, out_idx, a, b) whose texts are to be scored; with `least`, without those that can't be so similar."""
    within = Window.partitionBy(*scope)
    tasks = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def placed(items: DataFrame, side: str) -> DataFrame:
        """Items by scope, in as many tasks as a shuffle has: few bytes can be many pairs."""
        more = {} if least is None else {f"{side[0]}_{c}": F.col(c) for c in ("chars", "classes", "masked")}
        own = (items if least is None else _features(items)).repartition(tasks, *scope)
        return own.select(*scope, F.col("idx").alias(f"{side}_idx"), F.col("text").alias("a" if side == "src" else "b"), (F.row_number().over(within.orderBy("idx")) - 1).alias(f"{side}_pos"), F.count("*").over(within).alias(f"{side}_n"), *(c.alias(n) for n, c in more.items()))

    s, o = placed(src, "src"), placed(out, "out")
    sizes = o.select(*scope, "out_n").distinct()
    s = s.join(sizes, scope).withColumn("_band", F.col("src_n") * F.col("out_n") > full_scan)
    wanted = F.lit(True) if least is None else reachable(least)
    every = s.where(~F.col("_band")).join(o.drop("out_n"), scope).where(wanted)
    longest = F.greatest("src_n", "out_n")
    width = F.greatest(F.lit(LEAST_BAND), F.ceil(F.lit(float(full_scan)) / longest))
    center = F.floor(F.col("src_pos") / F.col("src_n") * F.col("out_n") + F.lit(0.5))
    low, high = F.greatest(F.lit(0).cast("long"), center - width), F.least(F.col("out_n") - 1, center + width)
    near = s.where("_band").withColumn("out_pos", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))))
    banded = near.join(o.drop("out_n"), [*scope, "out_pos"]).where(wanted)
    return every.select(*scope, "src_idx", "out_idx", "a", "b").unionByName(banded.select(*scope, "src_idx", "out_idx", "a", "b"))


def _stream(edges: DataFrame, scope: list[str]) -> DataFrame:
    """The greedy choice where edges come scope by scope and in order: an edge is taken while both its items are free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no scope
        used_s: set[int] = set()
        used_o: set[int] = set()
        for batch in batches:
            keep = []
            for at, s, o in zip(zip(*(batch.column(c).to_pylist() for c in scope), strict=True), batch.column("src_idx").to_pylist(), batch.column("out_idx").to_pylist(), strict=True):
                if at != now:
                    now, used_s, used_o = at, set(), set()
                free = s not in used_s and o not in used_o
                keep.append(free)
                if free:
                    used_s.add(s)
                    used_o.add(o)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = edges.repartition(*scope).sortWithinPartitions(*scope, F.desc("score"), "src_idx", "out_idx")
    return ordered.mapInArrow(run, edges.schema)


def _mutual(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Edges that come before all others of both their items."""
    order = F.struct((-F.col("score")).alias("score"), "src_idx", "out_idx")
    best = lambda side: edges.groupBy(*scope, f"{side}_idx").agg(F.min(order).alias("e")).select(*scope, F.col("e.src_idx").alias("src_idx"), F.col("e.out_idx").alias("out_idx"), (-F.col("e.score")).alias("score"))
    return best("src").join(best("out").drop("score"), [*scope, "src_idx", "out_idx"]).select(edges.columns)


def choose(edges: DataFrame, scope: list[str], spread: int = SPREAD) -> DataFrame:
    """Best scores first (ties to the smaller src_idx, then out_idx); a pair is taken while both are free.

    Rounds end when no scope has more than `spread` edges, or when they save little (as where very many scores are equal).
    """
    ids = edges.select(*scope, F.col("src_idx").cast("int").alias("src_idx"), F.col("out_idx").cast("int").alias("out_idx"), "score")
    rest = kept(ids, "edges")
    taken = None
    while rest.count() > spread:
        sizes = kept(rest.groupBy(*scope).count().where(F.col("count") > spread), "crowded")
        before = sizes.agg(F.sum("count")).head()[0]
        if not before:
            break
        crowded = rest.join(sizes, scope, "left_semi")
        best = kept(_mutual(crowded, scope), "mutual")
        taken = best if taken is None else taken.unionByName(best)
        for side in ("src", "out"):
            rest = rest.join(best.select(*scope, f"{side}_idx"), [*scope, f"{side}_idx"], "left_anti")
        rest = kept(rest.select(ids.columns), "edges")
        if rest.join(sizes, scope, "left_semi").count() > (1 - WORTHWHILE) * before:
            break
    last = _stream(rest, scope)
    return last if taken is None else taken.unionByName(last)


def align(src: DataFrame, out: DataFrame, scope: list[str], threshold: float, positional_fallback: bool = False, similarity: Callable[[Column, Column, float], Column] = combined_similarity, full_scan: int = FULL_SCAN) -> DataFrame:
    """(scope, type, src_idx, out_idx, score, op_pos) of all items; type is match, modify, delete or insert.

    src, out: scope columns, idx (from 0), key, text; read several times, so best written tables. Each index appears once. Operations with a src index come first, by
    it; then the inserts by theirs.
    """
    equal = kept(match_equal(src, out, scope), "equal")
    s1, o1 = leftovers(src, equal, "src", scope), leftovers(out, equal, "out", scope)
    # The bound is the combined similarity's.
    pairs = candidates(s1, o1, scope, full_scan, threshold if similarity is combined_similarity else None)
    scored = pairs.withColumn("score", similarity(F.col("a"), F.col("b"), threshold)).where("score is not null")
    chosen = kept(choose(scored.select(*scope, "src_idx", "out_idx", "score"), scope), "chosen")
    s2, o2 = leftovers(s1, chosen, "src", scope), leftovers(o1, chosen, "out", scope)

    def op(df: DataFrame, kind: str, score: Column) -> DataFrame:
        null = F.lit(None).cast("int")
        src_idx = F.col("src_idx").cast("int") if "src_idx" in df.columns else null
        out_idx = F.col("out_idx").cast("int") if "out_idx" in df.columns else null
        return df.select(*scope, F.lit(kind).alias("type"), src_idx.alias("src_idx"), out_idx.alias("out_idx"), score.cast("double").alias("score"))

    ops = op(equal, "match", F.lit(1.0)).unionByName(op(chosen, "modify", F.col("score")))
    if positional_fallback:
        nth = F.row_number().over(Window.partitionBy(*scope).orderBy("idx"))
        a, b = s2.select(*scope, F.col("idx").alias("src_idx"), nth.alias("_n")), o2.select(*scope, F.col("idx").alias("out_idx"), nth.alias("_n"))
        placed = kept(a.join(b, [*scope, "_n"]), "placed")
        ops = ops.unionByName(op(placed, "modify", F.lit(0.0)))
        s2, o2 = leftovers(s2, placed, "src", scope), leftovers(o2, placed, "out", scope)
    ops = ops.unionByName(op(s2.withColumnRenamed("idx", "src_idx"), "delete", F.lit(None))).unionByName(op(o2.withColumnRenamed("idx", "out_idx"), "insert", F.lit(None)))
    order = Window.partitionBy(*scope).orderBy(F.col("src_idx").asc_nulls_last(), "out_idx")
    return ops.withColumn("op_pos", F.row_number().over(order) - 1)
