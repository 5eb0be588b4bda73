"""Word-level redlines, and snippets around a change."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.functions.similarity import split_words
from variorum.functions.text import once

# Words of context kept, and the length up to which texts aren't trimmed.
CONTEXT, TRIM_FROM = 4, 20
TOKEN = "array<struct<type:string,text:string>>"


def _script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """The merged redline: where removing and adding are equally good from the end, removing is taken first there.

    Column j of the table of common subsequences is a bit row: bit i is 0 where the entry of a[:i + 1] is one more than that of
    a[:i], so an entry is a count of zeros. Of m columns, every sqrt(m)-th is kept; the walk back computes those between anew,
    a stretch at a time. So about 2 n sqrt(m) bits are held, and each column is computed twice.
    """
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    step = math.isqrt(len(b)) + 1

    def after(v: int, words: list[str]) -> Iterator[int]:
        for w in words:
            u = v & where.get(w, 0)
            v = ((v + u) | (v - u)) & full
            yield v

    marks = [full]
    for j, v in enumerate(after(full, b), 1):
        if j % step == 0:
            marks.append(v)
    out: list[tuple[str, str]] = []
    i, j, at, columns = len(a), len(b), len(marks), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("equal", a[i]))
            continue
        remove = bool(i) and not j
        if i and j:
            if (j - 1) // step < at:
                at = (j - 1) // step
                columns = [marks[at], *after(marks[at], b[at * step : (at + 1) * step])]
            low = (1 << i) - 1
            # The entries at (i - 1, j) and (i, j - 1).
            up = i - 1 - (columns[j - at * step] & (low >> 1)).bit_count()
            left = i - (columns[j - 1 - at * step] & low).bit_count()
            remove = up >= left
        if remove:
            i -= 1
            out.append(("removed", a[i]))
        else:
            j -= 1
            out.append(("added", b[j]))
    return out[::-1]


def diff_words_merged(a: Column, b: Column) -> Column:
    """One list of equal, removed and added words."""

    @F.pandas_udf(TOKEN)
    def merged(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"type": k, "text": w} for k, w in _script(split_words(p), split_words(q))] for p, q in zip(x, y, strict=True)])

    return merged(a, b)


def diff_words(merged: Column) -> Column:
    """Two lists from the merged one: what the source has, and what the output has."""
    return F.struct(F.filter(merged, lambda t: t["type"] != "added").alias("src"), F.filter(merged, lambda t: t["type"] != "removed").alias("out"))


def render(merged: Column) -> Column:
    """Marked HTML of a redline."""
    tag = lambda t, name: F.concat(F.lit(f"<{name}>"), T.escape_html(t["text"]), F.lit(f"</{name}>"))
    return F.array_join(F.transform(merged, lambda t: F.when(t["type"] == "removed", tag(t, "del")).when(t["type"] == "added", tag(t, "ins")).otherwise(T.escape_html(t["text"]))), " ")


def render_row(status: Column, source: Column, output: Column, merged: Column) -> Column:
    """Marked HTML of a row: what is missing is removed, what is added is new, a change shows its merged redline, else the text."""
    text = lambda c: T.escape_html(F.coalesce(c, F.lit("")))
    whole = F.when(F.coalesce(source, F.lit("")) != "", source).otherwise(output)
    return (
        F.when(status == "missing", F.concat(F.lit("<del>"), text(source), F.lit("</del>")))
        .when(status == "added", F.concat(F.lit("<ins>"), text(output), F.lit("</ins>")))
        .when(status.isin("modified", "reformatted"), render(merged))
        .otherwise(text(whole))
    )


def trim_around_change(src: Column, out: Column, context: int = CONTEXT, threshold: int = TRIM_FROM) -> Column:
    """struct<source, output, trimmed>: both texts cut to the words around the first and last difference."""
    # Each level is computed once: words, then how many are equal from the start and from the end, then where to cut.
    words = F.struct(T.tokens(src).alias("a"), T.tokens(out).alias("b"), F.coalesce(src, F.lit("")).alias("src"), F.coalesce(out, F.lit("")).alias("out"))

    def alike(x: Column, y: Column) -> Column:
        """How many leading words are equal. The shorter text is filled up with nulls, which equal no word."""
        first = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(first > 0, first - 1).otherwise(F.size(x)).cast("int")

    def measured(w: Column) -> Column:
        return F.struct(w["a"].alias("a"), w["b"].alias("b"), w["src"].alias("src"), w["out"].alias("out"), alike(w["a"], w["b"]).alias("prefix"), alike(F.reverse(w["a"]), F.reverse(w["b"])).alias("suffix"))

    def placed(w: Column) -> Column:
        na, nb = F.size(w["a"]), F.size(w["b"])
        suffix = F.least(w["suffix"], F.least(na, nb) - w["prefix"])
        return F.struct(
            w["a"].alias("a"), w["b"].alias("b"), w["src"].alias("src"), w["out"].alias("out"), na.alias("na"), nb.alias("nb"),
            F.greatest(F.lit(0), w["prefix"] - context).alias("start"), F.least(na, na - suffix + context).alias("a_end"), F.least(nb, nb - suffix + context).alias("b_end"),
        )

    def cut(w: Column) -> Column:
        start = w["start"]
        whole = ((w["na"] <= threshold) & (w["nb"] <= threshold)) | (w["a_end"] <= start) | (w["b_end"] <= start)

        def snippet(side: Column, end: Column, n: Column) -> Column:
            middle = F.array_join(F.slice(side, start + 1, F.greatest(end - start, F.lit(0))), " ")
            return F.concat(F.when(start > 0, F.lit("… ")).otherwise(F.lit("")), middle, F.when(end < n, F.lit(" …")).otherwise(F.lit("")))

        return F.struct(
            F.when(whole, w["src"]).otherwise(snippet(w["a"], w["a_end"], w["na"])).alias("source"),
            F.when(whole, w["out"]).otherwise(snippet(w["b"], w["b_end"], w["nb"])).alias("output"),
            (~whole).alias("trimmed"),
        )

    return once(words, lambda w: once(measured(w), lambda m: once(placed(m), cut)))
