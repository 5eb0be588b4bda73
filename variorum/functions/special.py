"""Changes in numbers, dates, addresses: multiset differences of pattern matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from variorum.functions import text as T

#: In the order in which comments name them.
KINDS = ("percentage", "currency", "fiscalYear", "date", "email", "url", "number")
LABELS = {k: k[0].upper() + k[1:] for k in KINDS}


def multiset_minus(a: Column, b: Column) -> Column:
    """Of each distinct value of a, in order of first appearance, as many as a has more than b."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.flatten(F.transform(F.array_distinct(a), lambda v: F.array_repeat(v, F.greatest(F.lit(0), count(a, v) - count(b, v)))))


def found(c: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """A struct of the matches of each kind in a text."""
    return F.struct(*(T.matches(T.unclaimed(c) if k == "number" else c, k).alias(k) for k in kinds))


def changes(src: Column, out: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """A struct with a field for each kind, {added, removed}, null where nothing changed."""
    none = F.lit(None).cast("struct<added:array<string>,removed:array<string>>")

    def compared(both: Column) -> Column:
        a, b = both["a"], both["b"]

        def one(kind: str) -> Column:
            pair = F.struct(multiset_minus(b[kind], a[kind]).alias("added"), multiset_minus(a[kind], b[kind]).alias("removed"))
            told = T.once(pair, lambda p: F.when((F.size(p["added"]) > 0) | (F.size(p["removed"]) > 0), p))
            return F.when(a[kind] != b[kind], told).otherwise(none)

        return F.struct(*((one(k) if k in kinds else none).alias(k) for k in KINDS))

    if not kinds:
        return F.struct(*(none.alias(k) for k in KINDS))
    return T.once(F.struct(found(src, kinds).alias("a"), found(out, kinds).alias("b")), compared)


def summary(special: Column) -> Column:
    """`Label removed: a, b | Label added: c`."""
    parts = []
    for kind in KINDS:
        for side in ("removed", "added"):
            values = special[kind][side]
            parts.append(F.when(F.size(values) > 0, F.concat(F.lit(f"{LABELS[kind]} {side}: "), F.array_join(values, ", "))))
    return F.array_join(F.array_compact(F.array(*parts)), " | ")
