"""Similarities of texts: edit distance, word subsequences and their combination.

`levenshtein_similarity` is native. The combination is one vectorised function, which returns null below a threshold and so
is evaluated once per pair. Its edit distance is bit-parallel and ends as soon as the threshold is out of reach: many short
pairs at once with machine words, a long pair with big integers, within the band that the distance allows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from variorum.functions import text as T

# The weights of the combination, and the score of texts that differ in numbers only.
LEV_WEIGHT, LCS_WEIGHT, NUMBERS_ONLY = 0.6, 0.4, 0.9
_WS = re.compile(T.WS + "+")
_SKELETON = re.compile(T.SKELETON)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def split_words(text: str | None) -> list[str]:
    return [w for w in _WS.split(text or "") if w]


def edit_distance(a: str, b: str, most: int | None = None, guess: int | None = None) -> int | None:
    """Unit-cost edit distance, by bit vectors on big integers; None as soon as it can't be `most` or less any more.

    guess: the distance to look for first, as near ones cost less; the result doesn't depend on it.
    """
    if a == b:
        return 0
    lo, hi, shortest = 0, 0, min(len(a), len(b))
    while lo < shortest and a[lo] == b[lo]:
        lo += 1
    while hi < shortest - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) > len(b):
        a, b = b, a
    most = len(b) if most is None else min(most, len(b))
    if len(b) - len(a) > most:
        return None
    if not a:
        return len(b)
    bound = most if guess is None else min(most, max(guess, len(b) - len(a)))
    while True:
        distance = _within(a, b, bound)
        if distance is not None and distance <= bound:
            return distance
        if bound == most:
            return None
        # What a band gives is the cost of some path.
        bound = most if distance is None else min(most, distance)


#: Columns whose rows are chosen together, at least.
_COLUMNS = 256


def _within(a: str, b: str, bound: int) -> int | None:
    """The least cost of a path inside the band that paths of cost `bound` keep to; None if that is over bound anyway.

    Such a path leaves the diagonals between both ends by half of what bound leaves. Rows that enter the band start from
    vertical differences of one, and above it every column costs one; so the result is exact if it is bound or less. It is
    the length of b and all vertical differences of a's rows where they leave the band. Bit 0 stands for what is above.
    """
    m, n = len(a), len(b)
    aside = (bound - (n - m)) // 2
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i + 1
    distance, plus, minus, first, last = n, 0, 0, 0, 0
    columns = max(_COLUMNS, n // 32)
    for column in range(0, n, columns):
        to = min(column + columns, n)
        low, high = max(0, min(m, column - (n - m) - aside)), min(m, to + aside)
        gone = (1 << low - first + 1) - 1
        distance += (plus & gone).bit_count() - (minus & gone).bit_count()
        plus = (plus & ~gone) >> low - first | ((1 << high - last) - 1) << last - low + 1
        minus = (minus & ~gone) >> low - first
        first, last = low, high
        full = (1 << high - low + 1) - 1
        rows = full - 1
        some = b[column:to]
        for eq in map({c: where.get(c, 0) >> low & rows for c in set(some)}.__getitem__, some):
            vertical = eq | minus
            same = ((eq & plus) + plus ^ plus) | eq
            up = (minus | (same | plus) ^ full) << 1
            plus = ((plus & same) << 1 | (vertical | up) ^ full) & rows
            minus = up & vertical
        # Each further column lowers it by one at most.
        if high == m and distance - (n - to) + plus.bit_count() - minus.bit_count() - (n - to) > bound:
            return None
    return distance + plus.bit_count() - minus.bit_count()


#: Bits of a machine word, words up to which many pairs are compared at once, and characters of such pairs in memory.
_WORD, _WIDEST, _TABLE = 64, 8, 1 << 21
#: Pairs for each word of theirs from which it pays to compare them together.
_MANY = 20


def edit_distances(a: list[str], b: list[str], most: list[int], guess: list[int] | None = None) -> list[int | None]:
    """edit_distance of many pairs. Those whose shorter text has up to 512 characters go together, column by column, if they are many."""
    out: list[int | None] = [None] * len(a)
    groups: dict[int, list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        shorter, longer = min(len(x), len(y)), max(len(x), len(y))
        if x == y:
            out[i] = 0
        elif longer - shorter > most[i]:
            continue
        elif shorter == 0:
            out[i] = longer
        elif shorter > _WORD * _WIDEST:
            out[i] = edit_distance(x, y, most[i], guess and guess[i])
        else:
            groups.setdefault(-(-shorter // _WORD), []).append(i)
    for words, rows in groups.items():
        if len(rows) < _MANY * words:
            for i in rows:
                out[i] = edit_distance(a[i], b[i], most[i], guess and guess[i])
            continue
        rows.sort(key=lambda i: -max(len(a[i]), len(b[i])))
        at = 0
        while at < len(rows):
            some = rows[at : at + max(1, _TABLE // max(len(a[rows[at]]), len(b[rows[at]])))]
            at += len(some)
            shorts, longs = zip(*(sorted((a[i], b[i]), key=len) for i in some), strict=True)
            found = _together(shorts, longs, np.array([most[i] for i in some]), words)
            for i, d in zip(some, found.tolist(), strict=True):
                out[i] = d if d >= 0 else None
    return out


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and their lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.array([len(t) for t in texts])


def _together(shorts: Sequence[str], longs: Sequence[str], most: np.ndarray, words: int) -> np.ndarray:
    """Distances of pairs whose longer texts come by falling length; -1 where one is over `most`. A column's step over all pairs."""
    n = len(shorts)
    codes, m = _codes(shorts)
    row, place = np.repeat(np.arange(n), m), np.arange(len(codes)) - np.repeat(np.cumsum(m) - m, m)
    keys, slot = np.unique(row << 21 | codes, return_inverse=True)
    masks = np.zeros((len(keys) + 1, words), np.uint64)  # the last row: characters that the shorter text lacks
    np.add.at(masks, (slot, place // _WORD), np.uint64(1) << (place % _WORD).astype(np.uint64))
    codes, length = _codes(longs)
    row, place = np.repeat(np.arange(n), length), np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
    wanted = row << 21 | codes
    slot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    text = np.full((n, int(length.max())), len(keys), np.int32)
    text[row, place] = np.where(keys[slot] == wanted, slot, len(keys))

    out = np.full(n, -1, np.int64)
    alive, distance = np.arange(n), m.copy()
    top_word, top_bit = (m - 1) // _WORD, ((m - 1) % _WORD).astype(np.uint64)
    one, last = np.uint64(1), np.uint64(_WORD - 1)
    plus, minus = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    for j in range(text.shape[1]):
        eqs = masks[text[alive, j]]
        rise, fall = np.ones(len(alive), np.uint64), np.zeros(len(alive), np.uint64)
        for w in range(words):
            p, q, eq = plus[w], minus[w], eqs[:, w]
            vertical = eq | q
            eq = eq | fall
            same = (((eq & p) + p) ^ p) | eq
            up = q | ~(same | p)
            down = p & same
            at = top_word == w
            if at.all():
                distance += (up >> top_bit & one).astype(np.int64) - (down >> top_bit & one).astype(np.int64)
            elif at.any():
                distance[at] += (up[at] >> top_bit[at] & one).astype(np.int64) - (down[at] >> top_bit[at] & one).astype(np.int64)
            over, under = up >> last, down >> last
            up, down = up << one | rise, down << one | fall
            plus[w], minus[w] = down | ~(vertical | up), up & vertical
            rise, fall = over, under
        left = length[alive] - j - 1
        done = left == 0
        out[alive[done & (distance <= most[alive])]] = distance[done & (distance <= most[alive])]
        if done.any() or j % 16 == 15:
            stay = ~done & (distance - left <= most[alive])
            if not stay.all():
                alive, distance, top_word, top_bit, plus, minus = alive[stay], distance[stay], top_word[stay], top_bit[stay], plus[:, stay], minus[:, stay]
                if not len(alive):
                    break
    return out


def subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if (m := where.get(w)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_ratio(a: list[str], b: list[str]) -> float:
    if not a and not b:
        return 1.0
    return 2.0 * subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def combined_scores(a: list[str | None], b: list[str | None], least: float = 0.0) -> list[float | None]:
    """The combined similarities of pairs; None where one is below `least`, which upper bounds tell before the edit distance.

    Equal pairs are scored once, and a text's words and masked numbers are found once.
    """
    a, b = [x or "" for x in a], [x or "" for x in b]
    first: dict[tuple[str, str], int] = {}
    where = [first.setdefault(pair, len(first)) for pair in zip(a, b, strict=True)]
    words: dict[str, list[str]] = {}
    masked: dict[str, str] = {}
    for text in {t for pair in first for t in pair}:
        words[text] = split_words(text)
        masked[text] = _SKELETON.sub("#", text)
    scores: list[float | None] = [None] * len(first)
    due, lefts, rights, most, lcs, guess = [], [], [], [], [], []
    for k, (x, y) in enumerate(first):
        if x == y:
            scores[k] = 1.0
            continue
        longest = max(len(x), len(y))
        numbers_only = masked[x] != x and masked[x] == masked[y]
        likely = 1 - (longest - min(len(x), len(y))) / longest
        if not numbers_only and LEV_WEIGHT * likely + LCS_WEIGHT < least - 1e-9:
            continue
        ratio = lcs_ratio(words[x], words[y])
        if not numbers_only and LEV_WEIGHT * likely + LCS_WEIGHT * ratio < least - 1e-9:
            continue
        # The largest distance that still reaches least; one more for rounding.
        reach = longest if numbers_only else min(longest, int(longest * (1 - (least - LCS_WEIGHT * ratio) / LEV_WEIGHT)) + 1)
        due.append((k, numbers_only, longest))
        lefts.append(x)
        rights.append(y)
        most.append(reach)
        lcs.append(ratio)
        # Texts that share many words are near.
        guess.append(int(longest * (1.1 * (1 - ratio) + 0.02)))
    for (k, numbers_only, longest), ratio, distance in zip(due, lcs, edit_distances(lefts, rights, most, guess), strict=True):
        if distance is not None:
            score = LEV_WEIGHT * (1 - distance / longest) + LCS_WEIGHT * ratio
            score = max(score, NUMBERS_ONLY) if numbers_only else score
            scores[k] = score if score >= least else None
    return [scores[k] for k in where]


def combined(a: str | None, b: str | None, least: float = 0.0) -> float | None:
    """The combined similarity of one pair; None if it is below `least`."""
    return combined_scores([a], [b], least)[0]


def lcs_similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(split_words(p), split_words(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return scored(a, b)


def combined_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Null below `least`. Not deterministic in Spark's sense, so that no filter evaluates it a second time."""

    @F.pandas_udf(DoubleType())
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(combined_scores(x.tolist(), y.tolist(), least), dtype="float64")

    return scored.asNondeterministic()(a, b)
