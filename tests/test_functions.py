import random

import pytest
from pyspark.sql import functions as F

from variorum.functions import similarity as S
from variorum.functions import special, worddiff
from variorum.functions import text as T
from variorum.functions.text import NormalizeOptions


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(("raw", "want"), [("  Hello   World  ", "hello world"), ("• Some bullet point", "some bullet point"), ("“Hello” — test", '"hello" - test'), ("-", "-")])
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize(F.col("t")), t=raw) == want


def test_normalize_punctuation(spark):
    assert one(spark, T.normalize(F.col("t"), NormalizeOptions(ignore_punctuation=True)), t="A, b. (c)!") == "a b c"


@pytest.mark.parametrize(("raw", "n"), [("First sentence. Second sentence! Third one?", 3), ("Just one line of text", 1), ("", 0), ("a\n\nb", 2), ("e.g. this", 1)])
def test_sentences(spark, raw, n):
    assert len(one(spark, T.split_sentences(F.col("t")), t=raw)) == n


def test_patterns(spark):
    found = lambda kind, text: one(spark, T.matches(F.col("t"), kind), t=text)
    assert found("percentage", "grew 2.3% then fell 5.7 % overall") == ["2.3%", "5.7 %"]
    assert "12" in found("number", "spent $5,000 on 12 items")
    assert found("date", "é1/2/2024, 15 Jan 2026, 2026-01-15 and Jan 5th, 2026") == ["1/2/2024", "15 Jan 2026", "2026-01-15", "Jan 5th, 2026"]
    assert found("fiscalYear", "in Q3 FY24 and FY 2025") == ["Q3 FY24", "FY 2025"] or found("fiscalYear", "in Q3 FY24 and FY 2025") == ["FY24", "FY 2025"]
    assert found("email", "to a.b@example.com") == ["a.b@example.com"]


def test_similarity_vectors():
    assert S.combined("same text", "same text") == 1
    assert S.combined("2.3%", "5.7%") >= 0.45
    assert S.combined("apple", "banana") < 0.45
    assert S.combined("apple", "banana", 0.45) is None
    assert S.lcs_ratio("the quick brown fox".split(), "brown fox the quick".split()) == 0.5
    assert S.lcs_ratio([], []) == 1 and S.lcs_ratio(["a"], []) == 0


def test_bit_vectors_equal_tables():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randint(0, 30))) for _ in "ab")
        row = list(range(len(b) + 1))
        lcs = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new, best = [i], [0]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                best.append(lcs[j - 1] + 1 if x == y else max(lcs[j], best[-1]))
            row, lcs = new, best
        assert S.edit_distance(a, b) == row[-1]
        assert S.subsequence(list(a), list(b)) == lcs[-1]


def test_redlines(spark):
    merged = lambda a, b: [(t["type"], t["text"]) for t in one(spark, worddiff.diff_words_merged(F.col("a"), F.col("b")), a=a, b=b)]
    assert merged("the quick brown fox", "the slow brown fox") == [("equal", "the"), ("added", "slow"), ("removed", "quick"), ("equal", "brown"), ("equal", "fox")]
    assert merged("a b", "") == [("removed", "a"), ("removed", "b")]
    assert merged("", "a b c") == [("added", x) for x in "abc"]


def test_trim(spark):
    words = " ".join(f"w{i}" for i in range(21))
    cut = one(spark, worddiff.trim_around_change(F.col("a"), F.col("b")), a=words, b=words.replace("w10", "changed"))
    assert cut["trimmed"] and cut["source"] == "… w6 w7 w8 w9 w10 w11 w12 w13 w14 …" and "changed" in cut["output"]
    assert not one(spark, worddiff.trim_around_change(F.col("a"), F.col("b")), a="short one", b="short two")["trimmed"]


def test_special_changes(spark):
    change = lambda a, b: one(spark, special.changes(F.col("a"), F.col("b")), a=a, b=b)
    c = change("grew 2.3%", "grew 5.7%")
    assert c["percentage"]["removed"] == ["2.3%"] and c["percentage"]["added"] == ["5.7%"] and c["number"] is None
    c = change("on 15/01/2026", "on 20/02/2026")
    assert c["date"] is not None and c["number"] is None
    assert one(spark, special.summary(special.changes(F.col("a"), F.col("b"))), a="FY24 x 5", b="FY25 x 5") == "FiscalYear removed: FY24 | FiscalYear added: FY25"


def test_labels(spark):
    label = one(spark, T.location_label(F.col("s"), F.col("p"), F.lit(3), F.lit(True)), s="Intro", p=1)
    assert label == "Intro — Slide 3 (table)"
    assert one(spark, T.location_label(F.col("s"), F.lit(None).cast("int"), F.lit(3), F.lit(False)), s="Slide 3") == "Slide 3"
    assert one(spark, T.format_bytes(F.col("n")), n=1536) == "1.5 KB"
