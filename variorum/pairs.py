"""Document pairs made from the driver's tables, for queries and benches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.sources import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edited_copies(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """pair_id, src and out: every document that has a text, with an edited copy of itself.

    By its number (from the document's id on) a line is dropped, replaced, lengthened or put in capitals; every third copy
    is in reverse order, and all get a line more. tasks: documents are dealt to so many, however few files they are in.
    """
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("src"))
    docs = docs if tasks is None else docs.repartition(tasks, "pair_id", F.xxhash64("src"))
    start = F.coalesce(F.pmod("pair_id", F.lit(2310)), F.lit(0))
    numbered = F.transform(X.line_blocks(F.col("src")), lambda x, i: F.struct((start + i).alias("k"), x.alias("line")))
    left = F.filter(numbered, lambda s: s.k % 7 != 3)

    def edited(s: Column) -> Column:
        line = F.when(s.k % 11 == 4, F.concat(F.lit("Line "), s.k.cast("string"), F.lit(" was replaced as a whole."))).when(s.k % 5 == 2, F.concat(s.line, F.lit(" and some words more")))
        return line.when(s.k % 6 == 1, F.upper(s.line)).otherwise(s.line)

    lines = F.transform(left, edited)
    lines = F.when(start % 3 == 0, F.reverse(lines)).otherwise(lines)
    return docs.withColumn("out", F.array_join(F.concat(lines, F.array(F.lit("This line is new in the copy."))), "\n"))


def sides(pairs: DataFrame) -> DataFrame:
    """pair_id, side, text."""
    return pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("text")), F.struct(F.lit("out").alias("side"), F.col("out").alias("text")))).alias("s")).select("pair_id", "s.*")


def line_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks of pairs, a line each."""
    return X.blocks(sides(pairs), cut=X.line_blocks)


def order_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey with a sentence of an amount, a date and a percentage as src, and one with some of them changed as out."""
    orders = table(spark, sf_dir, "orders")
    amount, day = F.floor("o_totalprice").cast("long"), F.col("o_orderdate").cast("date")

    def sentence(extra: int, later: int) -> Column:
        money = amount + F.pmod("o_orderkey", F.lit(3)) * extra
        date = F.date_add(day, (F.pmod("o_orderkey", F.lit(2)) * later).cast("int"))
        percent = F.concat(F.pmod("o_custkey", F.lit(100)).cast("string"), F.lit("."), F.pmod("o_orderkey", F.lit(10)).cast("string"))
        return F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" totals $"), F.format_number(money, 0), F.lit(" on "), F.date_format(date, "yyyy-MM-dd"), F.lit(" at "), percent, F.lit("% by q"), F.pmod("o_custkey", F.lit(7)).cast("string"), F.lit("@example.com"))

    return orders.select("o_orderkey", sentence(0, 0).alias("src"), sentence(1, 1).alias("out"))
