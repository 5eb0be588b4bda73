"""From raw documents to token digests: five stages over whole tables.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents. Texts are whole throughout; a document without an id, with a null text
or with an empty text passes the filters (nothing speaks against it), unless line dedup has emptied it.

Cases. A stage reads the columns of documents and no others, whatever their names. Rows that repeat a doc_id count as one
document where documents are chosen: all stay or all go (toxicity and line dedup judge each row). Repeated rows stay
repeated. Tables without rows give tables without rows; without labels nothing is toxic, without benchmark nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm import bpe, decontam, linededup, neardup, storage, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs whose doc_id isn't among bad's."""
    return docs.join(bad.select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence-level model does not predict to be toxic."""
    storage.modest_batches(spark)
    docs = docs.select(COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).where("predicted = 0").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals; n_chars follows the text."""
    return linededup.dedup(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def _unemptied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose lines are all gone though they had some: copies of what stands elsewhere."""
    blank = F.btrim("text", F.lit(" \t\r\f\n")) == ""
    bare = docs.where(blank)
    origin = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", blank.alias("blank"))
    emptied = origin.join(bare.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.coalesce("blank", F.lit(False))).alias("blank")).where("not blank")
    return docs.where(~F.coalesce(blank, F.lit(False))).unionByName(_without(bare, emptied)).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the document with the smallest id; of emptied copies, none."""
    storage.modest_batches(spark)
    docs = storage.kept(_unemptied(spark, docs.select(COLUMNS), sf_dir), "unemptied")
    copies = neardup.classes(docs).where("class_id <> doc_id")
    return _without(docs, copies)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage was found."""
    storage.modest_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontam.leaks(docs.select(COLUMNS), benchmark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    storage.modest_batches(spark)
    return bpe.digests(docs.select(COLUMNS))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: Trained models, rank retrieval and merges are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
