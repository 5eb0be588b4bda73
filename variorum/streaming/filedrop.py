"""Comparison of pairs as their files arrive: a stream of binary files, compared by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from variorum import storage
from variorum.plans.compare import compare_documents
from variorum.sources import files


def _waiting(spark: SparkSession, path: str) -> DataFrame:
    """The unpaired documents written at path; none where nothing was written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(files.PARSED).parquet(path) if there else spark.createDataFrame([], files.PARSED)


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Files named `<pair>.src.<ext>` and `<pair>.out.<ext>` below folder; rows and stats are appended below target.

    A pair is compared in the batch in which its second file comes. What is still unpaired after a batch is written below
    target/waiting, which has to stay as long as checkpoint does; of a side that comes again before its partner, the
    later file counts. What a batch writes on its way is freed at its end. The batch number partitions the output and what waits, so a repeated batch overwrites its own.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    arriving = found.select(F.xxhash64(F.regexp_extract(name, r"^(.+)\.(?:src|out)\.[^.]+$", 1)).alias("pair_id"), F.regexp_extract(name, r"\.(src|out)\.[^.]+$", 1).alias("side"), name.alias("file_name"), "content", "modificationTime").where("side <> ''")

    def compare(batch: DataFrame, number: int) -> None:
        with storage.freed():
            compared(batch, number)

    def compared(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # Of a side that comes more than once in a batch, the latest file counts (of equally late ones, the last by name).
        latest = batch.groupBy("pair_id", "side").agg(F.max(F.struct("modificationTime", "file_name")).alias("_l")).select("pair_id", "side", "_l.file_name")
        new = storage.kept(files.parse_documents(batch.drop("modificationTime").join(latest, ["pair_id", "side", "file_name"])), "arrived")
        before = _waiting(session, f"{target}/waiting/batch={number - 1}")
        documents = new.unionByName(before.join(new.select("pair_id", "side").distinct(), ["pair_id", "side"], "left_anti").select(new.columns))
        complete = storage.kept(documents.groupBy("pair_id").agg(F.count_distinct("side").alias("sides")).where("sides = 2"), "complete")
        documents.join(complete, "pair_id", "left_anti").select(new.columns).write.mode("overwrite").parquet(f"{target}/waiting/batch={number}")
        if not complete.isEmpty():
            result = compare_documents(files.blocks(documents.join(complete, "pair_id", "left_semi")))
            for table, df in (("rows", result.detail_rows), ("stats", result.stats)):
                df.write.mode("overwrite").parquet(f"{target}/{table}/batch={number}")
        # The batch before this one is needed if this one is repeated; older ones aren't.
        storage.delete(session, f"{target}/waiting/batch={number - 2}")

    writer = arriving.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
