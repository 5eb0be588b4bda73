"""Fits on bounded samples: which rows they read, and the one task that reads them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from variorum.llm import bytesops as B
from variorum.llm import storage


def training_rows(rows: DataFrame, columns: list[str], most: int, most_bytes: int, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, text and columns (of rows, or of labels by doc_id) of at most `most` distinct rows with texts of at most `most_bytes` in all.

    They come in the order of a hash of doc_id, whole; a row that would go beyond the bytes, and those after it, are left out.
    Texts don't move before the rows are chosen.
    """
    own = [] if labels is not None else columns
    keyed = rows.select("doc_id", "text", *own).withColumn("_text", F.xxhash64("text"))
    ids = keyed.select("doc_id", "_text", *own, F.octet_length("text").cast("long").alias("_size"))
    ids = (ids if labels is None else ids.join(labels.select("doc_id", *columns), "doc_id")).distinct()
    order = [F.xxhash64(F.col("doc_id").cast("long")), "doc_id", "_text", *columns]
    upto = F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = ids.orderBy(*order).limit(most).withColumn("_sum", upto).where(F.col("_sum") <= most_bytes).select("doc_id", "_text", *columns)
    return keyed.join(F.broadcast(storage.kept(chosen, "training-ids")), ["doc_id", "_text", *own]).select("doc_id", "text", *columns)


def distinct(table: pa.Table) -> pa.Table:
    """The table's distinct rows in the order of their values."""
    table = table.sort_by([(n, "ascending") for n in table.column_names])
    same = np.ones(max(table.num_rows - 1, 0), bool)
    for name in table.column_names:
        column = table[name]
        same &= pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy() if table.num_rows > 1 else same
    return table.filter(pa.array(np.concatenate([[True], ~same])[: table.num_rows])) if same.any() else table


def in_one_task(rows: DataFrame, learn: Callable[[pa.Table], object]) -> object:
    """What learn gives for the (bounded) rows, distinct and in the order of their values, in a task that reads them all."""
    names, kinds = rows.columns, to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.rename_columns(names) for b in batches if b.num_rows]
        table = pa.Table.from_batches(held) if held else kinds.empty_table()
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(learn(distinct(table)))]})

    found = rows.repartition(1).mapInArrow(B.task(run), "model binary").head()
    return pickle.loads(found["model"]) if found else learn(kinds.empty_table())
