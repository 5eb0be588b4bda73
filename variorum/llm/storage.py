"""Written tables in the shared folder, as in the core library, and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from variorum.storage import clean, delete, kept, kept_from, new_folder, put, shared_folder  # noqa: F401

#: Bytes of a batch that goes to a Python worker.
BATCH = 8 << 20
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def modest_batches(spark: SparkSession) -> None:
    """Bounds batches by bytes, as rows bound nothing where texts are long; a lower bound of the session's stays."""
    now = spark.conf.get(_KEY).lower().removesuffix("b")
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    digits = now.rstrip("kmg")
    if not digits.isdigit() or not 0 < int(digits) * factor <= BATCH:
        spark.conf.set(_KEY, str(BATCH))
