"""Arrow batch size of the jobs an operator runs itself."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts or token sets come ``rows`` at a time to the Python workers; the session's setting is put back."""
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.set(SETTING, before)
