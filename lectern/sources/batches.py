"""Rows on their way to Python workers, in batches bounded by their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of rows that Spark hands to a Python worker at once.
ARROW_BYTES = 16 << 20


def for_python(rows: DataFrame) -> DataFrame:
    """``rows`` for a kernel in Python: from here on the session's batches hold at most ARROW_BYTES, or one row."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
    return rows
