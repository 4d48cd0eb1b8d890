"""Arrow batches in small slices, so that a task holds few rows as Python values at a time; names for columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = 256
#: Bytes of a batch on its way to Python; a batch stands in the JVM and, while the next one is read, twice in Python.
BYTES = 8 << 20
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python in batches of ``BYTES`` (or less, where less was asked for) and one
    row at most. It is read when a plan runs, so it can't be set for a single table; no result depends on it."""
    asked = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < asked <= BYTES:
        spark.conf.set(_BYTES_KEY, str(BYTES))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
