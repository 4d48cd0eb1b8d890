"""How much text goes to Python at once in the pipeline."""

from __future__ import annotations

import pyarrow as pa
import pytest

import corpus_pipeline
from flowseries.llm.batches import BYTES

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_TEXT = 16_000


def _largest(docs) -> int:
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return docs.mapInArrow(sizes, "n long").toPandas()["n"].max()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("asked", [None, 1 << 20])
def test_a_stage_sends_texts_in_small_batches(spark, name, stage, asked):
    docs = spark.range(0, 1500, 1, 1).selectExpr("id AS doc_id", f"repeat('word ', {_TEXT // 5}) AS text", "'en' AS lang", "'web' AS source", f"{_TEXT}L AS n_chars")
    before = spark.conf.get(_KEY, None)
    try:
        spark.conf.unset(_KEY) if asked is None else spark.conf.set(_KEY, str(asked))
        stage(spark, docs.limit(0), "")
        # A batch ends with the row that fills it; fewer bytes, where the user asks for them, stay.
        assert _largest(docs) <= (asked or BYTES) + 2 * _TEXT
    finally:
        spark.conf.unset(_KEY) if before is None else spark.conf.set(_KEY, before)
