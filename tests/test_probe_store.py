"""What the queries over a probe's store work out, and how often."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowseries.operators import metrics
from flowseries.plans import store_queries, testmaps

_FLOWS, _LINES = 3, 40


@pytest.fixture
def lines(spark, tmp_path):
    rows = [(i, i * 2, i % _FLOWS if i else None, 1, float(i % 7), 0.05, 0.01) for i in range(_LINES)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_ids_at_hand_are_those_of_each_point(spark, lines):
    whole, known = testmaps.probe_points(spark, lines), testmaps.probe_points(spark, lines, testmaps.probe_series(spark, lines))
    assert known.schema.simpleString() == whole.schema.simpleString() and known.count() == 4 * _LINES
    assert sorted(known.collect(), key=str) == sorted(whole.collect(), key=str)


def test_saving_again_works_out_no_point_again(spark, lines, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    compute, count = metrics.UpperWindow.compute, F.udf(counted, "long").asNondeterministic()
    monkeypatch.setattr(metrics.UpperWindow, "compute", lambda self, points: compute(self, points).withColumn("value_int", count("value_int")))
    rows = store_queries.metric_save(spark, lines).collect()
    want = [(i % _FLOWS, "UPPER_WND", float(8 * i + 1), 2 * i + i % 7) for i in range(1, _LINES)]
    assert sorted(tuple(r) for r in rows if r.flow_id is not None) == sorted(want) and len(rows) == _LINES
    assert made.value == _LINES
