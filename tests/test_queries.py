"""Every registered query of the engine itself against DuckDB, on the smallest data set."""

import os

import pytest
from compare import duck, spark_rows

from flowseries.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck(SF, registry.ORACLE_SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@needs_data
@pytest.mark.parametrize("kind", ["packet", "probe", "sock", "cwnd", "retransmit_synack", "bad_csum"])
def test_trace_round_trip(spark, kind):
    from flowseries.plans.binary_queries import _round_trip, records_of

    assert spark_rows(_round_trip(kind)(spark, SF)) == spark_rows(records_of(spark, SF, kind))


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.QUERIES) >= 94
