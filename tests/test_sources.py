import json
import os
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_points import pts

from flowseries.operators import bounds, points
from flowseries.schema import BAD_CSUM
from flowseries.sources import trace
from flowseries.sources.store import FlowStore, ForeignStore, Selection, scratch_store
from flowseries.streaming import live

FLOW = ("10.0.0.1", "10.0.0.2", 100, 200, 6)


def bad_csum_file(path, n, flip=(), tail=b""):
    rows = np.zeros(n, dtype=BAD_CSUM.dtype)
    rows["time"] = np.arange(n)
    rows["marker"] = np.void(b"\xff" * 4)
    for i in flip:
        rows["marker"][i] = np.void(b"\0" * 4)
    path.write_bytes(rows.tobytes() + tail)


@pytest.fixture
def store(spark):
    s = scratch_store(spark)
    s.add_flows(spark.createDataFrame([FLOW], "src string, dst string, sport int, dport int, l4proto int"))
    return s


def test_tail_and_ranges(spark, tmp_path):
    bad_csum_file(tmp_path / "bad_csum.tcp", 1000, tail=b"abc")
    df = trace.read_trace(spark, str(tmp_path / "bad_csum.tcp"), "bad_csum", partitionBytes=1234)
    assert df.rdd.getNumPartitions() == 17
    assert [r.time for r in df.orderBy("_offset").collect()] == list(range(1000))


def test_modes(spark, tmp_path):
    bad_csum_file(tmp_path / "x.tcp", 10, flip=(3,))
    read = lambda m: trace.read_trace(spark, str(tmp_path), "bad_csum", mode=m)
    with pytest.raises(PySparkException):
        read("FAILFAST").collect()
    assert read("DROPMALFORMED").count() == 9
    rows = read("PERMISSIVE").orderBy("_offset").collect()
    assert len(rows) == 10 and rows[3]._corrupt and rows[3].time is None and not rows[4]._corrupt


def test_empty_absent_and_columns(spark, tmp_path):
    (tmp_path / "xdp.tcp").write_bytes(b"")
    assert trace.read_trace(spark, str(tmp_path / "xdp.tcp"), "packet").count() == 0
    assert trace.read_trace(spark, str(tmp_path / "none"), "packet").count() == 0
    bad_csum_file(tmp_path / "bad_csum.tcp", 4)
    assert trace.read_trace(spark, str(tmp_path / "bad_csum.tcp"), "bad_csum", columns="time").columns == ["time", "direction"]
    assert set(trace.read_trace_dir(spark, str(tmp_path))) == {"packet", "bad_csum"}


def test_stream_is_batch_and_grows(spark, tmp_path):
    source, out = tmp_path / "t", tmp_path / "out"
    source.mkdir()

    def drain():
        s = trace.stream_trace(spark, str(source), "bad_csum", partitionBytes=100).select("time")
        s.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.time for r in spark.read.parquet(str(out)).collect())

    bad_csum_file(source / "a.tcp", 20, tail=b"x" * 7)
    assert drain() == list(range(20))
    bad_csum_file(source / "a.tcp", 50)
    bad_csum_file(source / "b.tcp", 5)
    assert drain() == sorted([*range(50), *range(5)])
    assert drain() == sorted([*range(50), *range(5)])


def test_append_adds(spark, tmp_path):
    path, out = f"file://{tmp_path}/t", str(tmp_path / "out")
    some = lambda a, b: spark.range(a, b).selectExpr("id AS time", "id AS saddr").selectExpr("time", "cast(null as binary) AS saddr")

    def drain():
        s = trace.stream_trace(spark, path, "bad_csum").select("time")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.time for r in spark.read.parquet(out).collect())

    trace.write_trace(some(0, 5), path, "bad_csum")
    assert drain() == list(range(5))
    trace.write_trace(some(5, 12), path, "bad_csum")
    assert sorted(r.time for r in trace.read_trace(spark, path, "bad_csum").collect()) == list(range(12)) == drain()
    record = lambda n: spark.createDataFrame([(bytes(16) + b"\xff" * 4,)] * n, "record binary")
    trace.write_raw(record(2), path)
    trace.write_raw(record(3), path)
    assert trace.read_trace(spark, path, "bad_csum").count() == 17
    trace.write_trace(some(0, 4), path, "bad_csum", mode="overwrite")
    assert sorted(r.time for r in trace.read_trace(spark, path, "bad_csum").collect()) == list(range(4))


def test_store_script(spark, store):
    """The life of a flow: attributes and series added, set, listed and deleted."""
    flow = store.flow(*FLOW).first().id
    store.add_flows(store.flows.select("src", "dst", "sport", "dport", "l4proto"))
    assert store.flows.count() == 1
    attr = lambda name, tag, **v: spark.createDataFrame([(flow, name, tag, v.get("i"), None, None, v.get("t"))], "flow_id long, name string, type int, value_int long, value_float double, value_bool boolean, value_text string")
    store.set_attributes(attr("TEST", 3, t="TEST"))
    store.set_attributes(attr("TEST", 0, i=100))
    store.set_attributes(attr("TEST2", 3, t="x"))
    assert store.attribute(flow, "TEST").first().value_int == 100 and store.list_attributes(flow).count() == 2
    store.delete_attribute(flow, "TEST2")
    with pytest.raises(KeyError):
        store.attribute(flow, "TEST2")
    p = pts(spark, [(flow, "TestTS", t, v) for t, v in ((0.0, 10), (0.5, 10), (1.0, 11))])
    store.create_series(points.catalog(p))
    with pytest.raises(ValueError):
        store.create_series(points.catalog(p))
    store.append_points(p)
    store.append_points(pts(spark, [(flow, "TestTS", 99, 3)]))
    series = store.series(flow).first().time_series_id
    assert [r.value_int for r in store.points(series).collect()] == [10, 10, 11, 3]
    with pytest.raises(TypeError):
        store.append_points(pts(spark, [(flow, "TestTS", 100, 1.0)]))
    store.merge_points(pts(spark, [(flow, "TestTS", 99, 4), (flow, "TestTS", 100, 5)]))
    assert [r.value_int for r in store.points(series).collect()] == [10, 10, 11, 3, 5]
    assert store.require_series(["TestTS"]).count() == 1 and store.require_series(["TestTS", "no"]).count() == 0
    with pytest.raises(ValueError):
        store.delete_flows([flow])
    store.delete_series([series])
    assert store.data.count() == 0 and store.series_table.count() == 0
    store.delete_flows([flow], cascade=True)
    assert store.flows.count() == 0 and store.attributes.count() == 0
    assert FlowStore(spark, store.path).flows.count() == 0


def test_look_ups(spark, store):
    flow = store.flow_by_id(store.flow(*FLOW).first().id).first()
    assert flow.src == "10.0.0.1" and store.flow("x", "y", 1, 2).count() == 0
    assert store.series_in([1]).count() == 0 and store.series_by_id(1).count() == 0 and store.attribute_by_id(1).count() == 0
    assert isinstance(FlowStore.open(spark, "/x/flows.sqlite"), ForeignStore) and isinstance(FlowStore.open(spark, "/x/flows"), FlowStore)
    s = Selection([1]).add(2).add(2)
    assert s.ids == [1, 2] and s.contains(2) and not s.remove(2).contains(2)


def test_point_filter_reaches_scan(spark, store):
    p = pts(spark, [(1, "a", t, t) for t in range(10)])
    store.ensure_series(points.catalog(p))
    store.append_points(p)
    plan = store.points(5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(time_series_id,5)" in plan


def test_run_metrics_file(spark, tmp_path):
    events = spark.createDataFrame([("ingress", False), ("send", False), ("send", True)], "source string, dropped boolean")
    live.write_run_metrics(events, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("*.json"))
    assert json.loads(text) == {"handled": 2, "dropped": 1, "ingress": 1, "egress": 0, "ingress_calls": 0, "egress_calls": 1}


def test_write_speed(spark):
    samples = spark.createDataFrame([(1, 0.0, 100), (1, 2.0, 300), (1, 3.0, 300)], "series_id long, ts double, bytes long")
    assert [r.bytes_per_second for r in live.write_speed(samples).orderBy("ts").collect()] == [None, 100.0, 0.0]


def test_ingest_twice_changes_nothing(spark, tmp_path):
    rec = spark.createDataFrame([(5, 1, 7, False)], "time long, snd_cwnd long, n long, _corrupt boolean").withColumns({"family": F.lit(2), "addr_v4": F.lit(1 << 32 | 2).cast("long"), "ports": F.lit(65537).cast("long"), "src_v6": F.lit(bytes(16)), "dst_v6": F.lit(bytes(16))})
    store = FlowStore(spark, f"file://{tmp_path}/s")
    run = live.ingest_batch(store, "cwnd")
    run(rec, 0)
    run(rec, 0)
    assert store.data.count() == 1 and store.flows.count() == 1 and os.path.isdir(tmp_path / "s")


def packets_of(spark, day, n, start=0):
    """``n`` records of kind cwnd, a second apart."""
    rows = spark.range(start, start + n).selectExpr(f"{day} * 86400000000000 + id * 1000000000 AS time", "id + 1 AS snd_cwnd", "false AS _corrupt")
    return rows.withColumns({"family": F.lit(2), "addr_v4": F.lit(1 << 32 | 2).cast("long"), "ports": F.lit(65537).cast("long"), "src_v6": F.lit(bytes(16)), "dst_v6": F.lit(bytes(16))})


def test_ingest_reads_and_replaces_its_own_part_only(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/s")
    run = live.ingest_batch(store, "cwnd")
    run(packets_of(spark, 3, 10), 0)
    run(packets_of(spark, 4, 10), 1)
    flows = sorted((tmp_path / "s" / "flows" / "v0").iterdir())
    run(packets_of(spark, 4, 10, 5), 2)  # five are stored already
    run(packets_of(spark, 4, 10, 5), 2)
    assert store.data.count() == 25 and store.flows.count() == 1 and store.series_table.count() == 1
    assert {r.part: r["count"] for r in store.parts("time_series_data").groupBy("part").count().collect()} == {"cwnd-0": 10, "cwnd-1": 10, "cwnd-2": 5}
    run(packets_of(spark, 4, 20, 5), 2)  # the batch again, with more in it: its part is replaced
    assert store.data.count() == 35
    assert set(flows) <= set((tmp_path / "s" / "flows" / "v0").iterdir())  # additions leave earlier parts alone
    new = points.to_points(packets_of(spark, 4, 3).withColumns({"src": F.lit("a"), "dst": F.lit("b"), "sport": F.lit(1), "dport": F.lit(2), "l4proto": F.lit(6)}), "cwnd")
    merge = store.unstored(new)
    merge.collect()
    plan = merge._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(day#\d+L\), \(day#\d+L = 4\)\]", plan) and "GreaterThanOrEqual(ts," in plan
    assert store.points_between(3 * 86_400 * 10**9, 3 * 86_400 * 10**9 + 10**9).count() == 2
    store.compact()
    assert store.data.count() == 35 and {r.part for r in store.parts("time_series_data").select("part").distinct().collect()} == {"base"}


def test_points_without_nanoseconds_are_merged(spark, store):
    p = pts(spark, [(1, "a", t, t) for t in range(4)]).withColumn("ts_ns", F.lit(None).cast("long"))
    store.save_series(p)
    store.save_series(p)
    assert store.data.count() == 4


def test_a_key_is_stored_once_with_and_without_nanoseconds(spark, store):
    p = pts(spark, [(1, "a", 1000, 1)])
    for df in (p.withColumn("ts_ns", F.lit(None).cast("long")), p.withColumn("ts_ns", F.lit(1000).cast("long"))):
        store.save_series(df)
    assert store.data.count() == 1


def test_days_between_those_of_a_batch_are_not_read(spark, tmp_path):
    """One late record among new ones: two days are read."""
    store = FlowStore(spark, f"file://{tmp_path}/s")
    run = live.ingest_batch(store, "cwnd")
    run(packets_of(spark, 1, 200), 0)
    at = lambda day: points.to_points(packets_of(spark, day, 1).withColumns({"src": F.lit("a"), "dst": F.lit("b"), "sport": F.lit(1), "dport": F.lit(2), "l4proto": F.lit(6)}), "cwnd")
    plan = store.unstored(at(1).unionByName(at(8)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"day#\d+L IN \(1,8\)", plan)


def accounts_of(store):
    return {r.part: (r.records, r.corrupt, r.points, r.stored, r.known, r.quarantined) for r in store.accounts.collect()}


def test_every_row_of_a_batch_is_accounted_for(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/s")
    run = live.ingest_batch(store, "cwnd")
    rows = packets_of(spark, 3, 10)
    twice = rows.unionByName(rows.limit(3)).unionByName(rows.limit(2).withColumn("_corrupt", F.lit(True)))
    for _ in range(2):
        run(twice, 0)
        run(packets_of(spark, 3, 10, 6), 1)
        assert accounts_of(store) == {"cwnd-0": (15, 2, 13, 10, 0, 3), "cwnd-1": (10, 0, 10, 6, 4, 0)}
        assert store.data.count() == 16
        assert {r.reason: r["count"] for r in store.quarantine.groupBy("reason").count().collect()} == {"duplicate": 3, "corrupt": 2}
    assert all('"time":' in r.record for r in store.quarantine.filter("reason = 'corrupt'").collect())
    # A series of another type than the record's: its points are kept aside, the batch goes on.
    flow = store.flows.first().id
    store.delete_series([r.time_series_id for r in store.series_table.collect()])
    store.create_series(spark.createDataFrame([(flow, "perf_snd_cwnd", 1)], "flow_id long, name string, type int"))
    run(packets_of(spark, 5, 4), 2)
    assert accounts_of(store)["cwnd-2"] == (4, 0, 4, 0, 0, 4) and store.data.count() == 0
    assert store.quarantine.filter("reason = 'type'").count() == 4


def files_below(path):
    return sorted(str(p) for p in path.rglob("*") if p.is_file())


def test_empty_batches_leave_the_store_as_it_was(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/s")
    run = live.ingest_batch(store, "cwnd")
    run(packets_of(spark, 3, 4), 0)
    before = files_below(tmp_path / "s")
    for n in range(1, 10):
        run(packets_of(spark, 3, 0), n)
    known = points.catalog(pts(spark, []))
    store.ensure_series(known)
    store.add_flows(store.flows)
    store.merge_points(pts(spark, []))
    store.delete_series([])
    store.compact()
    assert files_below(tmp_path / "s") == before


def test_parts_are_folded_by_size(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/s", fold=3)
    for n in range(7):
        store.save_series(pts(spark, [(1, "a", n, n), (1, f"s{n}", n, n)]))
        assert len(store.listing("time_series_data").parts) < 3
    assert store.data.count() == 14 and store.series_table.count() == 8
    assert FlowStore(spark, store.path, fold=9).settings["fold"] == 3
    run = live.ingest_batch(store, "cwnd")
    for n in range(4):
        run(packets_of(spark, n, 2), n)
    run(packets_of(spark, 3, 2), 3)  # the newest batch isn't folded, as it may come again
    assert store.data.count() == 22 and "cwnd-3" in {p.name for p in store.listing("time_series_data").parts}
    assert accounts_of(store) == {f"cwnd-{n}": (2, 0, 2, 2, 0, 0) for n in range(4)}
    store.vacuum()
    assert {int(p.name[4:]) for p in (tmp_path / "s" / "time_series_data" / "v0").iterdir()} == {p.seq for p in store.listing("time_series_data").parts}
    assert store.data.count() == 22 and store.summaries().agg(F.sum("n_points")).first()[0] == 22


def test_look_ups_read_their_own_bucket(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/s", bucket_bits=4)
    store.add_flows(spark.range(200).selectExpr("'a' AS src", "'b' AS dst", "int(id) AS sport", "1 AS dport", "6 AS l4proto"))
    one = store.flow("a", "b", 7, 1)
    assert one.first().sport == 7 and "PartitionFilters: [isnotnull(bucket#" in one._jdf.queryExecution().executedPlan().toString()
    new = spark.createDataFrame([("a", "b", 7, 1, 6), ("a", "b", 500, 1, 6)], "src string, dst string, sport int, dport int, l4proto int").withColumn("id", F.lit(1 << 56))
    plan = store._missing("flows", new)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+L\), \(bucket#\d+L = 1\)\]", plan) and "ReadSchema: struct<id:bigint>" in plan
    assert len(list((tmp_path / "s" / "flows" / "v0" / "seq=1").glob("bucket=*"))) == 16


def test_deletes_write_keys_and_hide_earlier_rows_only(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/s")
    rows = pts(spark, [(f, n, t, t) for f in (1, 2) for n in ("a", "b") for t in range(50)])
    store.save_series(rows)
    gone = rows.filter("flow_id = 1 AND name = 'a'").first().series_id
    before = set(files_below(tmp_path / "s"))
    store.delete_series([gone])
    new = {p for p in set(files_below(tmp_path / "s")) - before if p.endswith(".parquet")}
    assert new and all("/deletes/seq=" in p for p in new)
    assert store.data.count() == 150 and store.points(gone).count() == 0 and store.summaries().count() == 3
    store.save_series(rows.filter("ts < 10"))  # what comes after the delete is there
    assert store.data.count() == 160 and store.points(gone).count() == 10
    assert store.summaries().filter(F.col("series_id") == gone).first().n_points == 10
    store.compact()
    assert store.data.count() == 160 and not store.listing("time_series_data").deletes
    store.delete_series([r.time_series_id for r in store.series_table.collect()])
    store.compact()
    assert store.data.count() == 0 and store.summaries().count() == 0 and not store.listing("time_series_data").parts


def test_bounds_of_a_store_read_no_points(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/s")
    store.save_series(pts(spark, [(1, "a", t, t) for t in range(9)]))
    store.save_series(pts(spark, [(1, "a", t, t) for t in range(5, 20)] + [(2, "b", 3, 2.5)]))
    store.delete_series([store.series(2).first().time_series_id])
    store.save_series(pts(spark, [(2, "b", 8, -1.5), (2, "b", 9, 7.0)]))
    found = bounds.stored_series_bounds(store.summaries())
    known = store.data.withColumnRenamed("time_series_id", "series_id").join(store.series_table.select("flow_id", "name", F.col("time_series_id").alias("series_id")), "series_id")
    assert sorted(found.collect()) == sorted(bounds.series_bounds(known).collect()) and found.count() == 2
    files = found.inputFiles()
    assert any("/summaries/" in f for f in files) and not any("time_series_data/v0" in f for f in files)
    assert sorted(bounds.stored_flow_bounds(store.summaries()).collect()) == sorted(bounds.flow_bounds(known).collect())


def test_files_read_for_a_series_stay_few_as_parts_grow(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/s", fold=100)
    for n in range(6):
        store.save_series(pts(spark, [(n, "a", t, t) for t in range(3)]))
    one = store.points(store.series(5).first().time_series_id)
    assert one.count() == 3 and len(one.inputFiles()) == 1 and len(store.data.inputFiles()) == 6


def test_tables_of_sql_stores(spark):
    """One column for each type, with stand-ins in the others, or one column of text."""
    flat = "time_series_id long, timestamp double, value_boolean int, value_text string, value_integer long, value_float double, type int"
    rows = [(1, 0.0, -1, None, 5, -1.0, 0), (2, 0.0, -1, None, -1, 2.5, 1), (3, 0.0, 1, None, -1, -1.0, 2), (4, 0.0, -1, "x", -1, -1.0, 3)]
    text = spark.createDataFrame([(1, 0.0, "5", 0), (2, 0.0, "2.5", 1), (3, 0.0, "true", 2), (4, 0.0, "x", 3)], "time_series_id long, timestamp double, value string, type int")
    series = spark.createDataFrame([(i, 9, f"n{i}", i - 1) for i in range(1, 5)], "time_series_id long, flow_id long, name string, type int")
    flows = spark.createDataFrame([(9, *FLOW)], "id long, src string, dst string, sport int, dport int, l4proto int")
    for data in (spark.createDataFrame(rows, flat), text):
        store = ForeignStore(spark, "/x/flows.sqlite")
        store.raw_table = {"time_series_data": data, "time_series": series, "flows": flows}.__getitem__
        assert [tuple(r)[4:] for r in store.data.orderBy("time_series_id").collect()] == [(5, None, None, None), (None, 2.5, None, None), (None, None, True, None), (None, None, None, "x")]
        assert store.points(2).first().value_float == 2.5 and store.flow(*FLOW).first().id == 9
        assert store.require_series(["n1", "n2"]).count() == 2 and store.joined().count() == 4


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from flowseries.sources.shared import shared_path

    unset = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://h:7077", getConf=lambda: unset))
    with pytest.raises(ValueError):
        shared_path(far, "x")


def test_sql_stores_are_read_in_ranges(spark):
    """Through the database that comes with Spark; a hot series is spread, as ranges go by time."""
    url = f"jdbc:derby:memory:t{os.getpid()};create=true"
    rows = [(1, float(t), t, -1.0, None, None, 0) for t in range(900)] + [(2, 3.5, -1, 2.5, None, None, 1), (2, None, -1, 0.5, None, None, 1)]
    data = spark.createDataFrame(rows, "time_series_id long, timestamp double, value_integer long, value_float double, value_boolean int, value_text string, type int")
    data.write.jdbc(url, "time_series_data")
    spark.createDataFrame([(i, 9, f"n{i}", i - 1) for i in range(1, 3)], "time_series_id long, flow_id long, name string, type int").write.jdbc(url, "time_series")
    store = FlowStore.open(spark, url, rows_per_split=100)
    assert isinstance(store, ForeignStore)
    points = store.data
    sizes = points.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 10 and sum(sizes) == 902 and max(sizes) <= 103
    plan = store.points(2)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(time_series_id,2)" in plan and "numPartitions=10" in plan
    assert sorted((r.ts is None, r.value_float) for r in store.points(2).collect()) == [(False, 2.5), (True, 0.5)]
    assert store.series_table.rdd.getNumPartitions() == 1 and store.series(9).count() == 2


def test_flows_come_and_go(spark, tmp_path):
    """Batches after each other, as after a restart: spans go on, late records are dropped, silent flows expire."""
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "src string, dst string, sport int, dport int, l4proto int, us long"

    def add(name, rows):
        spark.createDataFrame([(src, "d", 1, 2, 6, int(t * 1e6)) for src, t in rows], schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")

    add("0", [("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 9), (None, 3)])

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{path}/*.parquet").withColumn("event_time", F.timestamp_micros("us"))
        with live.state_store(spark):
            live.flow_table(stream, 5.0, "2 seconds").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema("src string, event string, first_seen timestamp, last_seen timestamp, n long").parquet(f"{out}/rows")
        found = rows.select(F.coalesce("src", F.lit("")), "event", F.unix_micros("first_seen"), F.unix_micros("last_seen"), "n").collect()
        assert sorted(map(tuple, found)) == sorted((src or "", event, int(first * 1e6), int(last * 1e6), n) for src, event, first, last, n in want)

    # b was silent from 1 to 9; the watermark stands at 7.
    want = [("a", "open", 1, 1, 0), ("b", "open", 1, 1, 0), ("b", "idle", 1, 1, 1), ("b", "open", 9, 9, 0), (None, "open", 3, 3, 0)]
    run()
    # a goes on before its time is over; what comes at 2 is late and dropped; 20 lets all others expire.
    add("1", [("a", 8), ("c", 2), ("c", 20)])
    want += [("c", "open", 20, 20, 0), ("a", "idle", 1, 8, 4), ("b", "idle", 9, 9, 1), (None, "idle", 3, 3, 1)]
    run()
    add("2", [("a", 30)])
    want += [("a", "open", 30, 30, 0), ("c", "idle", 20, 20, 1)]
    run()


def test_stream_offsets_do_not_grow_with_appends(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    some = lambda a, b: spark.range(a, b, 1, 2).selectExpr("id AS time")
    reader = trace.TraceStreamReader({"kind": "bad_csum", "path": path}, trace.KINDS["bad_csum"].struct)
    assert reader.latestOffset() == {"": 0}
    read = lambda a, b: sum((p.end - p.start) // BAD_CSUM.size for p in reader.partitions(a, b))
    offsets = [reader.initialOffset()]
    for n in range(4):
        trace.write_trace(some(n * 10, n * 10 + 10), path, "bad_csum")
        offsets.append(reader.latestOffset())
    assert offsets == [{"": n} for n in range(5)]
    assert [read(a, b) for a, b in zip(offsets, offsets[1:])] == [10] * 4 and read(offsets[1], offsets[3]) == 20
    # A file that a recorder writes to stands beside the appends and goes by its bytes.
    bad_csum_file(tmp_path / "t" / "bad_csum.tcp", 3)
    now = reader.latestOffset()
    bad_csum_file(tmp_path / "t" / "bad_csum.tcp", 8, tail=b"abc")
    later = reader.latestOffset()
    assert len(later) == 2 and (read(offsets[-1], now), read(now, later)) == (3, 5)
    again = trace.TraceStreamReader({"kind": "bad_csum", "path": path}, trace.KINDS["bad_csum"].struct)
    assert again.latestOffset() == later and trace.read_trace(spark, path, "bad_csum").count() == 48
    assert not [f for f in files_below(tmp_path / "t") if "/." in f and ".crc" not in f]


def test_reading_a_store_writes_nothing(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/none", bucket_bits=5)
    assert store.flow(*FLOW).count() == 0 and store.points(1).count() == 0 and store.summaries().count() == 0 and store.quarantine.count() == 0
    assert not (tmp_path / "none").exists() and store.settings["bucket_bits"] == 5
    store.add_flows(spark.createDataFrame([FLOW], "src string, dst string, sport int, dport int, l4proto int"))
    assert FlowStore(spark, store.path).settings["bucket_bits"] == 5


def test_derived_points_meet_parts_of_their_series_only(spark, tmp_path):
    store = FlowStore(spark, f"file://{tmp_path}/s")
    p = lambda name, n: points.to_points(packets_of(spark, 4, n).withColumns({"src": F.lit("a"), "dst": F.lit("b"), "sport": F.lit(1), "dport": F.lit(name), "l4proto": F.lit(6)}), "cwnd")
    store.save_series(p(2, 5))
    assert store._stored_keys(p(3, 5), None, by_series=True) is None and store._stored_keys(p(2, 5), None, by_series=True).count() == 5
    store.save_series(p(3, 4))
    store.save_series(p(3, 6))
    own = store.series_table.join(p(3, 1).select("flow_id").distinct(), "flow_id")
    assert store.data.count() == 11 and store.points_of(own).count() == 6
