"""Queries that write a store under the shared folder, change it and read it back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseries.functions.addresses import hashed_id
from flowseries.operators import bounds, metrics, points
from flowseries.plans.binary_queries import records_of
from flowseries.plans.testmaps import A_SQL, E_SQL, K_SQL, L_SQL, P_SQL, attributes, event_flows, event_points, probe_points, probe_series, user_flow, user_series
from flowseries.sources import trace
from flowseries.sources.shared import shared_path
from flowseries.sources.store import FlowStore, ForeignStore, held, scratch_store
from flowseries.streaming import live

REGISTERED: dict[str, tuple[Callable, str | None]] = {}


def key(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        REGISTERED[name] = (f, sql)
        return f

    return add


def _event_store(spark: SparkSession, sf_dir: str) -> FlowStore:
    store, p = scratch_store(spark), event_points(spark, sf_dir)
    store.add_flows(event_flows(spark, sf_dir))
    store.create_series(points.catalog(p))
    store.append_points(p)
    return store


@key("store_roundtrip", f"WITH {P_SQL} SELECT flow_id, src, sport, series_id AS time_series_id, name, ts, v AS value FROM p")
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_store(spark, sf_dir).joined().select("flow_id", "src", "sport", "time_series_id", "name", "ts", F.col("value_float").alias("value"))


@key("series_create", f"WITH {L_SQL} SELECT DISTINCT series_id AS time_series_id, flow_id, name, type FROM l")
def series_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, series = scratch_store(spark), points.catalog(probe_points(spark, sf_dir))
    store.create_series(series.filter("name IN ('SND_UNA', 'TAX')"))
    store.create_series(series.filter("name NOT IN ('SND_UNA', 'TAX')"))
    return store.series_table


def _probe_store(spark: SparkSession, sf_dir: str) -> tuple[FlowStore, DataFrame]:
    # Each step reads all points again, and working out the ids of their series would take most of a reading.
    store, ids = scratch_store(spark), probe_series(spark, sf_dir)
    p = points.split_duplicates(probe_points(spark, sf_dir, ids), ["value_int", "value_float"])[0]
    store.create_series(points.catalog(p))
    store.append_points(p)
    return store, p


@key("series_delete", f"WITH {L_SQL} SELECT series_id AS time_series_id, name, count(*) AS n FROM o WHERE NOT (flow_id = 7 AND name IN ('TAX', 'SND_UNA')) GROUP BY ALL")
def series_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowseries.functions.addresses import hashed_id_of

    store, _ = _probe_store(spark, sf_dir)
    store.delete_series([hashed_id_of(7, "TAX"), hashed_id_of(7, "SND_UNA")])
    counts = store.data.groupBy("time_series_id").agg(F.count("ts").alias("n"))
    return counts.join(store.series_table.select("time_series_id", "name"), "time_series_id", "full").select("time_series_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


@key("metric_save", f"WITH {L_SQL}, z AS (SELECT flow_id, ts, sum(value_int)::BIGINT AS value FROM o WHERE name IN ('SND_UNA', 'SND_WND') GROUP BY flow_id, ts HAVING count(*) = 2) SELECT flow_id, 'UPPER_WND' AS name, ts, value FROM z")
def metric_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, p = _probe_store(spark, sf_dir)
    upper = metrics.get("UPPER_WND")
    with held(upper.run(p)):  # both find the points there
        upper.save(store, p)
        upper.save(store, p)  # saving again adds nothing
    series = store.series_table.filter("name = 'UPPER_WND'").drop("type")
    return store.points_of(series).select("flow_id", "name", "ts", F.col("value_int").alias("value"))


@key("insert_type_mismatch", f"WITH {A_SQL} SELECT flow_id, name, type, CASE name WHEN 'balance' THEN 0 ELSE type END AS series_type FROM a WHERE name = 'balance'")
def insert_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that an insert rejects: a series of Int gets Floats. The guarded insert fails and stores none of them;
    taking them with what else there is stores the rest and puts them aside."""
    store, a = scratch_store(spark), attributes(spark, sf_dir).withColumns({"ts": F.lit(0.0), "ts_ns": F.lit(0).cast("long"), "series_id": hashed_id(F.col("flow_id"), F.col("name"))})
    store.create_series(a.select("flow_id", "name", F.when(F.col("name") == "balance", 0).otherwise(F.col("type")).alias("type")))
    try:
        store.append_points(a, "batch")
    except TypeError:
        store.take_points(a, ["type"], "batch")
    series = store.series_table.select("time_series_id", F.col("type").alias("series_type"))
    return store.quarantine.join(series, "time_series_id").select("flow_id", "name", "type", "series_type")


@key("flow_upsert", "SELECT DISTINCT '10.1.0.' || (c_custkey % 200) AS src, '10.2.0.1' AS dst, 1000 AS sport, 443 AS dport, 6 AS l4proto FROM customer")
def flow_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of flows that overlap."""
    store = scratch_store(spark)
    n = F.col("flow_id") % 200
    tuples = attributes(spark, sf_dir).select(F.concat(F.lit("10.1.0."), n.cast("string")).alias("src"), F.lit("10.2.0.1").alias("dst"), F.lit(1000).alias("sport"), F.lit(443).alias("dport"), F.lit(6).alias("l4proto"), n.alias("n"))
    store.add_flows(tuples.filter("n < 120"))
    store.add_flows(tuples.filter("n >= 80"))
    return store.flows.drop("id")


@key("flow_delete", f"WITH {P_SQL} SELECT flow_id AS id, count(*) AS n FROM p WHERE flow_id <> {user_flow(7)} GROUP BY flow_id")
def flow_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _event_store(spark, sf_dir)
    store.delete_flows([user_flow(7)], cascade=True)
    return store.flows.join(store.joined(), F.col("id") == F.col("flow_id"), "left").groupBy("id").agg(F.count("ts").alias("n"))


def _attribute_store(spark: SparkSession, sf_dir: str) -> FlowStore:
    store = scratch_store(spark)
    store.set_attributes(attributes(spark, sf_dir))
    return store


_ATTRIBUTE = ("flow_id", "name", "type", "value_int", "value_float", "value_text")


@key("attr_upsert", f"WITH {A_SQL} SELECT flow_id, name, CASE name WHEN 'balance' THEN 0 ELSE type END AS type, CASE name WHEN 'balance' THEN 100 ELSE value_int END AS value_int, CASE name WHEN 'balance' THEN NULL ELSE value_float END AS value_float, value_text FROM a")
def attr_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setting an attribute again replaces its value, also by one of another type."""
    store = _attribute_store(spark, sf_dir)
    a = attributes(spark, sf_dir).filter("name = 'balance'")
    store.set_attributes(a.withColumns({"type": F.lit(0), "value_int": F.lit(100).cast("long"), "value_float": F.lit(None).cast("double")}))
    return store.attributes.select(*_ATTRIBUTE)


@key("attr_delete", f"WITH {A_SQL} SELECT flow_id, name, type, value_int, value_float, value_text FROM a WHERE NOT (flow_id = 3 AND name = 'nation')")
def attr_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _attribute_store(spark, sf_dir)
    store.delete_attribute(3, "nation")
    return store.attributes.select(*_ATTRIBUTE)


@key("attr_list", f"WITH {A_SQL} SELECT flow_id, name, type, value_int, value_float, value_text FROM a WHERE flow_id = 3 ORDER BY name")
def attr_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attribute_store(spark, sf_dir).list_attributes(3).select(*_ATTRIBUTE)


@key("attr_by_name", f"WITH {A_SQL} SELECT flow_id, name, type, value_int, value_float, value_text FROM a WHERE flow_id = 3 AND name = 'segment'")
def attr_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attribute_store(spark, sf_dir).attribute(3, "segment").select(*_ATTRIBUTE)


@key("attr_by_id", f"WITH {A_SQL} SELECT flow_id, name, type, value_int, value_float, value_text FROM a WHERE flow_id = 3 AND name = 'balance'")
def attr_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowseries.functions.addresses import hashed_id_of

    return _attribute_store(spark, sf_dir).attribute_by_id(hashed_id_of(3, "attribute", "balance")).select(*_ATTRIBUTE)


@key("stream_ingest", f"WITH {K_SQL} SELECT name, type, count(*) AS n, count(DISTINCT flow_id) AS flows, sum(value_int)::BIGINT AS total FROM q GROUP BY ALL")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet trace ingested as a stream, then summed up from the store."""
    path = shared_path(spark, f"ingest-{uuid.uuid4().hex}")
    trace.write_trace(records_of(spark, sf_dir, "packet"), f"{path}/trace", "packet")
    store = FlowStore(spark, f"{path}/store")
    live.ingest_stream(trace.stream_trace(spark, f"{path}/trace", "packet"), store, "packet", f"{path}/state").awaitTermination()
    joined = store.data.join(store.series_table.drop("type"), "time_series_id")
    return joined.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("flow_id").alias("flows"), F.sum("value_int").alias("total"))


_FLOW_7 = f"flow_id = {user_flow(7)}"


@key("flow_by_tuple", f"WITH {E_SQL} SELECT DISTINCT flow_id AS id, src, dst, sport, dport, l4proto FROM e WHERE src = '10.0.0.7' AND dst = '192.168.0.1' AND sport = 40007 AND dport = 443 AND l4proto = 6")
def flow_by_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow_store(spark, sf_dir).flow("10.0.0.7", "192.168.0.1", 40007, 443, 6)


@key("flow_by_id", f"WITH {E_SQL} SELECT DISTINCT flow_id AS id, src, dst, sport, dport, l4proto FROM e WHERE {_FLOW_7}")
def flow_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow_store(spark, sf_dir).flow_by_id(user_flow(7))


@key("series_by_id", f"WITH {P_SQL} SELECT DISTINCT series_id, flow_id, name, type FROM p WHERE series_id = {user_series(7, 'click')}")
def series_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_store(spark)
    store.create_series(points.catalog(event_points(spark, sf_dir)))
    return store.series_by_id(user_series(7, "click")).withColumnRenamed("time_series_id", "series_id")


def _flow_store(spark: SparkSession, sf_dir: str) -> FlowStore:
    store = scratch_store(spark)
    store.add_flows(event_flows(spark, sf_dir))
    return store


def _batches(spark: SparkSession, sf_dir: str) -> FlowStore:
    """Packets in two batches that share a third; the first has some records twice, the second some corrupt ones, and
    comes twice itself."""
    store, rows = FlowStore(spark, shared_path(spark, f"batches-{uuid.uuid4().hex}")), records_of(spark, sf_dir, "packet")
    run = live.ingest_batch(store, "packet")
    first, second = rows.filter("seq % 3 <> 0").withColumn("_corrupt", F.lit(False)), rows.filter("seq % 3 <> 1").withColumn("_corrupt", F.col("seq") % 97 == 0)
    run(first.unionByName(first.filter("seq % 10 = 0")), 0)
    run(second, 1)
    run(second, 1)
    return store


_BATCH_SQL = f"""{K_SQL},
x AS (SELECT seq, flow_id, time, unnest([{{'name': 'SEQ_NUM', 'on': seq <> 0}}, {{'name': 'ACK_NUM', 'on': ack_num <> 0}}, {{'name': 'WINDOW', 'on': "window" <> 0}}, {{'name': 'FLAG_ACK', 'on': ack}},
        {{'name': 'FLAG_PSH', 'on': psh}}, {{'name': 'FLAG_RST', 'on': rst}}, {{'name': 'FLAG_SYN', 'on': syn}}, {{'name': 'FLAG_FIN', 'on': fin}}]) AS c FROM k),
y AS (SELECT seq, flow_id, time, c.name AS name FROM x WHERE coalesce(c."on", false)),
b0 AS (SELECT flow_id, time, name FROM y WHERE seq % 3 <> 0 UNION ALL SELECT flow_id, time, name FROM y WHERE seq % 3 <> 0 AND seq % 10 = 0),
b1 AS (SELECT flow_id, time, name FROM y WHERE seq % 3 <> 1 AND seq % 97 <> 0),
d1 AS (SELECT DISTINCT flow_id, time, name FROM b1), d0 AS (SELECT DISTINCT flow_id, time, name FROM b0)"""


@key("ingest_accounts", f"""WITH {_BATCH_SQL}
SELECT 'packet-0' AS part, (SELECT count(*) FROM k WHERE seq % 3 <> 0) + (SELECT count(*) FROM k WHERE seq % 3 <> 0 AND seq % 10 = 0) AS records, 0 AS corrupt, (SELECT count(*) FROM b0) AS points,
       (SELECT count(*) FROM d0) AS stored, 0 AS known, (SELECT count(*) FROM b0) - (SELECT count(*) FROM d0) AS quarantined
UNION ALL
SELECT 'packet-1', (SELECT count(*) FROM k WHERE seq % 3 <> 1), (SELECT count(*) FROM k WHERE seq % 3 <> 1 AND seq % 97 = 0), (SELECT count(*) FROM b1),
       (SELECT count(*) FROM d1 ANTI JOIN d0 USING (flow_id, time, name)), (SELECT count(*) FROM d1 SEMI JOIN d0 USING (flow_id, time, name)), (SELECT count(*) FROM b1) - (SELECT count(*) FROM d1)
""")
def ingest_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every record and point of the batches went."""
    return _batches(spark, sf_dir).accounts.drop("kind")


@key("ingest_quarantine", f"""WITH {_BATCH_SQL}
SELECT 'duplicate' AS reason, name, n - m AS n FROM (SELECT name, count(*) AS n FROM b0 GROUP BY name) JOIN (SELECT name, count(*) AS m FROM d0 GROUP BY name) USING (name) WHERE n > m
UNION ALL SELECT 'duplicate', name, n - m FROM (SELECT name, count(*) AS n FROM b1 GROUP BY name) JOIN (SELECT name, count(*) AS m FROM d1 GROUP BY name) USING (name) WHERE n > m
UNION ALL SELECT 'corrupt', NULL, count(*) FROM k WHERE seq % 3 <> 1 AND seq % 97 = 0 HAVING count(*) > 0""")
def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches couldn't store, by part, reason and series name."""
    return _batches(spark, sf_dir).quarantine.groupBy("part", "reason", "name").agg(F.count(F.lit(1)).alias("n")).drop("part")


def _changed_store(spark: SparkSession, sf_dir: str) -> FlowStore:
    """Points in three parts, with one series deleted before the last of them."""
    store, p = _flow_store(spark, sf_dir), event_points(spark, sf_dir)
    store.create_series(points.catalog(p))
    store.append_points(p.filter("pmod(ts_ns DIV 1000, 3) = 0"))
    store.append_points(p.filter("pmod(ts_ns DIV 1000, 3) = 1"))
    store.delete_points(store.series_in([user_series(7, "click")]))
    store.append_points(p.filter("pmod(ts_ns DIV 1000, 3) = 2"))
    return store


_LEFT = f"SELECT * FROM p WHERE NOT (series_id = {user_series(7, 'click')} AND (ts_ns // 1000) % 3 <> 2)"


@key("store_series_bounds", f"WITH {P_SQL}, o AS ({_LEFT}) SELECT flow_id, series_id, name, min(ts) AS xmin, max(ts) AS xmax, min(v) AS ymin, max(v) AS ymax FROM o GROUP BY ALL")
def store_series_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of a store's series from summaries: no point is read."""
    return bounds.stored_series_bounds(_changed_store(spark, sf_dir).summaries())


@key("store_series_listing", f"WITH {P_SQL}, o AS ({_LEFT}) SELECT flow_id, series_id, name, 'Float' AS type_name, coalesce(n, 0) AS n_points FROM (SELECT DISTINCT flow_id, series_id, name FROM p) LEFT JOIN (SELECT series_id, count(*) AS n FROM o GROUP BY ALL) USING (series_id)")
def store_series_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _changed_store(spark, sf_dir)
    return bounds.stored_listing(store.series_table, store.summaries())


@key("store_folded", f"WITH {P_SQL}, o AS (SELECT * FROM p WHERE series_id <> {user_series(7, 'click')}) SELECT series_id AS time_series_id, count(*) AS n, sum(value_float) AS total FROM o GROUP BY ALL")
def store_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that came in more parts than a store keeps, a series deleted among them, then folded whole."""
    store, p = FlowStore(spark, shared_path(spark, f"folded-{uuid.uuid4().hex}"), fold=3), event_points(spark, sf_dir)
    store.create_series(points.catalog(p))
    for n in range(5):
        store.append_points(p.filter(f"pmod(ts_ns DIV 1000, 5) = {n}"))
    store.delete_series([user_series(7, "click")])
    store.compact()
    return store.data.groupBy("time_series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value_float").alias("total"))


_OWN = ("value_integer", "value_float", "value_boolean", "value_text")


@key("sql_store_points", f"WITH {P_SQL} SELECT name, src, count(*) AS n, min(ts) AS first, max(ts) AS last, sum(round(v * 100)::BIGINT)::BIGINT AS cents FROM p WHERE sport < 40100 GROUP BY ALL")
def sql_store_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a SQL store read back through JDBC, points in ranges of their times. The store is the database that
    comes with Spark, in this process' memory, so it stands in for a server's in local mode only."""
    url, p = f"jdbc:derby:memory:s{uuid.uuid4().hex};create=true", event_points(spark, sf_dir)
    types = F.col("value_int"), F.col("value_float"), F.col("value_bool").cast("int"), F.col("value_text")
    data = p.select(F.col("series_id").alias("time_series_id"), F.col("ts").alias("timestamp"), "type", *[c.alias(n) for n, c in zip(_OWN, types, strict=True)])
    series = points.catalog(p).withColumnRenamed("series_id", "time_series_id")
    flows = event_flows(spark, sf_dir).select(F.col("flow_id").alias("id"), "src", "dst", "sport", "dport", "l4proto").distinct()
    for name, df in (("time_series_data", data), ("time_series", series), ("flows", flows)):
        df.write.jdbc(url, name)
    rows = ForeignStore(spark, url, rows_per_split=max(1, p.count() // 7)).joined().filter("sport < 40100")
    cents = F.round(F.col("value_float") * 100).cast("long")
    return rows.groupBy("name", "src").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum(cents).alias("cents"))
