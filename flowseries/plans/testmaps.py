"""The given tables as points, packets and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseries.functions.addresses import flow_id, hashed_id_of, series_id
from flowseries.functions.values import typed
from flowseries.operators.points import FEW, POINT_COLUMNS, scratch
from flowseries.schema import FLOAT, INT, L4PROTO_TCP, STRING

SERVER = "192.168.0.1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one of fewer parts than there are cores is dealt over them, so a small file isn't one task."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def micros(ts: Column) -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _tuple(user: Column) -> dict[str, Column]:
    u = user.cast("long")
    return {
        "src": F.concat(F.lit("10.0."), F.floor(u / 256).cast("string"), F.lit("."), (u % 256).cast("string")),
        "dst": F.lit(SERVER),
        "sport": (u + 40000).cast("int"),
        "dport": F.lit(443),
        "l4proto": F.lit(L4PROTO_TCP),
    }


def user_flow(user: int) -> int:
    return hashed_id_of(f"10.0.{user // 256}.{user % 256}", SERVER, 40000 + user, 443, L4PROTO_TCP)


def user_series(user: int, name: str) -> int:
    return hashed_id_of(user_flow(user), name)


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their flow tuples and times."""
    events = table(spark, sf_dir, "events").withColumns({**_tuple(F.col("user_id")), "us": micros(F.col("ts"))})
    return events.withColumn("flow_id", flow_id())


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Float series for each flow and kind of event."""
    e = event_flows(spark, sf_dir)
    named = e.select("flow_id", series_id(F.col("flow_id"), F.col("event_type")).alias("series_id"), F.col("event_type").alias("name"), F.col("us").cast("double").alias("ts"), (F.col("us") * 1000).alias("ts_ns"), *typed(FLOAT, F.col("value")))
    return named.select(*POINT_COLUMNS)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packet records, with their tuples."""
    u = F.col("user_id").cast("long")
    flag = {"urg": F.lit(False)} | {f: F.col("event_type") == e for f, e in (("ack", "click"), ("psh", "view"), ("rst", "error"), ("syn", "signup"), ("fin", "purchase"))}
    fields = {
        "time": F.col("us") * 1000,
        "saddr": F.lit(10 << 24) + F.floor(u / 256) * 256 + u % 256,
        "daddr": F.lit(192 << 24 | 168 << 16 | 1).cast("long"),
        "saddr_v6": F.lit(bytes(16)),
        "daddr_v6": F.lit(bytes(16)),
        "seq": F.col("event_id"),
        "ack_num": F.floor(F.col("value") * 100),
        "window": F.get_json_object("props", "$.k").cast("long"),
        **flag,
        "checksum": F.lit(0).cast("long"),
    }
    return event_flows(spark, sf_dir).withColumns(fields)


_PROBE_SERIES = {"SND_UNA": (INT, "l_partkey"), "SND_WND": (INT, "l_quantity"), "DISCOUNT": (FLOAT, "l_discount"), "TAX": (FLOAT, "l_tax")}


def probe_series(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """Each flow of the probe (``_flow``) with the ids of its series, to be broadcast to many readings of its points;
    none where flows are many."""
    flow = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("_flow")).distinct()
    ids = scratch(flow.select("_flow", *[series_id(F.col("_flow"), F.lit(n)).alias(f"_{n}") for n in _PROBE_SERIES]), "series")
    return F.broadcast(ids) if ids.count() <= FEW else None


def probe_points(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Order lines as points of a probe: two Int and two Float series for each supplier, with duplicate keys. ``ids`` are
    its ``probe_series``, where they are at hand."""
    flow, rows = F.col("l_suppkey"), table(spark, sf_dir, "lineitem")
    if ids is not None:
        rows = rows.join(ids, flow == F.col("_flow"), "left")
    # A null flow's ids aren't found.
    id_of = lambda n: [] if ids is None else [F.coalesce(F.col(f"_{n}"), series_id(flow, F.lit(n))).alias("series_id")]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), *typed(tag, F.col(c)), *id_of(n)) for n, (tag, c) in _PROBE_SERIES.items()])
    when = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = rows.select(flow.alias("flow_id"), when.alias("ts_ns"), F.explode(cells).alias("p")).select("flow_id", "ts_ns", "p.*").withColumn("ts", F.col("ts_ns").cast("double"))
    return (rows if ids is not None else rows.withColumn("series_id", series_id(F.col("flow_id"), F.col("name")))).select(*POINT_COLUMNS)


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three typed attributes for each customer."""
    cell = lambda name, tag, c: F.struct(F.lit(name).alias("name"), *typed(tag, F.col(c)))
    cells = F.array(cell("segment", STRING, "c_mktsegment"), cell("balance", FLOAT, "c_acctbal"), cell("nation", INT, "c_nationkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("flow_id"), F.explode(cells).alias("a")).select("flow_id", "a.*")


# The same in DuckDB's SQL, as common table expressions: e (events), p (points), k (packets), l (probe), a (attributes).
E_SQL = """
m AS (SELECT *, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src, '192.168.0.1' AS dst, (40000 + user_id)::INTEGER AS sport,
             443 AS dport, 6 AS l4proto, epoch_us(ts) AS us FROM events),
e AS (SELECT *, ('0x' || substr(md5(concat_ws('|', src, dst, sport, dport, l4proto)), 1, 15))::BIGINT AS flow_id FROM m)"""
P_SQL = E_SQL + """,
p AS (SELECT flow_id, ('0x' || substr(md5(concat_ws('|', flow_id, event_type)), 1, 15))::BIGINT AS series_id, event_type AS name, 1 AS type,
             us::DOUBLE AS ts, us * 1000 AS ts_ns, NULL::BIGINT AS value_int, value AS value_float, NULL::BOOLEAN AS value_bool, NULL::VARCHAR AS value_text, value AS v,
             user_id, src, dst, sport, dport, l4proto FROM e)"""
K_SQL = E_SQL + """,
k AS (SELECT flow_id, src, dst, sport, dport, l4proto, us * 1000 AS time, event_id AS seq, floor(value * 100)::BIGINT AS ack_num, (props->>'$.k')::BIGINT AS "window",
             false AS urg, event_type = 'click' AS ack, event_type = 'view' AS psh, event_type = 'error' AS rst, event_type = 'signup' AS syn, event_type = 'purchase' AS fin,
             0 AS checksum, event_type, user_id FROM e),
w AS (SELECT flow_id, time, unnest([
        {'name': 'SEQ_NUM', 'type': 0, 'i': seq, 'b': NULL::BOOLEAN}, {'name': 'ACK_NUM', 'type': 0, 'i': ack_num, 'b': NULL}, {'name': 'WINDOW', 'type': 0, 'i': "window", 'b': NULL},
        {'name': 'FLAG_URG', 'type': 2, 'i': NULL, 'b': urg}, {'name': 'FLAG_ACK', 'type': 2, 'i': NULL, 'b': ack}, {'name': 'FLAG_PSH', 'type': 2, 'i': NULL, 'b': psh},
        {'name': 'FLAG_RST', 'type': 2, 'i': NULL, 'b': rst}, {'name': 'FLAG_SYN', 'type': 2, 'i': NULL, 'b': syn}, {'name': 'FLAG_FIN', 'type': 2, 'i': NULL, 'b': fin},
        {'name': 'CHECKSUM', 'type': 0, 'i': checksum, 'b': NULL}]) AS c FROM k),
q AS (SELECT flow_id, ('0x' || substr(md5(concat_ws('|', flow_id, c.name)), 1, 15))::BIGINT AS series_id, c.name AS name, c.type AS type, time::DOUBLE AS ts, time AS ts_ns,
             c.i AS value_int, c.b AS value_bool FROM w WHERE coalesce(c.i <> 0, false) OR coalesce(c.b, false))"""
L_SQL = """
u AS (SELECT l_suppkey AS flow_id, l_orderkey * 8 + l_linenumber AS ts_ns, unnest([
        {'name': 'SND_UNA', 'type': 0, 'i': l_partkey, 'f': NULL::DOUBLE}, {'name': 'SND_WND', 'type': 0, 'i': l_quantity::BIGINT, 'f': NULL},
        {'name': 'DISCOUNT', 'type': 1, 'i': NULL, 'f': l_discount}, {'name': 'TAX', 'type': 1, 'i': NULL, 'f': l_tax}]) AS c FROM lineitem),
l AS (SELECT flow_id, ('0x' || substr(md5(concat_ws('|', flow_id, c.name)), 1, 15))::BIGINT AS series_id, c.name AS name, c.type AS type, ts_ns::DOUBLE AS ts, ts_ns,
             c.i AS value_int, c.f AS value_float FROM u),
d AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY value_int NULLS FIRST, value_float NULLS FIRST) AS n FROM l),
o AS (SELECT * FROM d WHERE n = 1)"""
A_SQL = """
c AS (SELECT c_custkey AS flow_id, unnest([
        {'name': 'segment', 'type': 3, 'i': NULL::BIGINT, 'f': NULL::DOUBLE, 't': c_mktsegment}, {'name': 'balance', 'type': 1, 'i': NULL, 'f': c_acctbal, 't': NULL},
        {'name': 'nation', 'type': 0, 'i': c_nationkey, 'f': NULL, 't': NULL}]) AS c FROM customer),
a AS (SELECT flow_id, c.name AS name, c.type AS type, c.i AS value_int, c.f AS value_float, NULL::BOOLEAN AS value_bool, c.t AS value_text FROM c)"""
