"""Queries over bytes: addresses, frames and trace files. Traces are written to the shared folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseries.functions import addresses
from flowseries.operators.frames import decode_frames
from flowseries.plans.testmaps import K_SQL, packets
from flowseries.schema import KINDS
from flowseries.sources import trace
from flowseries.sources.shared import shared_path
from flowseries.streaming import live

REGISTERED: dict[str, tuple[Callable, str | None]] = {}


def key(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        REGISTERED[name] = (f, sql)
        return f

    return add


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


@key("ipv4_from_int", f"WITH {K_SQL} SELECT time, src, dst FROM k")
def ipv4_from_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select("time", addresses.ipv4(F.col("saddr")).alias("src"), addresses.ipv4(F.col("daddr")).alias("dst"))


def _reversed_hex(value: Column) -> Column:
    h = _hex(value, 8)
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


@key("ipv4_pair_unpack", f"WITH {K_SQL} SELECT time, src, dst FROM k")
def ipv4_pair_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = packets(spark, sf_dir)
    number = lambda c: F.conv(_reversed_hex(F.col(c)), 16, 10).cast("long")
    src, dst = addresses.ipv4_pair(F.shiftleft(number("saddr"), 32).bitwiseOR(number("daddr")))
    return k.select("time", src.alias("src"), dst.alias("dst"))


@key("ports_unpack", f"WITH {K_SQL}, x AS (SELECT time, sport, dport, sport % 256 * 256 + sport // 256 AS s2, dport % 256 * 256 + dport // 256 AS d2 FROM k) SELECT time, sport AS host_s, dport AS host_d, sport AS sock_s, d2 AS sock_d, s2 AS cwnd_s, d2 AS cwnd_d FROM x")
def ports_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.col("sport").cast("long") * 65536 + F.col("dport")
    pairs = [(o, *addresses.ports(packed, o)) for o in ("host", "sock", "cwnd")]
    return packets(spark, sf_dir).select("time", *[c for o, s, d in pairs for c in (s.alias(f"{o}_s"), d.alias(f"{o}_d"))])


@key("sockaddr_unpack", f"WITH {K_SQL} SELECT time, src, printf('%032X', seq::BIGINT) AS v6 FROM k")
def sockaddr_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    v4 = F.unhex(F.concat(F.lit("02000000"), _hex(F.col("saddr"), 8), F.lit("00" * 20)))
    v6 = F.unhex(F.concat(F.lit("0A00000000000000"), _hex(F.col("seq"), 32), F.lit("00" * 4)))
    src = addresses.ipv4_bytes(addresses.sockaddr_bytes(v4, F.lit(2)))
    return packets(spark, sf_dir).select("time", src.alias("src"), F.hex(addresses.sockaddr_bytes(v6, F.lit(10))).alias("v6"))


# Groups 3 and 4 are the user, 5 to 8 the event; numbers here need groups 4, 7 and 8 at most, and the longest run of zeros goes.
@key("ipv6_text", f"WITH {K_SQL}, g AS (SELECT time, user_id, printf('%x', user_id) AS u, seq // 65536 AS a, seq % 65536 AS b FROM k) SELECT time, '2001:db8:' || CASE WHEN user_id > 0 THEN '0:' || u || '::' ELSE ':' END || CASE WHEN a > 0 THEN printf('%x:%x', a, b) WHEN b > 0 THEN printf('%x', b) ELSE '' END AS address FROM g")
def ipv6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unhex(F.concat(F.lit("20010DB8"), _hex(F.col("user_id"), 8), _hex(F.col("event_id"), 16)))
    return packets(spark, sf_dir).select("time", addresses.ipv6(raw).alias("address"))


@key("flow_tuple", f"WITH {K_SQL} SELECT time, src, dst, sport, dport, l4proto FROM k")
def flow_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = packets(spark, sf_dir).drop("src", "dst", "l4proto")
    return addresses.with_flow(records, "packet").select("time", *addresses.TUPLE)


@key("frames_decode", f"WITH {K_SQL} SELECT time, src, dst, sport, dport, seq, ack_num % 4294967296 AS ack_num, \"window\", urg, ack, psh, rst, syn, fin, 0 AS checksum FROM k WHERE event_type <> 'error'")
def frames_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are assembled from the packets; those of errors are cut short or carry another protocol."""
    k = packets(spark, sf_dir)
    bits = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(("fin", "syn", "rst", "psh", "ack", "urg"))), F.lit(0))
    tcp = F.concat(_hex(F.col("sport"), 4), _hex(F.col("dport"), 4), _hex(F.col("seq"), 8), _hex(F.col("ack_num"), 8), F.lit("50"), _hex(bits, 2), _hex(F.col("window"), 4), F.lit("00000000"))
    proto = F.when((F.col("event_type") == "error") & (F.col("seq") % 2 == 0), "11").otherwise("06")
    ip = F.concat(F.lit("450000280000000040"), proto, F.lit("0000"), _hex(F.col("saddr"), 8), _hex(F.col("daddr"), 8))
    whole = F.concat(F.lit("00" * 12 + "0800"), ip, tcp)
    frame = F.unhex(F.when((F.col("event_type") == "error") & (F.col("seq") % 2 == 1), F.left(whole, F.lit(100))).otherwise(whole))
    rows = decode_frames(k.select("time", frame.alias("frame")))
    return rows.select("time", addresses.ipv4(F.col("saddr")).alias("src"), addresses.ipv4(F.col("daddr")).alias("dst"), "sport", "dport", "seq", "ack_num", "window", "urg", "ack", "psh", "rst", "syn", "fin", "checksum")


# Trace files


def records_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Packets as records of any kind: fields that packets lack are taken from their numbers."""
    k = packets(spark, sf_dir)
    four = lambda c: F.unhex(_hex(F.col(c), 8))
    special = {
        "family": F.lit(2).cast("long"),
        "ports": F.col("sport").cast("long") * 65536 + F.col("dport"),
        "addr_v4": F.shiftleft(F.col("saddr").bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(F.col("daddr")),
    }
    widths = dict(KINDS[kind].fields)
    fields = []
    for i, field in enumerate(KINDS[kind].struct):
        name, code = field.name, widths[field.name]
        if code == "V28":
            c = F.unhex(F.concat(F.lit("02000000"), _hex(F.col(name), 8), F.lit("00" * 20)))
        elif code == "V4":
            c = four(name)
        elif code == "V16":
            c = F.unhex(_hex(F.col("seq") + i, 32))
        elif name in special:
            c = special[name]
        elif name in k.columns:
            c = F.col(name)
        else:
            c = (F.col("seq") * (i + 1)) % (1 << (8 * int(code[-1]) - 1 if code[-1] != "8" else 40))
        fields.append(c.cast(field.dataType).alias(name))
    return k.select(*fields)


def _path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def _round_trip(kind: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _path(spark, f"trace-{kind}")
        trace.write_trace(records_of(spark, sf_dir, kind), path, kind)
        return trace.read_trace(spark, path, kind).drop("_file", "_offset", "_corrupt", "direction")

    return run


def _readable(kind: str) -> Callable:
    """The round trip with its byte fields in hexadecimal digits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _round_trip(kind)(spark, sf_dir)
        return rows.select(*[F.hex(f.name).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f.name) for f in rows.schema])

    return run


def _record_sql(kind: str) -> str:
    """The records' fields, again from the events: named columns of k, or the event's number times the field's place."""
    own = {"time", "saddr", "daddr", "sport", "dport", "seq", "ack_num", "window", "urg", "ack", "psh", "rst", "syn", "fin", "checksum"}
    special = {"family": "2", "ports": "sport::BIGINT * 65536 + dport", "addr_v4": "(saddr % 2147483648) * 4294967296 + daddr"}
    fields = []
    for place, (name, code) in enumerate(KINDS[kind].fields, 1):
        if code == "V28":
            sql = f"'02000000' || printf('%08X', {name}) || repeat('0', 40)"
        elif code == "V4":
            sql = f"printf('%08X', {name})"
        elif code == "V16":
            sql = f"printf('%032X', seq + {place - 1})"
        elif name in special or name in own:
            sql = special.get(name, f'"{name}"')
        else:
            sql = f"(seq * {place}) % {1 << {'1': 7, '2': 15, '4': 31, '8': 40}[code[-1]]}"
        fields.append(f'{sql} AS "{name}"')
    addresses_ = f"{10 << 24} + user_id // 256 * 256 + user_id % 256 AS saddr, {192 << 24 | 168 << 16 | 1}::BIGINT AS daddr"
    return f"WITH {K_SQL}, r AS (SELECT *, {addresses_} FROM k) SELECT {', '.join(fields)} FROM r"


for _kind, _name in (("packet", "packet"), ("probe", "probe"), ("sock", "sock"), ("cwnd", "cwnd"), ("retransmit_synack", "synack"), ("bad_csum", "badcsum")):
    REGISTERED[f"trace_{_name}_roundtrip"] = (_readable(_kind), _record_sql(_kind))


def _written_dir(spark: SparkSession, sf_dir: str) -> str:
    path = _path(spark, "trace-dir")
    for stem, kind in (("xdp", "packet"), ("tc", "packet"), ("recv_cwnd", "cwnd")):
        trace.write_trace(records_of(spark, sf_dir, kind), f"{path}/{stem}.tcp", kind)
    return path


@key("trace_dir_counts", "SELECT kind, direction, count(*) AS n FROM events, (VALUES ('packet', 'ingress'), ('packet', 'egress'), ('cwnd', 'recv')) t(kind, direction) GROUP BY ALL")
def trace_dir_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trace.read_trace_dir(spark, _written_dir(spark, sf_dir))
    counts = [df.groupBy(F.lit(kind).alias("kind"), "direction").agg(F.count(F.lit(1)).alias("n")) for kind, df in found.items()]
    return counts[0].unionByName(counts[1])


@key("trace_file_sizes", "SELECT count(*) * (74 + 74 + 62) AS bytes FROM events")
def trace_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.trace_files(spark, _written_dir(spark, sf_dir)).agg(F.sum("length").alias("bytes"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of bad_csum as bytes, every tenth without its marker."""
    bad = F.col("event_id") % 10 == 3
    marker = F.when(bad, F.unhex(F.lit("00000000"))).otherwise(F.unhex(F.lit("FFFFFFFF")))
    fields = [F.unhex(_hex(F.col(c), n)) for c, n in (("time", 16), ("saddr", 8), ("daddr", 8))]
    return packets(spark, sf_dir).select(F.concat(*fields, marker).alias("record"))


@key("trace_corrupt_modes", "SELECT mode, corrupt, count(*) AS n FROM (SELECT event_id % 10 = 3 AS corrupt FROM events), (VALUES ('DROPMALFORMED'), ('PERMISSIVE')) t(mode) WHERE NOT (corrupt AND mode = 'DROPMALFORMED') GROUP BY ALL")
def trace_corrupt_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth record loses its marker: bad_csum records read back as records of 20 bytes whose last four are data."""
    path = _path(spark, "trace-corrupt")
    trace.write_raw(_marked(spark, sf_dir), path)
    modes = [trace.read_trace(spark, path, "bad_csum", mode=m).select(F.lit(m).alias("mode"), F.col("_corrupt").alias("corrupt")) for m in ("DROPMALFORMED", "PERMISSIVE")]
    return modes[0].unionByName(modes[1]).groupBy("mode", "corrupt").agg(F.count(F.lit(1)).alias("n"))


@key("stream_tail", "SELECT count(*) AS n, sum(event_id)::BIGINT AS seq FROM events")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of a trace as a stream, drained into a table."""
    path, out = _path(spark, "trace-tail"), _path(spark, "tail")
    trace.write_trace(records_of(spark, sf_dir, "packet"), path, "packet")
    stream = trace.stream_trace(spark, path, "packet").select("seq")
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("seq long").parquet(f"{out}/rows").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq"))


@key("trace_append", "SELECT event_id % 2 AS part, count(*) AS n, sum(event_id)::BIGINT AS seq FROM events GROUP BY ALL")
def trace_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace written in two appends to one folder, tailed by a stream after each; the stream's rows in all."""
    path, out = _path(spark, "trace-append"), _path(spark, "append")
    records = records_of(spark, sf_dir, "packet")
    for part in (0, 1):
        trace.write_trace(records.filter(F.col("seq") % 2 == part), path, "packet")
        stream = trace.stream_trace(spark, path, "packet").select("seq")
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.schema("seq long").parquet(f"{out}/rows")
    return rows.groupBy((F.col("seq") % 2).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq"))


@key("live_counters", "SELECT count(*) FILTER (WHERE event_id % 10 <> 3) AS handled, count(*) FILTER (WHERE event_id % 10 = 3) AS dropped FROM events")
def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handled and dropped records of a stream, as its progress reports them for each batch, in all."""
    path, out = _path(spark, "trace-counted"), _path(spark, "counted")
    trace.write_raw(_marked(spark, sf_dir), path)
    stream = live.live_counters(trace.stream_trace(spark, path, "bad_csum", mode="PERMISSIVE"))
    query = stream.select("time").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    # One entry for each batch of the stream.
    seen = [p.observedMetrics["records"] for p in query.recentProgress if "records" in p.observedMetrics]
    counts = spark.createDataFrame([(r["handled"], r["dropped"]) for r in seen], "handled long, dropped long")
    return counts.agg(F.sum("handled").alias("handled"), F.sum("dropped").alias("dropped"))


@key("stream_flows", f"WITH {K_SQL} SELECT DISTINCT src, dst, sport, dport, l4proto FROM k")
def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a packet stream as they appear; a flow silent for a year would appear again."""
    path, out = _path(spark, "trace-flows"), _path(spark, "flows")
    trace.write_trace(records_of(spark, sf_dir, "packet"), path, "packet")
    rows = live.event_time(addresses.with_flow(trace.stream_trace(spark, path, "packet"), "packet"))
    query = live.live_flows(rows, "365 days").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_time timestamp, src string, dst string, sport int, dport int, l4proto int").parquet(f"{out}/rows").drop("event_time")


_IDLE_US, _DELAY_MS = 14_400_000_000, 3_600_000


@key("flow_table", f"""WITH {K_SQL}, g AS (SELECT *, time // 1000 AS t, CASE WHEN time // 1000 - lag(time // 1000) OVER f <= {_IDLE_US} THEN 0 ELSE 1 END AS fresh FROM k WINDOW f AS (PARTITION BY flow_id ORDER BY time)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY flow_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS span FROM g),
a AS (SELECT src, dst, sport, dport, l4proto, span, max(span) OVER (PARTITION BY flow_id) AS spans, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY flow_id, src, dst, sport, dport, l4proto, span),
wm AS (SELECT max(time // 1000) // 1000 - {_DELAY_MS} AS mark FROM k)
SELECT src, dst, sport, dport, l4proto, 'open' AS event, first_us, first_us AS last_us, 0 AS n FROM a
UNION ALL SELECT src, dst, sport, dport, l4proto, 'idle', first_us, last_us, n FROM a, wm WHERE span < spans OR (last_us + {_IDLE_US} + 999) // 1000 <= mark""")
def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a packet stream as they come and, after four hours of silence, go."""
    path, out = _path(spark, "trace-table"), _path(spark, "table")
    trace.write_trace(records_of(spark, sf_dir, "packet"), path, "packet")
    rows = live.event_time(addresses.with_flow(trace.stream_trace(spark, path, "packet"), "packet"))
    with live.state_store(spark):
        found = live.flow_table(rows, _IDLE_US / 1e6, "1 hour")
        query = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()
        # Unlike one that drains and ends, a running stream goes on to what the last records' time lets expire.
        query.processAllAvailable()
        query.stop()
    rows = spark.read.schema(found.schema).parquet(f"{out}/rows")
    return rows.select("src", "dst", "sport", "dport", "l4proto", "event", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "n")
