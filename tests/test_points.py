import ipaddress
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowseries.functions.addresses import TUPLE, hashed_id_of, ipv4_bytes, ipv4_pair, ipv6, ports, swap_direction, tcp_flags, with_flow
from flowseries.functions.labels import format_elapsed, format_rate, format_sum
from flowseries.functions.values import type_name, type_tag, value_string, where_value
from flowseries.operators import bounds, metrics, plot, points, windows
from flowseries.operators.bounds import Window2D
from flowseries.schema import KINDS, POINTS

COLS = [c.split()[0] for c in POINTS.split(", ")]


def pts(spark, rows):
    """(flow, name, ts, value) as points; the value's type sets the tag."""
    out = []
    for flow, name, ts, v in rows:
        tag = 2 if isinstance(v, bool) else 0 if isinstance(v, int) else 1 if isinstance(v, float) else 3
        cells = [v if i == tag else None for i in range(4)]
        out.append((flow, hashed_id_of(flow, name), name, tag, float(ts), int(ts * 1e9), *cells))
    return spark.createDataFrame(out, POINTS)


SAMPLE = [(1, "TestTS", t, v) for t, v in ((0.0, 10), (0.5, 10), (1.0, 11), (2.0, 12), (3.0, 13), (99.0, 3), (100.0, 4))]


def test_record_sizes():
    assert {k: v.size for k, v in KINDS.items()} == {"packet": 74, "probe": 116, "sock": 160, "cwnd": 62, "retransmit_synack": 58, "bad_csum": 20}
    assert [len(KINDS[k].series) for k in ("packet", "probe", "sock", "cwnd")] == [10, 10, 25, 1]


def test_golden_series(spark):
    p = pts(spark, SAMPLE)
    assert bounds.point_counts(p).first().n_points == 7
    assert bounds.series_bounds(p).first()[3:] == (0.0, 100.0, 3.0, 13.0)
    assert bounds.flow_bounds(p).first()[1:] == (0.0, 100.0)
    r = windows.first_last(p).first()
    assert (r.first_value, r.last_value) == (10.0, 4.0)
    r = windows.extremes(p).first()
    assert (r.low_ts, r.low_value, r.high_ts, r.high_value) == (99.0, 3.0, 3.0, 13.0)


def test_zero_suppression(spark):
    row = {f.name: 0 for f in KINDS["cwnd"].struct if f.dataType.typeName() == "long"} | {"time": 5, "snd_cwnd": 0}
    rec = spark.createDataFrame([{**row, "src": "a", "dst": "b", "sport": 1, "dport": 2, "l4proto": 6}])
    assert points.to_points(rec, "cwnd").count() == 0
    assert points.to_points(rec, "cwnd", suppress_zero=False).select("name", "value_int", "ts").collect() == [("perf_snd_cwnd", 0, 5.0)]


def test_flow_of_kinds(spark):
    one = spark.createDataFrame([(0x0A000001 << 32 | 0x0A000002, 0x1234ABCD, 2)], "addr_v4 long, ports long, family long").withColumns({"src_v6": F.lit(bytes(16)), "dst_v6": F.lit(bytes(16))})
    assert with_flow(one, "sock").select(*TUPLE).first() == ("1.0.0.10", "2.0.0.10", 0x1234, 0xCDAB, 6)
    assert with_flow(one, "cwnd").select("sport", "dport").first() == (0x3412, 0xCDAB)
    assert with_flow(one, "cwnd", "host").select("sport", "dport").first() == (0x1234, 0xABCD)
    v6 = bytes.fromhex("20010db8000000000000000000000001")
    six = one.withColumns({"family": F.lit(10), "src_v6": F.lit(v6), "dst_v6": F.lit(bytes(15) + b"\1")})
    assert with_flow(six, "sock").select("src", "dst").first() == ("2001:db8::1", "::1")
    zero = spark.createDataFrame([(0, 5, v6, v6, 1, 2)], "saddr long, daddr long, saddr_v6 binary, daddr_v6 binary, sport long, dport long")
    assert with_flow(zero, "packet").first().src == "2001:db8::1"  # IPv4 only if neither address is zero


def test_bits(spark):
    one = spark.range(1)
    src, dst = ipv4_pair(F.lit(-1).cast("long"))
    assert one.select(src, dst).first() == ("255.255.255.255", "255.255.255.255")
    assert one.select(ipv4_bytes(F.lit(bytes([192, 168, 0, 1])))).first()[0] == "192.168.0.1"
    assert one.select(*ports(F.lit(0x0050_01BB))).first() == (80, 443)
    assert one.select(tcp_flags(F.lit(0x12)).alias("f")).select("f.*").first() == (False, True, False, False, True, False)


def test_direction(spark):
    df = spark.createDataFrame([("recv", "a", "b", 1, 2), ("send", "a", "b", 1, 2)], "direction string, src string, dst string, sport int, dport int")
    assert [tuple(r)[1:] for r in swap_direction(df).collect()] == [("b", "a", 2, 1), ("a", "b", 1, 2)]
    assert [tuple(r)[1:] for r in swap_direction(df, addresses=False).collect()] == [("a", "b", 2, 1), ("a", "b", 1, 2)]


def test_labels(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert [f(format_rate(F.lit(x), "B")) for x in (1000.0, 1000.5, 2.5e6, 3e9)] == ["1000.00 B", "1.00 KB", "2.50 MB", "3.00 GB"]
    assert f(format_sum(F.lit(12), "")) == "12 "
    assert f(format_elapsed(F.lit(61_005))) == "61s 5ms"


def test_values(spark):
    p = pts(spark, [(1, "a", 0, 5), (1, "b", 0, 2.5), (1, "c", 0, True), (1, "d", 0, "x")])
    assert [r[0] for r in p.orderBy("name").select(value_string()).collect()] == ["5", "2.5", "1", "x"]
    assert [where_value(p, ">", v).count() for v in (4, 2.0, False, "w")] == [1, 1, 1, 1]
    assert [where_value(p, "<=", v).count() for v in (4, 2.5, True, "w")] == [0, 1, 1, 0]
    assert p.orderBy("type").select(type_name(F.col("type"))).first()[0] == "Int"
    assert spark.range(1).select(type_tag(F.lit("String")), type_tag(F.lit("?"))).first() == (3, None)


def test_duplicates(spark):
    p = pts(spark, [(1, "a", 0, 5), (1, "a", 0, 4), (1, "a", 1, 4)])
    good, rest = points.split_duplicates(p, ["value_int"])
    assert sorted(r.value_int for r in good.collect()) == [4, 4] and [r.value_int for r in rest.collect()] == [5]
    with pytest.raises(PySparkException):
        points.split_duplicates(p, ["value_int"], "error")[0].count()


def test_duplicates_without_a_sort_of_all(spark):
    p = pts(spark, [(1, "a", t, t) for t in range(50)] + [(1, "a", 7, 3), (1, "a", 7, 9)])
    good, rest = points.split_duplicates(p, ["value_int"])
    assert good.count() == 50 and good.filter("ts = 7").first().value_int == 3 and sorted(r.value_int for r in rest.collect()) == [7, 9]
    none = p.withColumn("ts", F.when(F.col("ts") > 48, None).otherwise(F.col("ts")))
    assert points.split_duplicates(none.unionByName(none.filter("ts IS NULL")), ["value_int"])[0].filter("ts IS NULL").count() == 1


def test_split_duplicates_shuffles_hashes_only(spark):
    """Points of single keys stay where they are read: no plan of theirs sorts, shuffles or joins them but by broadcast."""
    p = pts(spark, [(1, "a", t, t) for t in range(2000)])
    good, rest = points.split_duplicates(p.unionByName(p.filter("ts < 5")), ["value_int", "value_float"])
    assert good.count() == 2000 and rest.count() == 5
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_bounds_edges(spark):
    p = pts(spark, [(1, "a", 0, 5), (1, "a", 1, 5), (1, "s", 2, "x")])
    assert bounds.selection_y_bounds(p).first() == (-5.0, 15.0)
    assert bounds.selection_y_bounds(p, [1]).first() == (None, None)
    assert bounds.default_window(p, 99).first() == (0.0, 100.0, 0.0, 10.0)
    w = Window2D(0.0, 3.0, 4.0, 6.0)
    assert bounds.in_window(p, w).orderBy("ts").select("ts").collect() == [(1.0,), (2.0,)]  # strict, and texts pass
    assert bounds.window_y_bounds(p, Window2D(50.0, 60.0, 1.0, 2.0)).first() == (1.0, 2.0)
    assert bounds.series_bounds(p.filter("type = 3")).first()[5:] == (None, None)
    assert w.is_narrow() and not w.is_narrow(2.0)


@pytest.mark.parametrize("bucket", [None, 1.0, 50.0])
def test_windows_with_and_without_buckets(spark, bucket):
    p = pts(spark, SAMPLE)
    assert [r.ts for r in windows.every_nth(p, 3, bucket).orderBy("ts").collect()] == [0.0, 2.0, 100.0]
    assert [r.running_max for r in windows.running_max(p, bucket).orderBy("ts").collect()] == [10, 10, 11, 12, 13, 13, 13]
    both = p.unionByName(pts(spark, [(1, "B", t, v) for t, v in ((0.2, 1.5), (1.0, 2.5), (60.0, 3.5))]))
    assert [r.latest for r in windows.asof_fill(both, "TestTS", "B", bucket).orderBy("ts").collect()] == [None, 1.5, 2.5, 2.5, 2.5, 3.5, 3.5]
    pairs = windows.pair_series(both, "TestTS", "B", "position", bucket)
    assert sorted((r.ts, r.value_int_a, r.value_float_b) for r in pairs.collect()) == [(0.0, 10, 1.5), (0.5, 10, 2.5), (1.0, 11, 3.5)]


def test_decimation_count_and_rate(spark):
    p = pts(spark, SAMPLE)
    for n in range(1, 9):
        assert windows.every_nth(p, n).count() == -(-7 // n)
    with pytest.raises(ValueError):
        windows.every_nth(p, 0)
    for bucket in (None, 0.7, 10.0):
        assert [r.rate for r in windows.rate(p, bucket).orderBy("ts").collect()][:3] == [None, 0.0, 2.0]
    whole = [r.average for r in windows.twma(p, 3).orderBy("ts").collect()]
    for block in (1, 4, 100):
        assert [r.average for r in windows.twma(p, 3, 2.0, block=block).orderBy("ts").collect()] == whole
    assert [r.average for r in windows.twma(p, 2).orderBy("ts").collect()][:3] == [None, 10.0, 10.5]


def test_charts(spark):
    p = pts(spark, [(1, "f", t, t % 2 == 0) for t in range(450)] + [(1, "i", t, t) for t in range(450)] + [(1, "s", 3, "x")])
    wide = plot.prepare_combined(p, Window2D(-1.0, 1000.0, 0.0, 5.0))
    assert [(r.ts, r.y) for r in wide.filter("name = 'f'").orderBy("ts").collect()] == [(0.0, 3.0), (400.0, 3.0)]
    assert wide.filter("name = 'i'").count() == 4 and wide.filter("name = 's'").first().y is None
    assert plot.prepare_combined(p, Window2D(-1.0, 2.0, 0.0, 5.0)).filter("name = 'f'").count() == 1
    split = plot.prepare_split(p, Window2D(-1.0, 1000.0, 0.0, 5.0))
    assert split.filter("name = 'f'").count() == 23 and split.filter("name = 's'").count() == 0
    r = split.filter("name = 'i'").first()
    assert (r.y_lower, r.y_upper) == (1.0, 4.0)
    r = split.filter("name = 'f'").first()
    assert (r.y, r.y_lower, r.y_upper) == (1.0, 2.0, 0.0)  # half of -2, rounded, above the lower end


def test_upper_window(spark):
    p = pts(spark, [(1, "SND_UNA", t, 10 * t) for t in (1, 2, 4)] + [(1, "SND_WND", t, t) for t in (1, 3, 4)] + [(2, "SND_UNA", 1, 1)])
    ts = metrics.get("UPPER_WND").run(p)
    assert sorted((r.flow_id, r.ts, r.value_int) for r in ts.collect()) == [(1, 1.0, 11), (1, 4.0, 44)]
    pos = metrics.get("UPPER_WND", align="position").run(p)
    assert sorted((r.ts, r.value_int) for r in pos.collect()) == [(1.0, 11), (2.0, 23), (4.0, 44)]
    mixed = pts(spark, [(1, "SND_UNA", 1, 1), (1, "SND_WND", 1, 1.0)])
    assert metrics.get("UPPER_WND").run(mixed).count() == 0
    with pytest.raises(PySparkException):
        metrics.get("UPPER_WND", strict=True).run(mixed).collect()


@pytest.mark.parametrize("bucket", [None, 1.0, 2.5])
def test_acks_and_retransmissions(spark, bucket):
    acks = pts(spark, [(1, "ACK_NUM", t, v) for t, v in enumerate((5, 5, 6, 5, 5))])
    assert sorted(r.ts for r in metrics.get("DUP_ACK", time_bucket=bucket).run(acks).collect()) == [1.0, 4.0]
    top = (1 << 32) - 10
    seqs = pts(spark, [(1, "SEQ_NUM", t, v) for t, v in enumerate((top, 5, top + 2, 100, 100, 50, 200))])
    assert sorted(r.ts for r in metrics.get("RETRANS", time_bucket=bucket).run(seqs).collect()) == [2.0, 4.0, 5.0]


@pytest.mark.parametrize("bucket", [None, 2.0])
def test_payload_progress_is_no_duplicate_ack(spark, bucket):
    rows = [("ACK_NUM", t, 7) for t in range(8)]
    rows += [("SEQ_NUM", t, v) for t, v in enumerate((1, 2, 3, 3, 3, 3, 3, 3))] + [("WINDOW", t, v) for t, v in enumerate((9, 9, 9, 9, 8, 8, 8, 8))]
    rows += [("FLAG_FIN", 6, True), ("FLAG_SYN", 5, False)]
    p = pts(spark, [(1, n, t, v) for n, t, v in rows])
    found = metrics.get("DUP_ACK", time_bucket=bucket).run(p).collect()
    assert sorted(r.ts for r in found) == [3.0, 5.0, 7.0] and {r.value_int for r in found} == {7} and found[0].ts_ns == found[0].ts * 1e9


def test_buckets_change_no_retransmission(spark):
    import random

    r, rows = random.Random(2), []
    for flow in (1, 2):
        v = (1 << 32) - 4000
        for t in range(200):
            v += r.choice([1000, 1, -1500, 0, 1 << 30, 50_000])
            rows.append((flow, "SEQ_NUM", t, v % (1 << 32)))
    p = pts(spark, rows)
    want = sorted((x.flow_id, x.ts) for x in metrics.get("RETRANS").run(p).collect())
    assert want and all(sorted((x.flow_id, x.ts) for x in metrics.get("RETRANS", time_bucket=b).run(p).collect()) == want for b in (1.0, 7.0, 1000.0))


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_metrics_read_their_points_once_or_twice(spark, tmp_path):
    pts(spark, [(1, "SEQ_NUM", t, 20 - t) for t in range(15)]).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    assert scans(metrics.get("UPPER_WND").run(p)) == 1
    assert [scans(metrics.get(n, time_bucket=5.0).run(p)) for n in ("DUP_ACK", "RETRANS")] == [2, 2]
    assert [scans(metrics.get(n).run(p)) for n in ("DUP_ACK", "RETRANS")] == [1, 1]


def test_frames(spark):
    from flowseries.operators.frames import decode_frames

    ethernet = lambda kind: bytes(12) + bytes.fromhex(kind)
    tcp = bytes.fromhex("01bb1f90") + (0xFFFFFFFE).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"\x50\x3f" + (99).to_bytes(2, "big") + b"\x12\x34\0\0"
    four = lambda words, proto=6: bytes([0x40 | words]) + bytes(8) + bytes([proto]) + bytes(2) + bytes([10, 0, 0, 1, 192, 168, 0, 1]) + bytes(4 * max(0, words - 5))
    six = bytes.fromhex("60000000") + b"\0\x14\x06\x40" + bytes(range(16)) + bytes(range(16, 32))
    frames = [ethernet("0800") + four(5) + tcp, ethernet("0800") + four(15) + tcp + b"payload", ethernet("86dd") + six + tcp, ethernet("0800") + four(3) + tcp]
    bad = [None, b"", b"x", ethernet("0806") + four(5) + tcp, ethernet("0800") + four(5, 17) + tcp, ethernet("0800") + four(5) + tcp[:19], ethernet("0800") + four(15)[:58] + tcp, ethernet("86dd") + six + tcp[:-1]]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(frames + bad)], "time long, frame binary").coalesce(1)
    rows = decode_frames(df).orderBy("time").collect()
    assert [r.time for r in rows] == [0, 1, 2, 3]
    assert {(r.sport, r.dport, r.seq, r.ack_num, r.window, r.checksum) for r in rows} == {(443, 8080, 0xFFFFFFFE, 7, 99, 0x1234)}
    assert all(r.urg and r.ack and r.psh and r.rst and r.syn and r.fin for r in rows)
    assert [(r.saddr, r.daddr) for r in rows] == [(10 << 24 | 1, 0xC0A80001)] * 2 + [(0, 0)] + [(10 << 24 | 1, 0xC0A80001)]
    assert bytes(rows[2].saddr_v6) == bytes(range(16)) and bytes(rows[2].daddr_v6) == bytes(range(16, 32)) and bytes(rows[0].saddr_v6) == bytes(16)
    assert decode_frames(df.filter("false")).count() == 0


def test_random_series(spark):
    found = metrics.get("tst_rndm", source="TestTS").run(pts(spark, SAMPLE)).collect()
    assert len(found) == 7 and all(4e7 <= r.value_float < 5.2e8 for r in found)
    assert metrics.names() == ["DUP_ACK", "RETRANS", "UPPER_WND", "tst_rndm"]


def test_wide_rows(spark):
    p = pts(spark, [(1, "a", 0, 5), (1, "b", 0, True), (1, "a", 1, 6)])
    assert points.to_wide(p, ["a", "b"]).orderBy("ts").collect() == [(1, 0.0, 5.0, 1.0), (1, 1.0, 6.0, None)]


def bursts(spark):
    """A third of all points in one series, most of them in one burst; ties of time between series."""
    rows = [(1, "hot", 10_000 + t, (t * 7919) % 1000) for t in range(900)] + [(1, "hot", t * 1_000_000, t % 7) for t in range(1, 30)]
    rows += [(f, "a", t * 50 + f, (t * f) % 11) for f in range(2, 40) for t in range(50)]
    return pts(spark, [(f, n, float(t), v) for f, n, t, v in rows]).repartition(8)


def test_even_buckets_hold_about_as_many_rows(spark):
    df = windows.bucket_points(bursts(spark), windows.even(100))
    sizes = {(r.name, r["_b"]): r["count"] for r in df.groupBy("name", "_b").count().collect() if r.name == "hot"}
    assert len(sizes) >= 5 and max(sizes.values()) <= 250 and sum(sizes.values()) == 929
    assert df.filter("name <> 'hot' AND _b > 0").isEmpty()
    order = df.filter("name = 'hot'").groupBy("_b").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).orderBy("_b").collect()
    assert all(a.high < b.low for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("rows", [40, 1 << 20])
def test_even_buckets_change_no_result(spark, rows):
    df, cut = bursts(spark).cache(), windows.even(rows)
    same = lambda f: sorted(map(tuple, f(cut).collect()), key=repr) == sorted(map(tuple, f(None).collect()), key=repr)
    assert same(lambda b: windows.rate(df, b).select("series_id", "ts", "rate"))
    assert same(lambda b: windows.running_max(df, b).select("series_id", "ts", "running_max"))
    assert same(lambda b: windows.every_nth(df, 7, b).select("series_id", "ts"))
    assert same(lambda b: windows.twma(df, 5, b, block=64).select("series_id", "ts", F.round("average", 6)))
    assert same(lambda b: windows.behind(df, F.col("value_int"), 1 << 10, b).select("series_id", "ts"))
    both = df.withColumn("name", F.when((F.col("value_int") % 2 == 0), "even").otherwise("odd"))
    assert same(lambda b: windows.asof_fill(both, "odd", "even", b).select("flow_id", "ts", "latest"))


@pytest.mark.parametrize("cut", [windows.even(40), 500.0, 1e9])
def test_state_is_handed_from_bucket_to_bucket(spark, cut):
    df = bursts(spark).filter("name = 'hot'")
    found = {r.ts: r.value_float for r in metrics.Smoothed(source="hot", time_bucket=cut).run(df).collect()}
    at, want = None, {}
    for ts, v in sorted((r.ts, r.value_int) for r in df.collect()):
        at = float(v) if at is None else at + (v - at) / 8
        want[ts] = at
    assert found.keys() == want.keys() and all(abs(found[t] - want[t]) < 1e-6 for t in want)


def test_rates_round_as_c_does(spark):
    """By the exact binary value, ties to even: 1.125 and 1.375 are ties, 1.005 lies below and 1.115 above its half."""
    rows = spark.createDataFrame([(v,) for v in (1125.0, 1375.0, 1005.0, 1115.0, 0.5, 2.5, -1.125, 999.995)], "v double")
    got = [tuple(r) for r in rows.select(format_rate(F.col("v"), "B"), format_sum(F.col("v"), "B")).collect()]
    assert [g[0] for g in got] == ["1.12 KB", "1.38 KB", "1.00 KB", "1.11 KB", "0.50 B", "2.50 B", "-1.12 B", "1000.00 B"]
    assert [g[1] for g in got[4:]] == ["0 B", "2 B", "-1 B", "1000 B"]


def test_python_metrics_take_many_flows_at_once(spark):
    """Flows of one call keep whole numbers whole, whatever other flows and flows without an id bring."""
    from flowseries.operators import metrics as m

    class Low(m.PandasMetric):
        name, required, looks_up_flows = "LOW", ("a",), False

        def compute_flow(self, frame):
            assert frame["flow_id"].nunique(dropna=False) == 1
            return frame.assign(value=(frame["value_int"] % 1000).astype(float))[["ts", "value"]]

    big = (1 << 60) + 123
    rows = [(big + f, "a", float(t), big) for f in range(40) for t in range(3)]
    p = spark.createDataFrame([(f, 1, n, 0, t, None, v, None, None, None) for f, n, t, v in [*rows, (None, "a", 0.0, big)]], POINTS)
    m._CALLS, calls = 2, m._CALLS
    try:
        got = Low().run(p).collect()
    finally:
        m._CALLS = calls
    assert len(got) == 121 and {r.value_float for r in got} == {float(big % 1000)} and {r.flow_id for r in got} == {None, *[big + f for f in range(40)]}


def test_ipv6_text_needs_no_python(spark):
    rng = random.Random(3)
    groups = [[rng.choice((0, 0, 1, 16, 256, 4096, 65535)) for _ in range(8)] for _ in range(600)] + [[0] * 8, [1] * 8, [0] * 7 + [1], [1] + [0] * 7, [0] * 5 + [65535, 258, 772], [0] * 5 + [65535, 0, 0]]
    raw = [b"".join(g.to_bytes(2, "big") for g in row) for row in groups]
    found = spark.createDataFrame([(x,) for x in [*raw, b"short", None]], "raw binary").select(ipv6(F.col("raw")).alias("text"))
    assert [r.text for r in found.collect()] == [*(str(ipaddress.IPv6Address(x)) for x in raw), None, None]
    packets = spark.createDataFrame([(0, 0, raw[0], raw[1], 1, 2), (1 << 24, 2 << 24, None, None, 1, 2)], "saddr long, daddr long, saddr_v6 binary, daddr_v6 binary, sport int, dport int")
    assert "Python" not in with_flow(packets, "packet")._jdf.queryExecution().executedPlan().toString()


def test_zeros_are_dropped_in_compiled_code(spark):
    record = {"flow": None, "time": 5, "saddr": 1 << 24, "daddr": 2 << 24, "sport": 1, "dport": 2, "seq": 0, "ack_num": 9, "window": None, "urg": False, "ack": True, "psh": None, "rst": False, "syn": False, "fin": False, "checksum": 0, "saddr_v6": None, "daddr_v6": None}
    kinds = {"flow": "string", "saddr_v6": "binary", "daddr_v6": "binary", **dict.fromkeys(("urg", "ack", "psh", "rst", "syn", "fin"), "boolean")}
    rows = spark.createDataFrame([tuple(record.values())], ", ".join(f"{c} {kinds.get(c, 'long')}" for c in record))
    found = points.to_points(with_flow(rows, "packet"), "packet")
    assert sorted((r.name, r.value_int, r.value_bool) for r in found.collect()) == [("ACK_NUM", 9, None), ("FLAG_ACK", None, True)]
    assert "filter(array" not in found._jdf.queryExecution().executedPlan().toString()
