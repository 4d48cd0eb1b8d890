"""Queries over points, packets and attributes that rest on expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseries.functions.addresses import filter_port, swap_direction
from flowseries.functions.labels import flow_label, format_elapsed, format_rate, format_sum
from flowseries.functions.values import as_float, as_int, type_column, type_name, type_tag, value_num, value_string, where_value
from flowseries.operators import bounds, metrics, plot, points, windows
from flowseries.operators.bounds import Window2D
from flowseries.plans.testmaps import A_SQL, E_SQL, K_SQL, L_SQL, P_SQL, attributes, event_flows, event_points, packets, probe_points, user_flow, user_series
from flowseries.sources.store import complete_series
from flowseries.streaming import live

REGISTERED: dict[str, tuple[Callable, str | None]] = {}
WINDOW = Window2D(1704672000000000.0, 1705881600000000.0, 5.0, 50.0)
DAY = 86_400_000_000.0
_BOX = "ts > 1704672000000000 AND ts < 1705881600000000 AND (v IS NULL OR (v > 5 AND v < 50))"
_FLOW = f"flow_id = {user_flow(7)}"
_IDS = [user_series(7, n) for n in ("click", "view", "error")]
_OTHER_IDS = [user_series(8, n) for n in ("click", "view")]
_IN = f"series_id IN ({', '.join(map(str, _IDS))})"


def key(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        REGISTERED[name] = (f, sql)
        return f

    return add


def of(source: Callable) -> Callable:
    """Queries that are one function of one mapped table."""

    def named(name: str, sql: str, use: Callable[[DataFrame], DataFrame]) -> None:
        REGISTERED[name] = (lambda spark, sf_dir: use(source(spark, sf_dir)), sql)

    return named


on_points, on_packets, on_probe, on_attributes, on_events = of(event_points), of(packets), of(probe_points), of(attributes), of(event_flows)
_COLS = ("flow_id", "series_id", "name", "ts")
_r = lambda c: F.round(c, 6)

# Aggregations
on_points("series_bounds", f"WITH {P_SQL} SELECT flow_id, series_id, name, min(ts) AS xmin, max(ts) AS xmax, min(v) AS ymin, max(v) AS ymax FROM p GROUP BY ALL", bounds.series_bounds)
on_points("flow_bounds", f"WITH {P_SQL} SELECT flow_id, min(ts) AS xmin, max(ts) AS xmax FROM p GROUP BY ALL", bounds.flow_bounds)
on_points("point_counts", f"WITH {P_SQL} SELECT series_id, count(*) AS n_points FROM p GROUP BY ALL", bounds.point_counts)
_PAD = "CASE WHEN min(v) = max(v) THEN min(v) - 10 ELSE min(v) END AS y_lower, CASE WHEN min(v) = max(v) THEN max(v) + 10 ELSE max(v) END AS y_upper"
on_points("selection_y_bounds", f"WITH {P_SQL} SELECT flow_id, {_PAD} FROM p WHERE name = 'view' GROUP BY flow_id", lambda p: bounds.flow_y_bounds(p.filter("name = 'view'")))
on_points("window_y_bounds", f"WITH {P_SQL} SELECT coalesce(min(v), 5) AS y_lower, coalesce(max(v), 50) AS y_upper FROM p WHERE {_BOX}", lambda p: bounds.window_y_bounds(p, WINDOW))


def _windows_of_flows(p: DataFrame) -> DataFrame:
    return bounds.flow_bounds(p).join(bounds.flow_y_bounds(p), "flow_id").withColumnsRenamed({"xmin": "x_lower", "xmax": "x_upper"})


on_points("bounds_merge", f"WITH {P_SQL}, b AS (SELECT flow_id, min(ts) AS x0, max(ts) AS x1, {_PAD} FROM p GROUP BY flow_id) SELECT min(x0) AS x_lower, max(x1) AS x_upper, min(y_lower) AS y_lower, max(y_upper) AS y_upper FROM b", lambda p: bounds.merge_bounds(_windows_of_flows(p)))


def _default_sql(flow: int, ids: list[int], cte: str) -> str:
    chosen = f"min(v) FILTER (WHERE series_id IN ({', '.join(map(str, ids))}))"
    top = chosen.replace("min(", "max(", 1)
    return f"{cte} AS (SELECT coalesce(min(ts), 0) AS x_lower, coalesce(max(ts), 100) AS x_upper, coalesce(CASE WHEN {chosen} = {top} THEN {chosen} - 10 ELSE {chosen} END, 0) AS y_lower, coalesce(CASE WHEN {chosen} = {top} THEN {top} + 10 ELSE {top} END, 10) AS y_upper FROM p WHERE flow_id = {flow})"


on_points("default_window", f"WITH {P_SQL}, {_default_sql(user_flow(7), _IDS, 'x')} SELECT * FROM x", lambda p: bounds.default_window(p, user_flow(7), _IDS))
on_points("default_window_pair", f"WITH {P_SQL}, {_default_sql(user_flow(7), _IDS, 'x')}, {_default_sql(user_flow(8), _OTHER_IDS, 'y')}, z AS (SELECT * FROM x UNION ALL SELECT * FROM y) SELECT min(x_lower) AS x_lower, max(x_upper) AS x_upper, min(y_lower) AS y_lower, max(y_upper) AS y_upper FROM z", lambda p: bounds.default_window_pair(p, (user_flow(7), _IDS), (user_flow(8), _OTHER_IDS)))
on_points("series_listing", f"WITH {P_SQL} SELECT flow_id, series_id, name, 'Float' AS type_name, count(*) AS n_points FROM p GROUP BY ALL", lambda p: bounds.series_listing(points.catalog(p), p))
on_events("flow_listing", f"WITH {E_SQL} SELECT DISTINCT flow_id AS id, src, dst, sport, dport, l4proto FROM e ORDER BY id", lambda e: points.flows(e).orderBy("id"))
on_events("flow_count", f"WITH {E_SQL} SELECT count(DISTINCT flow_id) AS n_flows FROM e", bounds.flow_count)
on_events("flows_distinct", f"WITH {E_SQL} SELECT DISTINCT flow_id AS id, src, dst, sport, dport, l4proto FROM e", points.flows)
on_points("series_catalog", f"WITH {P_SQL} SELECT DISTINCT series_id, flow_id, name, type FROM p", points.catalog)

# Order and windows
on_points("first_last_point", f"WITH {P_SQL} SELECT series_id, min(ts) AS first_ts, arg_min(v, ts) AS first_value, max(ts) AS last_ts, arg_max(v, ts) AS last_value FROM p GROUP BY series_id", windows.first_last)
on_points("extreme_points", f"WITH {P_SQL}, b AS (SELECT series_id, min(v) AS lo, max(v) AS hi FROM p GROUP BY series_id) SELECT series_id, min(ts) FILTER (WHERE v = lo) AS low_ts, lo AS low_value, min(ts) FILTER (WHERE v = hi) AS high_ts, hi AS high_value FROM p JOIN b USING (series_id) GROUP BY series_id, lo, hi", windows.extremes)
on_points("points_of_series", f"WITH {P_SQL} SELECT ts, v AS value FROM p WHERE series_id = {_IDS[0]} ORDER BY ts", lambda p: p.filter(F.col("series_id") == _IDS[0]).orderBy("ts").select("ts", value_num().alias("value")))
on_points("decimate", f"WITH {P_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM p) SELECT flow_id, series_id, name, ts, v AS value FROM i WHERE i % 4 = 0", lambda p: windows.every_nth(p, 4, DAY).select(*_COLS, value_num().alias("value")))
on_points("twma", f"WITH {P_SQL}, t AS (SELECT *, coalesce(ts - lag(ts) OVER w, 0) AS d FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts)) SELECT flow_id, series_id, name, ts, round(sum(v * d) OVER w / nullif(sum(d) OVER w, 0), 6) AS average FROM t WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", lambda p: windows.twma(p, 5, DAY).select(*_COLS, _r("average").alias("average")))
on_points("running_max", f"WITH {P_SQL} SELECT flow_id, series_id, name, ts, max(v) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS running_max FROM p", lambda p: windows.running_max(p, DAY).select(*_COLS, "running_max"))
on_points("asof_fill", f"WITH {P_SQL}, s AS (SELECT *, last_value(CASE WHEN name = 'click' THEN v END IGNORE NULLS) OVER (PARTITION BY flow_id ORDER BY ts, name <> 'click' ROWS UNBOUNDED PRECEDING) AS latest FROM p WHERE name IN ('view', 'click')) SELECT flow_id, series_id, name, ts, v AS value, latest FROM s WHERE name = 'view'", lambda p: windows.asof_fill(p, "view", "click", DAY).select(*_COLS, value_num().alias("value"), "latest"))
on_packets("counter_rate", f"WITH {K_SQL} SELECT series_id, ts, round(1e9 * (value_int - lag(value_int) OVER w) / nullif(ts - lag(ts) OVER w, 0), 6) AS rate FROM q WHERE name = 'SEQ_NUM' WINDOW w AS (PARTITION BY series_id ORDER BY ts)", lambda k: windows.rate(points.to_points(k, "packet").filter("name = 'SEQ_NUM'"), 1000 * DAY).select("series_id", "ts", _r(F.col("rate") * 1e9).alias("rate")))


@key("event_rate", f"WITH {E_SQL}, c AS (SELECT flow_id AS series_id, us // 3600000000 * 3600 AS h, count(*) FILTER (WHERE event_type <> 'error') AS handled, count(*) FILTER (WHERE event_type = 'error') AS dropped FROM e GROUP BY ALL), s AS (SELECT series_id, h::DOUBLE AS ts, sum(handled) OVER w AS handled, sum(dropped) OVER w AS dropped FROM c WINDOW w AS (PARTITION BY series_id ORDER BY h ROWS UNBOUNDED PRECEDING)) SELECT series_id, ts, round((handled + dropped - lag(handled + dropped) OVER w) / (ts - lag(ts) OVER w), 9) AS event_rate FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts)")
def event_rate(spark, sf_dir):
    from pyspark.sql import Window

    e = event_flows(spark, sf_dir).withColumn("ts", (F.floor(F.col("us") / 3_600_000_000) * 3600).cast("double"))
    n = lambda c: F.count(F.when(c, 1))
    hourly = e.groupBy(F.col("flow_id").alias("series_id"), "ts").agg(n(F.col("event_type") != "error").alias("h"), n(F.col("event_type") == "error").alias("d"))
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    counters = hourly.select("series_id", "ts", F.sum("h").over(w).alias("handled"), F.sum("d").over(w).alias("dropped"))
    return live.event_rate(counters).select("series_id", "ts", F.round("event_rate", 9).alias("event_rate"))


# Filters and look-ups
on_points("condition_ops", f"WITH {P_SQL}, o AS (SELECT * FROM (VALUES ('>'), ('<'), ('='), ('>='), ('<=')) t(op)) SELECT op, flow_id, series_id, ts FROM p, o WHERE CASE op WHEN '>' THEN v > 12.5 WHEN '<' THEN v < 12.5 WHEN '=' THEN v = 12.5 WHEN '>=' THEN v >= 12.5 ELSE v <= 12.5 END", lambda p: points.union_sources(*[where_value(p, op, 12.5).select(F.lit(op).alias("op"), "flow_id", "series_id", "ts") for op in (">", "<", "=", ">=", "<=")]))
on_points("window_filter", f"WITH {P_SQL} SELECT flow_id, series_id, ts, v AS value FROM p WHERE {_BOX}", lambda p: bounds.in_window(p, WINDOW).select("flow_id", "series_id", "ts", value_num().alias("value")))
on_packets("filter_port", f"WITH {K_SQL} SELECT flow_id, time, sport, dport FROM k WHERE sport = 40007 OR dport = 40007", lambda k: filter_port(k, 40007).select("flow_id", "time", "sport", "dport"))
on_packets("bool_true_only", f"WITH {K_SQL} SELECT series_id, ts FROM q WHERE value_bool", lambda k: plot.true_only(points.to_points(k, "packet", suppress_zero=False)).select("series_id", "ts"))
on_points("series_by_names", f"WITH {P_SQL}, s AS (SELECT DISTINCT flow_id, series_id, name FROM p WHERE name IN ('click', 'view')) SELECT * FROM s WHERE flow_id IN (SELECT flow_id FROM s GROUP BY flow_id HAVING count(*) = 2)", lambda p: complete_series(points.catalog(p), ["click", "view"]).select("flow_id", "series_id", "name"))
on_points("series_by_ids", f"WITH {P_SQL} SELECT DISTINCT flow_id, series_id, name FROM p WHERE {_IN}", lambda p: points.catalog(p).filter(F.col("series_id").isin(_IDS)).select("flow_id", "series_id", "name"))
on_points("series_of_flow", f"WITH {P_SQL} SELECT DISTINCT series_id, name FROM p WHERE {_FLOW}", lambda p: points.catalog(p).filter(_FLOW).select("series_id", "name"))
on_events("flow_label", f"WITH {E_SQL} SELECT DISTINCT flow_id AS id, 'ID:' || flow_id || ' Port: ' || sport || '-' || dport || ' IP: ' || src || '-' || dst AS label FROM e", lambda e: points.flows(e).select("id", flow_label().alias("label")))

# Reshape
on_packets("points_from_packets", f"WITH {K_SQL} SELECT flow_id, series_id, name, type, ts, ts_ns, value_int, value_bool FROM q", lambda k: points.to_points(k, "packet").drop("value_float", "value_text"))
on_packets("points_wide", f"WITH {K_SQL} SELECT flow_id, ts, max(value_int) FILTER (WHERE name = 'SEQ_NUM')::DOUBLE AS SEQ_NUM, max(value_int) FILTER (WHERE name = 'WINDOW')::DOUBLE AS \"WINDOW\", max(value_bool::INTEGER) FILTER (WHERE name = 'FLAG_SYN')::DOUBLE AS FLAG_SYN FROM q WHERE name IN ('SEQ_NUM', 'WINDOW', 'FLAG_SYN') GROUP BY flow_id, ts", lambda k: points.to_wide(points.to_points(k, "packet"), ["SEQ_NUM", "WINDOW", "FLAG_SYN"]))
on_packets("points_with_flow", f"WITH {K_SQL} SELECT q.flow_id, name, ts, src, sport, dst, dport FROM q JOIN (SELECT DISTINCT flow_id, src, sport, dst, dport FROM k) f USING (flow_id)", lambda k: points.to_points(k, "packet").join(points.flows(k).withColumnRenamed("id", "flow_id"), "flow_id").select("flow_id", "name", "ts", "src", "sport", "dst", "dport"))
on_packets("union_sources", f"WITH {K_SQL} SELECT flow_id, time, seq, CASE WHEN event_type IN ('view', 'click') THEN 'ingress' ELSE 'egress' END AS direction FROM k", lambda k: points.union_sources(*[k.filter(("" if d == "ingress" else "NOT ") + "event_type IN ('view', 'click')").withColumn("direction", F.lit(d)) for d in ("ingress", "egress")]).select("flow_id", "time", "seq", "direction"))
on_packets("direction_swap", f"WITH {K_SQL} SELECT time, CASE WHEN event_type = 'view' THEN dst ELSE src END AS src, CASE WHEN event_type = 'view' THEN src ELSE dst END AS dst, CASE WHEN event_type = 'view' THEN dport ELSE sport END AS sport, CASE WHEN event_type = 'view' THEN sport ELSE dport END AS dport FROM k", lambda k: swap_direction(k.withColumn("direction", F.when(F.col("event_type") == "view", "recv").otherwise("send"))).select("time", "src", "dst", "sport", "dport"))

# Duplicates
_ORDER = ["value_int", "value_float"]
_DUP = "flow_id, series_id, name, type, ts, value_int, value_float"
on_probe("dedup_points", f"WITH {L_SQL} SELECT {_DUP} FROM o", lambda p: points.split_duplicates(p, _ORDER)[0].select(*_DUP.split(", ")))
on_probe("dup_points", f"WITH {L_SQL} SELECT {_DUP} FROM d WHERE n > 1", lambda p: points.split_duplicates(p, _ORDER)[1].select(*_DUP.split(", ")))

# Values
on_attributes("type_tags", f"WITH {A_SQL} SELECT flow_id, name, type, ['Int', 'Float', 'Boolean', 'String'][type + 1] AS type_name, ['value_int', 'value_float', 'value_bool', 'value_text'][type + 1] AS type_column, type AS tag FROM a", lambda a: a.select("flow_id", "name", "type", type_name(F.col("type")).alias("type_name"), type_column(F.col("type")).alias("type_column"), type_tag(type_name(F.col("type"))).alias("tag")))
on_attributes("value_as_string", f"WITH {A_SQL} SELECT flow_id, name, coalesce(value_text, value_int::VARCHAR, value_float::VARCHAR) AS value FROM a", lambda a: a.select("flow_id", "name", value_string().alias("value")))
on_attributes("value_casts", f"WITH {A_SQL} SELECT flow_id, name, CASE WHEN type = 0 THEN value_int END AS as_int, CASE WHEN type = 1 THEN value_float END AS as_float, type = 0 AS is_int FROM a", lambda a: a.select("flow_id", "name", as_int().alias("as_int"), as_float().alias("as_float"), (F.col("type") == 0).alias("is_int")))
on_attributes("value_num", f"WITH {A_SQL} SELECT flow_id, name, coalesce(value_float, value_int::DOUBLE) AS value FROM a", lambda a: a.select("flow_id", "name", value_num().alias("value")))
on_attributes("string_points", f"WITH {A_SQL} SELECT flow_id, flow_id || '.0 | ' || value_text AS label FROM a WHERE type = 3", lambda a: plot.string_points(a.withColumn("ts", F.col("flow_id").cast("double"))).select("flow_id", "label"))

# Labels
_UNIT = "CASE WHEN x > 1e9 THEN printf('%.2f G{0}', x / 1e9) WHEN x > 1e6 THEN printf('%.2f M{0}', x / 1e6) WHEN x > 1e3 THEN printf('%.2f K{0}', x / 1e3) ELSE printf('{1} {0}', x) END"
on_packets("format_rate", f"WITH {K_SQL}, x AS (SELECT time, (seq * (1 + \"window\" * \"window\") * 64)::DOUBLE AS x, seq * 128 AS s FROM k) SELECT time, {_UNIT.format('B/s', '%.2f')} AS rate, {_UNIT.format('B', '%.0f').replace('x ', 's::DOUBLE ').replace(', x)', ', s::DOUBLE)')} AS total FROM x", lambda k: k.select("time", format_rate(F.col("seq") * (1 + F.col("window") * F.col("window")) * 64, "B/s").alias("rate"), format_sum(F.col("seq") * 128, "B").alias("total")))
on_packets("format_elapsed", f"WITH {K_SQL} SELECT time, (seq * 37 // 1000) || 's ' || (seq * 37 % 1000) || 'ms' AS elapsed FROM k", lambda k: k.select("time", format_elapsed(F.col("seq") * 37).alias("elapsed")))

# Charts
on_points("plot_numeric", f"WITH {P_SQL} SELECT series_id, ts, v AS y FROM p", lambda p: plot.plot_numeric(p).select("series_id", "ts", "y"))
on_packets("plot_bool", f"WITH {K_SQL} SELECT series_id, ts, CASE WHEN value_bool THEN 13 ELSE 5 END::DOUBLE AS y FROM q WHERE type = 2", lambda k: plot.plot_bool(points.to_points(k, "packet").filter("type = 2"), 5.0, 20.0).select("series_id", "ts", "y"))
on_points("fetch_series", f"WITH {P_SQL}, c AS (SELECT * FROM p WHERE {_FLOW} AND {_IN}), b AS (SELECT series_id, min(ts) AS xmin, max(ts) AS xmax, min(v) AS ymin, max(v) AS ymax FROM c GROUP BY series_id), w AS (SELECT min(ts) AS flow_xmin, max(ts) AS flow_xmax FROM p WHERE {_FLOW}) SELECT series_id, name, ts, v AS value, xmin, xmax, ymin, ymax, flow_xmin, flow_xmax FROM c JOIN b USING (series_id), w", lambda p: plot.fetch_series(p, user_flow(7), _IDS).select("series_id", "name", "ts", value_num().alias("value"), "xmin", "xmax", "ymin", "ymax", "flow_xmin", "flow_xmax"))
on_points("chart_combined", f"WITH {P_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM p) SELECT series_id, name, ts, v AS y FROM i WHERE i % 3 = 0 AND {_BOX}", lambda p: plot.prepare_combined(p, WINDOW, 3, time_bucket=DAY).select("series_id", "name", "ts", "y"))
on_points("chart_split", f"WITH {P_SQL}, b AS (SELECT * FROM p WHERE {_BOX}) SELECT series_id, name, ts, v AS y, min(v) OVER w AS y_lower, max(v) OVER w AS y_upper FROM b WINDOW w AS (PARTITION BY series_id)", lambda p: plot.prepare_split(p, WINDOW).select("series_id", "name", "ts", "y", "y_lower", "y_upper"))
_PAIR = f"((flow_id = {user_flow(7)} AND {_IN}) OR (flow_id = {user_flow(8)} AND series_id IN ({', '.join(map(str, _OTHER_IDS))})))"
on_points("compare_flows", f"WITH {P_SQL} SELECT flow_id, series_id, ts, v AS y, min(ts) OVER () AS x_lower, max(ts) OVER () AS x_upper, min(v) OVER () AS y_lower, max(v) OVER () AS y_upper FROM p WHERE {_PAIR}", lambda p: plot.compare_flows(p, (user_flow(7), _IDS), (user_flow(8), _OTHER_IDS)).select("flow_id", "series_id", "ts", "y", "x_lower", "x_upper", "y_lower", "y_upper"))

# Metrics
_SID = "('0x' || substr(md5(concat_ws('|', flow_id, '{0}')), 1, 15))::BIGINT AS series_id"
on_points("metric_upper_window_pos", f"WITH {P_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM p), z AS (SELECT a.flow_id, a.ts, a.v + b.v AS value FROM i a JOIN i b ON a.flow_id = b.flow_id AND a.i = b.i WHERE a.name = 'view' AND b.name = 'click') SELECT flow_id, {_SID.format('UPPER_WND')}, ts, value FROM z", lambda p: metrics.get("UPPER_WND", una="view", wnd="click", align="position", time_bucket=DAY).run(p).select("flow_id", "series_id", "ts", value_num().alias("value")))
_UPPER = f"WITH {L_SQL}, z AS (SELECT flow_id, ts, sum(value_int)::BIGINT AS value FROM o WHERE name IN ('SND_UNA', 'SND_WND') GROUP BY flow_id, ts HAVING count(*) = 2)"
_upper = lambda p: metrics.get("UPPER_WND").run(points.split_duplicates(p, _ORDER)[0])
on_probe("metric_upper_window_ts", f"{_UPPER} SELECT flow_id, {_SID.format('UPPER_WND')}, ts, value FROM z", lambda p: _upper(p).select("flow_id", "series_id", "ts", F.col("value_int").alias("value")))
on_probe("metric_upper_window_bounds", f"{_UPPER} SELECT flow_id, {_SID.format('UPPER_WND')}, 'UPPER_WND' AS name, min(ts) AS xmin, max(ts) AS xmax, min(value)::DOUBLE AS ymin, max(value)::DOUBLE AS ymax FROM z GROUP BY flow_id", lambda p: bounds.series_bounds(_upper(p)))
on_probe("metric_requirements", f"WITH {L_SQL} SELECT flow_id FROM l WHERE name IN ('SND_UNA', 'SND_WND') GROUP BY flow_id HAVING count(DISTINCT name) = 2", lambda p: metrics.get("UPPER_WND").complete_flows(p))
on_probe("metric_preview", f"{_UPPER} SELECT flow_id, name, ts, coalesce(value_int, value_float)::DOUBLE AS value FROM o UNION ALL SELECT flow_id, 'UPPER_WND', ts, value::DOUBLE FROM z", lambda p: metrics.get("UPPER_WND").preview(points.split_duplicates(p, _ORDER)[0]).select("flow_id", "name", "ts", value_num().alias("value")))
_packet_points = lambda k: points.to_points(k, "packet")
# Packets that acknowledge the same numbers several times: blocks of a thousand share a sequence number, and few acknowledgements and windows are left.
_ack_packets = lambda k: k.withColumns({"seq": F.floor(F.col("seq") / 1000), "ack_num": F.floor(F.col("ack_num") / 4000) + 1, "window": F.col("window") % 2 + 1})
_ACKS = f"WITH {K_SQL}, z AS (SELECT flow_id, time, seq // 1000 AS s, ack_num // 4000 + 1 AS a, \"window\" % 2 + 1 AS w, syn OR fin AS f FROM k), y AS (SELECT *, lag(s) OVER o AS s0, lag(a) OVER o AS a0, lag(w) OVER o AS w0 FROM z WINDOW o AS (PARTITION BY flow_id ORDER BY time))"
on_packets("dup_acks", f"{_ACKS} SELECT flow_id, {_SID.format('DUP_ACK')}, time::DOUBLE AS ts, a AS value FROM y WHERE a = a0 AND s = s0 AND w = w0 AND NOT f", lambda k: metrics.get("DUP_ACK", time_bucket=1000 * DAY).run(_packet_points(_ack_packets(k))).select("flow_id", "series_id", "ts", F.col("value_int").alias("value")))
# Sequence numbers that wrap many times, with steps back.
_wrapping = lambda k: k.withColumn("seq", (F.col("seq") * 4000003 + 4294000000) % (1 << 32))
_WRAPS = f"WITH {K_SQL}, z AS (SELECT flow_id, time, (seq * 4000003 + 4294000000) % 4294967296 AS v FROM k), z1 AS (SELECT *, (v - lag(v) OVER o + 4294967296) % 4294967296 AS d FROM z WHERE v <> 0 WINDOW o AS (PARTITION BY flow_id ORDER BY time)), z2 AS (SELECT *, sum(coalesce(CASE WHEN d >= 2147483648 THEN d - 4294967296 ELSE d END, 0)) OVER (PARTITION BY flow_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS u FROM z1), z3 AS (SELECT *, max(u) OVER (PARTITION BY flow_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM z2)"
on_packets("retransmissions", f"{_WRAPS} SELECT flow_id, {_SID.format('RETRANS')}, time::DOUBLE AS ts, v AS value FROM z3 WHERE u <= top", lambda k: metrics.get("RETRANS", time_bucket=1000 * DAY).run(_packet_points(_wrapping(k))).select("flow_id", "series_id", "ts", F.col("value_int").alias("value")))
on_points("metric_random", f"WITH {P_SQL} SELECT flow_id, {_SID.format('tst_rndm')}, ts, true AS in_range FROM p WHERE name = 'view'", lambda p: metrics.get("tst_rndm", source="view").run(p).select("flow_id", "series_id", "ts", F.col("value_float").between(4e7, 5.2e8).alias("in_range")))


class DetrendedViews(metrics.PandasMetric):
    """Values less their flow's mean: a stand-in for mathematics in pandas that need something of a whole flow."""

    name, required, time_bucket, looks_up_flows = "DETRENDED", ("view",), 7 * DAY, False

    def totals(self):
        return {"mean": F.avg("value_float")}

    def compute_flow(self, frame):
        return frame.assign(value=frame["value_float"] - frame["mean"])[["ts", "value"]]


on_points("metric_pandas", f"WITH {P_SQL} SELECT flow_id, ts, round(v - avg(v) OVER (PARTITION BY flow_id), 6) AS value FROM p WHERE name = 'view'", lambda p: DetrendedViews().run(p).select("flow_id", "ts", _r("value_float").alias("value")))

# Series cut into ranges of measured sizes, and state handed from range to range
_EVEN = windows.even(5)
on_points("rate_even_splits", f"WITH {P_SQL} SELECT series_id, ts, round(1e6 * (v - lag(v) OVER o) / (ts - lag(ts) OVER o), 6) + 0 AS rate FROM p WINDOW o AS (PARTITION BY series_id ORDER BY ts)", lambda p: windows.rate(p, _EVEN).select("series_id", "ts", (F.round(F.col("rate") * 1e6, 6) + 0.0).alias("rate")))
on_points("running_max_even_splits", f"WITH {P_SQL} SELECT series_id, ts, max(v) OVER (PARTITION BY series_id ORDER BY ts) AS running_max FROM p", lambda p: windows.running_max(p, _EVEN).select("series_id", "ts", "running_max"))
on_points("decimate_even_splits", f"WITH {P_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM p) SELECT series_id, ts, v FROM i WHERE i % 3 = 0", lambda p: windows.every_nth(p, 3, _EVEN).select("series_id", "ts", F.col("value_float").alias("v")))
_SMOOTH = "list_reduce(list(v) OVER (PARTITION BY flow_id ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda s, x: s * 0.875::DOUBLE + x * 0.125::DOUBLE)"
on_points("metric_smoothed", f"WITH {P_SQL} SELECT flow_id, ts, floor({_SMOOTH} * 1000 + 0.3)::BIGINT AS thousandths FROM p WHERE name = 'view'", lambda p: metrics.Smoothed(source="view", time_bucket=_EVEN).run(p).select("flow_id", "ts", F.floor(F.col("value_float") * 1000 + 0.3).alias("thousandths")))

# Batch twins of live views
_timed = lambda e: e.withColumn("event_time", F.timestamp_micros("us")).withColumn("kind", F.col("event_type"))
on_events("tumbling_rates", f"WITH {E_SQL} SELECT us // 3600000000 * 3600000000 AS start_us, event_type AS kind, count(*) AS n FROM e GROUP BY ALL", lambda e: live.live_rates(_timed(e), "1 hour").select(F.unix_micros("start").alias("start_us"), "kind", "n"))
on_events("session_flows", f"WITH {E_SQL}, g AS (SELECT flow_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY flow_id ORDER BY us) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM e), s AS (SELECT *, sum(fresh) OVER (PARTITION BY flow_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT flow_id, min(us) AS start_us, max(us) + 14400000000 AS end_us, count(*) AS n FROM s GROUP BY flow_id, s", lambda e: live.sessions(_timed(e), "4 hours").select("flow_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n"))
_SOURCE = {"view": "ingress", "click": "egress", "signup": "recv"}
on_events("run_metrics", "SELECT count(*) FILTER (WHERE event_type <> 'error') AS handled, count(*) FILTER (WHERE event_type = 'error') AS dropped, count(*) FILTER (WHERE event_type = 'view') AS ingress, count(*) FILTER (WHERE event_type = 'click') AS egress, count(*) FILTER (WHERE event_type = 'signup') AS ingress_calls, count(*) FILTER (WHERE event_type = 'purchase') AS egress_calls FROM events", lambda e: live.run_metrics(e.select((F.col("event_type") == "error").alias("dropped"), F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _SOURCE.items()], F.lit("send")).alias("source"))))


@key("write_speed", f"WITH {E_SQL}, c AS (SELECT flow_id AS series_id, us // 3600000000 * 3600 AS h, count(*) * 74 AS n FROM e GROUP BY ALL), s AS (SELECT series_id, h::DOUBLE AS ts, sum(n) OVER (PARTITION BY series_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS bytes FROM c) SELECT series_id, ts, round((bytes - lag(bytes) OVER w) / (ts - lag(ts) OVER w), 9) AS bytes_per_second FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts)")
def write_speed(spark, sf_dir):
    """Each flow's trace, hour by hour: packets of 74 bytes."""
    from pyspark.sql import Window

    e = event_flows(spark, sf_dir).withColumn("ts", (F.floor(F.col("us") / 3_600_000_000) * 3600).cast("double"))
    hourly = e.groupBy(F.col("flow_id").alias("series_id"), "ts").agg((F.count(F.lit(1)) * 74).alias("n"))
    total = F.sum("n").over(Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return live.write_speed(hourly.select("series_id", "ts", total.alias("bytes"))).select("series_id", "ts", F.round("bytes_per_second", 9).alias("bytes_per_second"))
