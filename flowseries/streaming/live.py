"""Live views and continuous ingest. Functions work on streams and on tables alike where nothing else is said."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowseries.functions.addresses import TUPLE, with_flow
from flowseries.operators.points import to_points
from flowseries.operators.windows import rate
from flowseries.sources.store import FlowStore, held


def event_time(records: DataFrame, boot_epoch_ns: int = 0) -> DataFrame:
    """Adds ``event_time`` from ``time``, nanoseconds since boot, and the caller's time of boot."""
    return records.withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("time") + F.lit(boot_epoch_ns), F.lit(1000))))


def _watermarked(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("event_time", delay) if df.isStreaming else df


def live_rates(records: DataFrame, interval: str = "100 milliseconds", by: str = "kind", delay: str = "10 seconds") -> DataFrame:
    """Records of each ``by`` in each interval."""
    counted = _watermarked(records, delay).groupBy(F.window("event_time", interval), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")


def live_flows(records: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Flows as they appear; a flow that was silent for longer than ``delay`` appears again."""
    rows = records.select("event_time", *TUPLE)
    return _watermarked(rows, delay).dropDuplicatesWithinWatermark(list(TUPLE)) if rows.isStreaming else rows.groupBy(*TUPLE).agg(F.min("event_time").alias("event_time"))


_FLOW_EVENT = "src string, dst string, sport int, dport int, l4proto int, event string, first_us long, last_us long, n long"


def _spans(frame: pd.DataFrame, idle_us: int) -> pd.DataFrame:
    """Spans (first_us, last_us, n) joined wherever no more than ``idle_us`` lies between them; by flow, in order."""
    keys = [c for c in TUPLE if c in frame.columns]
    frame = frame.sort_values([*keys, "first_us", "last_us"], ignore_index=True)
    reach = frame.groupby(keys, dropna=False)["last_us"].cummax() if keys else frame["last_us"].cummax()
    before = reach.shift(1)
    new = frame["first_us"] - before > idle_us
    for k in keys:
        new |= (frame[k] != frame[k].shift(1)) & ~(frame[k].isna() & frame[k].shift(1).isna())
    span = new.cumsum().rename("span")
    firsts = {k: (k, "first") for k in keys}
    return frame.groupby(span).agg(**firsts, first_us=("first_us", "min"), last_us=("last_us", "max"), n=("n", "sum")).reset_index(drop=True)


class FlowState(StatefulProcessor):
    """For each flow its present span without a pause of ``idle_us``. A new span gives an ``open`` row; when a later
    record or the watermark shows that it is over, an ``idle`` row with its ends and its number of records."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "first_us long, last_us long, n long")

    def _timer(self, last_us: int) -> int:
        # Whole milliseconds, rounded up, so that a span isn't over before its time.
        return -(-(last_us + self.idle_us) // 1000)

    def _rows(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=[*TUPLE, "event", "first_us", "last_us", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frames = [f[["first_us", "last_us", "n"]] for f in rows]
        had = tuple(self.span.get()) if self.span.exists() else None
        if had:
            frames.append(pd.DataFrame([had], columns=["first_us", "last_us", "n"]))
            self.handle.deleteTimer(self._timer(had[1]))
        spans = [tuple(int(x) for x in r) for r in _spans(pd.concat(frames), self.idle_us)[["first_us", "last_us", "n"]].itertuples(index=False)]
        # The span that was known already, perhaps longer now, was opened before.
        opened = [("open", s[0], s[0], 0) for s in spans if not (had and s[0] <= had[0] <= s[1])]
        closed = [("idle", *s) for s in spans[:-1]]
        self.span.update(spans[-1])
        self.handle.registerTimer(self._timer(spans[-1][1]))
        yield from self._rows(key, sorted(opened + closed, key=lambda r: (r[1], r[0] == "idle")))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.span.exists():
            span = tuple(int(x) for x in self.span.get())
            self.span.clear()
            yield from self._rows(key, [("idle", *span)])

    def close(self) -> None:
        pass


def flow_table(records: DataFrame, idle_seconds: float = 60.0, delay: str = "10 seconds") -> DataFrame:
    """A stream of flows as they come and go: ``open`` rows, and ``idle`` rows with first and last time and the number of
    records once a flow was silent for longer than ``idle_seconds``. State goes with the flow, so it is bounded by the
    flows that aren't idle. Records later than ``delay`` are dropped once their flow's time is past. Tasks first join a
    flow's records into spans, so a hot flow reaches its state in few rows. The session needs the state store that keeps
    timers (``state_store``)."""
    idle_us = int(idle_seconds * 1_000_000)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                yield _spans(frame.assign(last_us=frame["first_us"], n=1), idle_us)

    times = records.select(*TUPLE, F.unix_micros("event_time").alias("first_us")).filter("first_us IS NOT NULL")
    spans = times.mapInPandas(joined, "src string, dst string, sport int, dport int, l4proto int, first_us long, last_us long, n long")
    spans = spans.withColumn("event_time", F.timestamp_micros("last_us")).withWatermark("event_time", delay)
    found = spans.groupBy(*TUPLE).transformWithStateInPandas(FlowState(idle_us), _FLOW_EVENT, "Append", "EventTime")
    return found.select(*TUPLE, "event", F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"), "n")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that ``flow_table`` needs, for streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def sessions(records: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Spans of each flow without a pause of ``gap``."""
    found = _watermarked(records, delay).groupBy(F.session_window("event_time", gap).alias("s"), "flow_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("flow_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_metrics(events: DataFrame) -> DataFrame:
    """One row of counters of events (source, dropped): handled, dropped, packets and calls by direction."""
    n = lambda c: F.count(F.when(c, 1))
    of = lambda s: n((F.col("source") == s) & ~F.col("dropped"))
    return events.agg(
        n(~F.col("dropped")).alias("handled"), n(F.col("dropped")).alias("dropped"), of("ingress").alias("ingress"), of("egress").alias("egress"),
        of("recv").alias("ingress_calls"), of("send").alias("egress_calls"),
    )


def event_rate(counters: DataFrame) -> DataFrame:
    """Handled and dropped events a second between samples (ts in seconds, handled, dropped), by ``series_id``."""
    w = Window.partitionBy("series_id").orderBy("ts")
    total = F.col("handled") + F.col("dropped")
    return counters.withColumn("event_rate", (total - F.lag(total).over(w)) / F.nullif(F.col("ts") - F.lag("ts").over(w), F.lit(0.0)))


def write_speed(samples: DataFrame) -> DataFrame:
    """Bytes a second between samples (series_id, ts in seconds, bytes) of the trace files' total size."""
    points = samples.withColumns({"value_int": F.col("bytes").cast("long"), "value_float": F.lit(None).cast("double")})
    return rate(points, into="bytes_per_second").drop("value_int", "value_float")


def write_run_metrics(events: DataFrame, path: str) -> None:
    """The counters as one JSON object in one file."""
    run_metrics(events).coalesce(1).write.mode("overwrite").json(path)


def live_counters(records: DataFrame, name: str = "records") -> DataFrame:
    """``records`` observed: counts of handled and corrupt rows arrive with each batch's progress."""
    return records.observe(name, F.count(F.when(~F.col("_corrupt"), 1)).alias("handled"), F.count(F.when(F.col("_corrupt"), 1)).alias("dropped"))


def ingest_batch(store: FlowStore, kind: str) -> Callable[[DataFrame, int], None]:
    """What a batch of records does to a store: flows, series and points, the points as a part of the batch's number.
    What isn't stored is kept in the store's quarantine: corrupt records, points that repeat a key of the batch, points
    of another type than their series. The batch's account says where every record and point went: records are corrupt
    or give points, points are stored, known already, or in quarantine. Coming twice a batch changes nothing. It reads
    the flows and series of its own buckets, and points of its own days and times."""

    def run(batch: DataFrame, number: int) -> None:
        part = f"{kind}-{number}"
        with held(batch):
            records, corrupt = batch.agg(F.count(F.lit(1)), F.count(F.when(F.col("_corrupt"), 1))).first()
            if not records:
                return
            flows = with_flow(batch.filter("NOT _corrupt"), kind)
            store.add_flows(flows)
            fates = store.take_points(to_points(flows, kind), ["ts_ns", "type", "value_int", "value_bool"], part)
            bad = batch.filter("_corrupt").select(F.lit("corrupt").alias("reason"), F.to_json(F.struct(*batch.columns)).alias("record"))
            store.refuse(bad if corrupt else None, f"{kind}.records-{number}")
            refused = fates.get("duplicate", 0) + fates.get("type", 0)
            store.account(kind, part, records=records, corrupt=corrupt, points=sum(fates.values()), stored=fates.get("new", 0), known=fates.get("known", 0), quarantined=refused)

    return run


def ingest_stream(records: DataFrame, store: FlowStore, kind: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Continuous ingest into a store. ``available_now`` drains what is there and stops."""
    writer = records.writeStream.foreachBatch(ingest_batch(store, kind)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
