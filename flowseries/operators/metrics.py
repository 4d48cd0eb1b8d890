"""Derived series: the contract, a registry, and the built-in metrics. A metric works on all flows at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from flowseries.functions.addresses import series_id
from flowseries.operators.points import POINT_COLUMNS
from flowseries.operators.windows import TimeBucket, behind, bucket_points, even, pair_series, with_previous
from flowseries.schema import FLOAT, INT


class Metric:
    """Name, description, required series, and ``compute``: points of complete flows to points of new series."""

    name: str = ""
    description: str = ""
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    #: Off where ``compute`` gives nothing for flows that lack a series, so that they needn't be looked up first.
    looks_up_flows: bool = True

    def compute(self, points: DataFrame) -> DataFrame:
        raise NotImplementedError

    def complete_flows(self, points: DataFrame) -> DataFrame:
        """Flows that have all required series."""
        found = points.filter(F.col("name").isin(*self.required)).groupBy("flow_id").agg(F.count_distinct("name").alias("n"))
        return found.filter(F.col("n") == len(set(self.required))).select("flow_id")

    def run(self, points: DataFrame) -> DataFrame:
        """The new series of every complete flow."""
        needed = points.filter(F.col("name").isin(*self.required, *self.optional))
        return self.compute(needed if not self.looks_up_flows else needed.join(self.complete_flows(points), "flow_id", "left_semi"))

    def preview(self, points: DataFrame) -> DataFrame:
        """``points`` with the new series."""
        return points.select(*POINT_COLUMNS).unionByName(self.run(points))

    def save(self, store, points: DataFrame) -> None:
        """The new series into a store; saving again adds nothing."""
        store.save_series(self.run(points))


_REGISTRY: dict[str, Callable[..., Metric]] = {}


def register(factory: Callable[..., Metric]) -> Callable[..., Metric]:
    _REGISTRY[factory.name] = factory  # type: ignore[attr-defined]
    return factory


def get(name: str, **options) -> Metric:
    return _REGISTRY[name](**options)


def names() -> list[str]:
    return sorted(_REGISTRY)


def as_series(rows: DataFrame, name: str, tag: int, value) -> DataFrame:
    """Rows with flow_id, ts and ts_ns as points of series ``name``."""
    kinds = dict(zip(("value_int", "value_float", "value_bool", "value_text"), ("long", "double", "boolean", "string"), strict=True))
    cells = [(value if i == tag else F.lit(None)).cast(k).alias(c) for i, (c, k) in enumerate(kinds.items())]
    return rows.select("flow_id", series_id(F.col("flow_id"), F.lit(name)).alias("series_id"), F.lit(name).alias("name"), F.lit(tag).alias("type"), "ts", "ts_ns", *cells)


def _numbers(rows: DataFrame, name: str) -> DataFrame:
    """Rows with flow_id, ts, ts_ns, type (Int or Float) and the value as ``i`` or ``f`` as points of series ``name``."""
    return rows.select("flow_id", series_id(F.col("flow_id"), F.lit(name)).alias("series_id"), F.lit(name).alias("name"), "type", "ts", "ts_ns", F.col("i").alias("value_int"), F.col("f").alias("value_float"), F.lit(None).cast("boolean").alias("value_bool"), F.lit(None).cast("string").alias("value_text"))


@register
class UpperWindow(Metric):
    """Upper edge of the send window. Types of both series must match and be numbers; pairs that don't are left out
    unless ``strict``, which fails on them."""

    name, description = "UPPER_WND", "SND_UNA + SND_WND"
    looks_up_flows = False

    def __init__(self, una: str = "SND_UNA", wnd: str = "SND_WND", align: str = "timestamp", strict: bool = False, time_bucket: TimeBucket = None):
        self.required, self.align, self.strict, self.time_bucket = (una, wnd), align, strict, time_bucket

    def compute(self, points: DataFrame) -> DataFrame:
        pairs = pair_series(points, *self.required, self.align, self.time_bucket)
        fits = (F.col("type_a") == F.col("type_b")) & F.col("type_a").isin(INT, FLOAT)
        if self.strict:
            fits = F.when(fits, True).otherwise(F.raise_error(F.lit("series of other types than both Int or both Float")).cast("boolean"))
        whole = F.col("type_a") == INT
        pairs = pairs.filter(fits).select("flow_id", "ts", "ts_ns", F.col("type_a").alias("type"), F.when(whole, F.col("value_int_a") + F.col("value_int_b")).alias("i"), F.when(~whole, F.col("value_float_a") + F.col("value_float_b")).alias("f"))
        return _numbers(pairs, self.name)


@register
class RandomSeries(Metric):
    """Uniform values in [4e7, 5.2e8) at each time of a series; an example and a debugging aid."""

    name, description = "tst_rndm", "random values"
    looks_up_flows = False

    def __init__(self, source: str = "ACK_NUM", seed: int = 1):
        self.required, self.seed = (source,), seed

    def compute(self, points: DataFrame) -> DataFrame:
        return as_series(points, self.name, FLOAT, F.rand(self.seed) * (5.2e8 - 4e7) + 4e7)


@register
class DuplicateAcks(Metric):
    """Acknowledgements as in the flow's packet before, of packets without payload progress: sequence number and
    window are the same too, and neither opens nor closes the connection. A series without a point at a packet's time
    (zeros give none) counts as zero; packets of one flow and time are one."""

    name, description = "DUP_ACK", "ACK_NUM as in the packet before, without payload progress"
    looks_up_flows = False

    def __init__(self, ack: str = "ACK_NUM", seq: str = "SEQ_NUM", window: str = "WINDOW", flags: tuple[str, ...] = ("FLAG_SYN", "FLAG_FIN"), time_bucket: TimeBucket = None):
        self.required, self.optional, self.time_bucket = (ack,), (seq, window, *flags), time_bucket

    def compute(self, points: DataFrame) -> DataFrame:
        (ack,), (seq, window, *flags) = self.required, self.optional
        of = lambda n: F.max(F.when(F.col("name") == n, F.col("value_int")))
        flag = F.max(F.when(F.col("name").isin(flags), F.col("value_bool")))
        packets = points.groupBy("flow_id", "ts").agg(F.max("ts_ns").alias("ts_ns"), of(ack).alias("_ack"), F.coalesce(of(seq), F.lit(0)).alias("_seq"), F.coalesce(of(window), F.lit(0)).alias("_window"), F.coalesce(flag, F.lit(False)).alias("_flag"))
        same = ("_ack", "_seq", "_window")
        again = with_previous(packets, {c: F.col(c) for c in same}, self.time_bucket, "flow_id").filter(~F.col("_flag"))
        for c in same:
            again = again.filter(F.col(c) == F.col(f"_previous.{c}"))
        return as_series(again, self.name, INT, F.col("_ack"))


@register
class Retransmissions(Metric):
    """Sequence numbers at or below one that the flow has sent before; numbers wrap at 32 bits, so a number counts
    as behind when it is less than half the circle back."""

    name, description = "RETRANS", "SEQ_NUM behind the highest before"
    looks_up_flows = False

    def __init__(self, seq: str = "SEQ_NUM", time_bucket: TimeBucket = None):
        self.required, self.time_bucket = (seq,), time_bucket

    def compute(self, points: DataFrame) -> DataFrame:
        rows = points.select("flow_id", "ts", "ts_ns", "value_int")
        return as_series(behind(rows, F.col("value_int"), 1 << 32, self.time_bucket, "flow_id"), self.name, INT, F.col("value_int"))


#: Groups of a table that come to Python together: one call for each of so many hashes, not for each flow.
_CALLS = 4096


def _dealt(rows: DataFrame, keys: list[str]) -> GroupedData:
    """Rows of whole ``keys``, many keys in one group; those with a null apart, so that ids beside them stay whole numbers."""
    return rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(_CALLS)).alias("_call"), *[F.col(k).isNull().alias(f"_no_{k}") for k in keys])


def _frames(table: pa.Table, keys: list[str], order: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Each key and its rows by ``order``, with the types that they have alone: whole numbers where none is null."""
    if not table.num_rows:
        return
    table = table.sort_by([(c, "ascending") for c in (*keys, *order)])
    frame, mixed = table.to_pandas(integer_object_nulls=True), []
    for field in table.schema:
        nulls = table[field.name].null_count
        if pa.types.is_integer(field.type) and nulls == len(frame):
            frame[field.name] = np.nan
        elif pa.types.is_integer(field.type) and nulls:
            mixed.append(field.name)
    changed = np.zeros(len(frame) - 1, dtype=bool)
    for k in keys:
        if not table[k].null_count:
            changed |= frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1]
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(frame)]
    for start, end in zip(cuts, cuts[1:]):
        own = frame.iloc[start:end]
        if mixed:
            own = own.assign(**{c: own[c].astype("float64" if own[c].isna().any() else "int64") for c in mixed})
        yield tuple(table[k][start].as_py() for k in keys), own


_VALUES = pa.schema([("flow_id", pa.int64()), ("ts", pa.float64()), ("value", pa.float64())])


def _values(found: list[tuple[int | None, pd.DataFrame]]) -> pa.Table:
    """``ts`` and ``value`` rows of some flows."""
    column = lambda c: np.concatenate([out[c].to_numpy(dtype=float) for _, out in found]) if found else []
    ids = [i for i, out in found for _ in range(len(out))]
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(column("ts"), pa.float64(), from_pandas=True), pa.array(column("value"), pa.float64(), from_pandas=True)], schema=_VALUES)


class PandasMetric(Metric):
    """For mathematics that isn't relational: ``compute_flow`` gets one flow's points of one ``time_bucket`` as pandas
    and returns ``ts`` and ``value`` rows. What it needs to know of the whole flow are ``totals``, aggregates that
    Spark works out first and that stand beside each point; so a long flow needn't fit a task. Without ``time_bucket``
    a flow comes whole, for mathematics that can't be cut."""

    time_bucket: TimeBucket = None

    def totals(self) -> dict[str, Column]:
        return {}

    def compute_flow(self, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def compute(self, points: DataFrame) -> DataFrame:
        compute_flow, totals, bucket = self.compute_flow, self.totals(), self.time_bucket
        keys = ["flow_id"] if bucket is None else ["flow_id", "_b"]

        def run(table: pa.Table) -> pa.Table:
            return _values([(key[0], compute_flow(own.drop(columns=keys[1:]))) for key, own in _frames(table, keys, ["name", "ts"])])

        if totals:
            points = points.join(points.groupBy("flow_id").agg(*[c.alias(n) for n, c in totals.items()]), "flow_id")
        keyed = points if bucket is None else points.withColumn("_b", F.floor(F.col("ts") / bucket))
        rows = _dealt(keyed, keys).applyInArrow(run, "flow_id long, ts double, value double")
        return as_series(rows.withColumn("ts_ns", F.lit(None).cast("long")), self.name, FLOAT, F.col("value"))


class CarriedMetric(Metric):
    """For mathematics that runs on through a flow: buckets of its points (``time_bucket``) are worked on in parallel,
    each knowing what all before it come to. ``summarise`` makes a state of one bucket's points, ``combine`` joins two
    neighbours' states, and ``apply`` gets a bucket's points with the state of all before it (None at the first) and
    returns ``ts`` and ``value`` rows. States are rows of ``state``, a DDL; a flow has one for each bucket, which are
    handed on by one task a flow. The same result comes out however points are cut, if ``combine`` is associative."""

    state: str = ""
    time_bucket: TimeBucket = even()

    def summarise(self, frame: pd.DataFrame) -> tuple:
        raise NotImplementedError

    def combine(self, before: tuple, after: tuple) -> tuple:
        raise NotImplementedError

    def apply(self, frame: pd.DataFrame, before: tuple | None) -> pd.DataFrame:
        raise NotImplementedError

    def compute(self, points: DataFrame) -> DataFrame:
        own, keys = self, ["flow_id", "_b"]
        keyed = bucket_points(points, self.time_bucket, "flow_id")
        of_bucket = f"flow_id long, _b long, {self.state}"
        carried_on = f"flow_id long, _b long, _there boolean, {self.state}"
        schema = lambda ddl: to_arrow_schema(points.sparkSession.createDataFrame([], ddl).schema)
        summed_schema, handed_schema = schema(of_bucket), schema(carried_on)

        def as_table(rows: list[tuple], form: pa.Schema) -> pa.Table:
            return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type, from_pandas=True) for i, f in enumerate(form)], schema=form)

        def summed(table: pa.Table) -> pa.Table:
            return as_table([(*key, *own.summarise(frame)) for key, frame in _frames(table, keys, ["ts", "name"])], summed_schema)

        def handed(table: pa.Table) -> pa.Table:
            rows, flow, before = [], (), None
            for r in zip(*[c.to_pylist() for c in table.sort_by([("flow_id", "ascending"), ("_b", "ascending")]).columns], strict=True):
                if flow != r[:1]:
                    flow, before = r[:1], None
                rows.append((r[0], r[1], before is not None, *(before or r[2:])))
                before = r[2:] if before is None else own.combine(before, r[2:])
            return as_table(rows, handed_schema)

        def applied(table: pa.Table, carried: pa.Table) -> pa.Table:
            before = {r[:2]: r[3:] if r[2] else None for r in zip(*[c.to_pylist() for c in carried.columns], strict=True)}
            return _values([(key[0], own.apply(frame, before[key])) for key, frame in _frames(table, keys, ["ts", "name"])])

        states = _dealt(keyed, keys).applyInArrow(summed, of_bucket)
        carried = _dealt(states, keys[:1]).applyInArrow(handed, carried_on)
        rows = _dealt(keyed, keys).cogroup(_dealt(carried, keys)).applyInArrow(applied, "flow_id long, ts double, value double")
        return as_series(rows.withColumn("ts_ns", F.lit(None).cast("long")), self.name, FLOAT, F.col("value"))


class Smoothed(CarriedMetric):
    """Exponentially smoothed values, as round-trip times are: the first value, then seven eighths of what was and an
    eighth of what is. A bucket of n values takes what was by the factor (7/8)^n and adds a number of its own."""

    name, description = "SMOOTHED", "values smoothed by an eighth"
    state = "first double, factor double, own double"
    looks_up_flows = False

    def __init__(self, source: str = "SRTT", weight: float = 0.125, time_bucket: TimeBucket = even()):
        self.required, self.weight, self.time_bucket = (source,), weight, time_bucket

    @staticmethod
    def _values(frame: pd.DataFrame) -> list[float]:
        return frame["value_float"].fillna(frame["value_int"].astype(float)).tolist()

    def summarise(self, frame: pd.DataFrame) -> tuple:
        """What the bucket makes of nothing before it, and what it does to what was before."""
        values, own, alone = self._values(frame), 0.0, None
        for v in values:
            own += self.weight * (v - own)
            alone = v if alone is None else alone + self.weight * (v - alone)
        return alone, (1 - self.weight) ** len(values), own

    def combine(self, before: tuple, after: tuple) -> tuple:
        return before[0] * after[1] + after[2], before[1] * after[1], before[2] * after[1] + after[2]

    def apply(self, frame: pd.DataFrame, before: tuple | None) -> pd.DataFrame:
        at, out = None if before is None else before[0], []
        for v in self._values(frame):
            at = v if at is None else at + self.weight * (v - at)
            out.append(at)
        return pd.DataFrame({"ts": frame["ts"], "value": out})


def preview_all(points: DataFrame, metrics: list[Metric]) -> DataFrame:
    return reduce(DataFrame.unionByName, [m.run(points) for m in metrics], points.select(*POINT_COLUMNS))
