"""Operators over a series in the order of time.

Windows are partitioned by series. Where one series may hold much of the table, ``time_bucket`` (a width in units of
``ts``) cuts series into buckets: small totals for each bucket are carried over from earlier buckets, and the windows
run inside buckets. Results are the same. A width in time doesn't part a burst: ``even(rows)`` in its place measures the
series and cuts each that has more rows into ranges of about as many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowseries.functions.values import value_num

SERIES = "series_id"


@dataclass(frozen=True)
class even:
    """Buckets of about ``rows`` rows in place of a width: more where the table has so many that its tasks' share is."""

    rows: int = 1 << 20


TimeBucket = float | even | None


def bucket_points(points: DataFrame, time_bucket: float | even, by: str = SERIES) -> DataFrame:
    """Adds ``_b``, the number of the time bucket, which rises with ``ts`` in each ``by``."""
    if not isinstance(time_bucket, even):
        return points.withColumn("_b", F.floor(F.col("ts") / time_bucket))
    counts = points.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    most, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    # So many rows that the bounds of all series together are at most four for each task.
    rows = max(time_bucket.rows, (total or 0) // (4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    k = min(4096, -(-(most or 0) // rows))
    if k < 2:
        return points.withColumn("_b", F.lit(0).cast("long"))
    hot = counts.filter(F.col("_n") > rows).select(F.col(by).alias("_hot"), "_n")
    cuts = F.percentile_approx("ts", [i / k for i in range(1, k)], 20 * k)
    # Of the cuts for the largest series others take every so many.
    own = F.filter("_cuts", lambda x, i: (i + 1) % F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_n"))) == 0)
    of_hot = points.join(F.broadcast(hot), F.col(by).eqNullSafe(F.col("_hot"))).groupBy("_hot").agg(cuts.alias("_cuts"), F.max("_n").alias("_n"))
    bounds = of_hot.select("_hot", F.array_sort(F.array_distinct(own)).alias("_cuts"))
    joined = points.join(F.broadcast(bounds), F.col(by).eqNullSafe(F.col("_hot")), "left")
    return joined.withColumn("_b", F.coalesce(_passed(F.col("_cuts"), F.col("ts")), F.lit(0)).cast("long")).drop("_hot", "_cuts")


def _passed(bounds: Column, ts: Column) -> Column:
    """How many of the ascending ``bounds`` lie below ``ts``, in two steps."""
    m = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(bounds))).cast("int"))
    groups = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size(bounds) - 1) / m).cast("int")), lambda g: F.get(bounds, F.least((g + 1) * m, F.size(bounds)) - 1)), lambda b: b < ts))
    return F.when(F.size(bounds) == 0, 0).otherwise(F.least(groups * m, F.size(bounds)) + F.size(F.filter(F.slice(bounds, groups * m + 1, m), lambda b: b < ts)))


def _in_order(by: str = SERIES):
    return Window.partitionBy(by).orderBy("ts")


def _bucketed(points: DataFrame, width: float | even, total: Column, carried: str, by: str = SERIES) -> DataFrame:
    """Adds ``_b``, the time bucket, and ``carry``: the buckets' ``total`` combined over all earlier buckets."""
    keyed = bucket_points(points, width, by)
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    combine = {"sum": F.coalesce(F.sum("_t").over(before), F.lit(0)), "max": F.max("_t").over(before), "last": F.last("_t", True).over(before)}[carried]
    totals = keyed.groupBy(by, "_b").agg(total.alias("_t")).select(by, "_b", combine.alias("carry"))
    return keyed.join(totals, [by, "_b"])


def with_previous(points: DataFrame, values: dict[str, Column], time_bucket: TimeBucket = None, by: str = SERIES) -> DataFrame:
    """Adds ``_previous``, a struct of ``values`` at the point before, null at the first."""
    row = F.struct(*[c.alias(n) for n, c in values.items()])
    if time_bucket is None:
        return points.withColumn("_previous", F.lag(row).over(_in_order(by)))
    keyed = bucket_points(points, time_bucket, by)
    # Value by value, since an aggregate of structs would sort.
    ends = keyed.groupBy(by, "_b").agg(*[F.max_by(c, "ts").alias(n) for n, c in values.items()])
    before = Window.partitionBy(by).orderBy("_b")
    ends = ends.select(by, "_b", F.lag(F.struct(*values)).over(before).alias("_end"))
    w = Window.partitionBy(by, "_b").orderBy("ts")
    return keyed.join(ends, [by, "_b"]).withColumn("_previous", F.coalesce(F.lag(row).over(w), F.col("_end"))).drop("_b", "_end")


def rate(points: DataFrame, time_bucket: TimeBucket = None, into: str = "rate") -> DataFrame:
    """Change of the value over change of time since the point before, null at the first."""
    before = with_previous(points, {"v": value_num(), "ts": F.col("ts")}, time_bucket)
    change = (value_num() - F.col("_previous.v")) / F.nullif(F.col("ts") - F.col("_previous.ts"), F.lit(0.0))
    return before.withColumn(into, change).drop("_previous")


def cumulative(points: DataFrame, value: Column, how: str, into: str, time_bucket: TimeBucket = None, by: str = SERIES, strict: bool = False) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` up to each point, or with ``strict`` up to the one before."""
    f, last = {"sum": F.sum, "max": F.max}[how], -1 if strict else 0
    if time_bucket is None:
        return points.withColumn(into, f(value).over(_in_order(by).rowsBetween(Window.unboundedPreceding, last)))
    b = _bucketed(points, time_bucket, f(value), how, by)
    inside = f(value).over(Window.partitionBy(by, "_b").orderBy("ts").rowsBetween(Window.unboundedPreceding, last))
    both = F.greatest(inside, F.col("carry")) if how == "max" else F.coalesce(inside, F.lit(0)) + F.col("carry")
    return b.withColumn(into, both).drop("_b", "carry")


def series_index(points: DataFrame, time_bucket: TimeBucket = None, into: str = "index") -> DataFrame:
    """Position of each point in its series, from 0."""
    if time_bucket is None:
        return points.withColumn(into, (F.row_number().over(_in_order()) - 1).cast("long"))
    b = _bucketed(points, time_bucket, F.count(F.lit(1)), "sum")
    w = Window.partitionBy(SERIES, "_b").orderBy("ts")
    return b.withColumn(into, F.row_number().over(w) - 1 + F.col("carry")).drop("_b", "carry")


def twma(points: DataFrame, n: int, time_bucket: TimeBucket = None, into: str = "average", block: int = 1 << 16) -> DataFrame:
    """Average of the last ``n`` values weighted by the time since the point before; null when that time is 0.

    With ``time_bucket`` a series is cut into blocks of ``block`` points, and each block's last ``n`` points also
    stand before the next one, so that the window never needs more.
    """
    keys, order = [SERIES], "ts"
    if time_bucket is not None:
        keys, order, block = [SERIES, "_block"], "_i", max(n, block)
        own = F.floor(F.col("_i") / block)
        to = F.when(F.col("_i") % block >= block - n, F.array(own, own + 1)).otherwise(F.array(own))
        points = series_index(points, time_bucket, "_i").withColumn("_own", own).withColumn("_block", F.explode(to))
    w = Window.partitionBy(*keys).orderBy(order)
    timed = points.withColumn("_d", F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(0.0))).withColumn("_v", value_num() * F.col("_d"))
    last = w.rowsBetween(-(n - 1), 0)
    out = timed.withColumn(into, F.sum("_v").over(last) / F.nullif(F.sum("_d").over(last), F.lit(0.0))).drop("_d", "_v")
    return out if time_bucket is None else out.filter("_own = _block").drop("_i", "_own", "_block")


def every_nth(points: DataFrame, n: int, time_bucket: TimeBucket = None) -> DataFrame:
    """Points at positions 0, n, 2n and so on of each series."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    return points if n == 1 else series_index(points, time_bucket, "_i").filter(F.col("_i") % n == 0).drop("_i")


def running_max(points: DataFrame, time_bucket: TimeBucket = None, into: str = "running_max") -> DataFrame:
    return cumulative(points, value_num(), "max", into, time_bucket)


def first_last(points: DataFrame) -> DataFrame:
    """First and last value of each series, without a sort."""
    v = value_num()
    return points.groupBy(SERIES).agg(F.min("ts").alias("first_ts"), F.min_by(v, "ts").alias("first_value"), F.max("ts").alias("last_ts"), F.max_by(v, "ts").alias("last_value"))


def extremes(points: DataFrame) -> DataFrame:
    """Lowest and highest value of each series and the earliest time of each."""
    v = value_num()
    low = F.min(F.struct(v.alias("v"), F.col("ts").alias("t")))
    high = F.max(F.struct(v.alias("v"), (-F.col("ts")).alias("t")))
    found = points.filter(v.isNotNull()).groupBy(SERIES).agg(low.alias("l"), high.alias("h"))
    return found.select(SERIES, F.col("l.t").alias("low_ts"), F.col("l.v").alias("low_value"), (-F.col("h.t")).alias("high_ts"), F.col("h.v").alias("high_value"))


def asof_fill(points: DataFrame, target: str, source: str, time_bucket: TimeBucket = None, into: str = "latest") -> DataFrame:
    """Points of series ``target`` with the latest value of the same flow's series ``source`` at or before them."""
    both = points.filter(F.col("name").isin(target, source)).withColumn("_s", F.when(F.col("name") == source, value_num()))
    order = ("ts", F.col("name") != source)
    if time_bucket is None:
        w = Window.partitionBy("flow_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        filled = both.withColumn(into, F.last("_s", True).over(w))
    else:
        latest = F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("ts")))
        b = _bucketed(both, time_bucket, latest, "last", "flow_id")
        w = Window.partitionBy("flow_id", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        filled = b.withColumn(into, F.coalesce(F.last("_s", True).over(w), F.col("carry"))).drop("_b", "carry")
    return filled.filter(F.col("name") == target).drop("_s")


def behind(points: DataFrame, value: Column, circle: int, time_bucket: TimeBucket = None, by: str = SERIES) -> DataFrame:
    """Points of a number that counts up and wraps at ``circle`` whose value is at or below one before. Each step goes
    the shorter way round the circle, and steps add up.

    With ``time_bucket`` steps, their sum and its maximum run inside buckets, in one shuffle, and one row for each
    bucket carries them on; the points are read twice, for the buckets' rows and for their totals."""

    def step(now: Column, before: Column) -> Column:
        up = F.pmod(now - before, F.lit(circle))
        return F.when(up >= circle // 2, up - circle).otherwise(up)

    keys = [by] if time_bucket is None else [by, "_b"]
    if time_bucket is not None:
        points = bucket_points(points, time_bucket, by)
    # All columns break ties.
    w = Window.partitionBy(*keys).orderBy("ts", *[c for c in points.columns if c not in (*keys, "ts")])
    inside = points.withColumn("_v", value)
    inside = inside.withColumn("_u", F.sum(F.coalesce(step(F.col("_v"), F.lag("_v").over(w)), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("_m", F.max("_u").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if time_bucket is None:
        return inside.filter(F.col("_u") <= F.col("_m")).drop("_v", "_u", "_m")
    totals = inside.groupBy(*keys).agg(F.min_by("_v", "ts").alias("_first"), F.max_by("_v", "ts").alias("_last"), F.max_by("_u", "ts").alias("_du"), F.max("_u").alias("_top"))
    b = Window.partitionBy(by).orderBy("_b")
    jump = F.coalesce(step(F.col("_first"), F.lag("_last").over(b)) + F.lag("_du").over(b), F.lit(0))
    totals = totals.withColumn("_jump", jump).withColumn("_from", F.sum("_jump").over(b.rowsBetween(Window.unboundedPreceding, 0)))
    totals = totals.withColumn("_high", F.max(F.col("_from") + F.col("_top")).over(b.rowsBetween(Window.unboundedPreceding, -1)))
    both = inside.join(totals.select(*keys, "_from", "_high"), keys)
    return both.filter(F.col("_u") + F.col("_from") <= F.greatest(F.col("_m") + F.col("_from"), "_high")).drop("_v", "_u", "_m", "_from", "_high", "_b")


def pair_series(points: DataFrame, a: str, b: str, align: str = "timestamp", time_bucket: TimeBucket = None) -> DataFrame:
    """Values of two series of one flow side by side, as ``*_a`` and ``*_b``: of equal times, or of equal positions
    with the first series' time, up to the shorter one's length. One pass: rows of a flow and time (or position) are
    folded into one. Points must be unique by series and time; of repeated ones the highest values count."""
    points, key = points.filter(F.col("name").isin(a, b)), "ts"
    if align == "position":
        points, key = series_index(points, time_bucket, "_i"), "_i"
    of = lambda c, name: F.max(F.when(F.col("name") == name, F.col(c)))
    sides = [of(c, n).alias(f"{c}_{s}") for n, s in ((a, "a"), (b, "b")) for c in ("type", "value_int", "value_float")]
    times = [of(c, a).alias(c) for c in ("ts", "ts_ns") if c != key]
    return points.groupBy("flow_id", key).agg(*times, *sides).filter("type_a IS NOT NULL AND type_b IS NOT NULL").drop("_i")
