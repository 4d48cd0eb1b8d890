"""Preparing series for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseries.functions.labels import string_label
from flowseries.functions.values import value_num
from flowseries.operators.bounds import Window2D, in_window, series_bounds
from flowseries.operators.windows import every_nth
from flowseries.schema import BOOLEAN, STRING

# How many booleans a wide chart skips, combined and split, and the split chart's axis for them.
BOOLEAN_STEP = 200
SPLIT_BOOLEAN_STEP = 10
SPLIT_BOOLEAN_AXIS = (2.0, 0.0)


def numeric_y() -> Column:
    """Numbers as doubles, other types at 0."""
    return F.coalesce(value_num(), F.lit(0.0))


def _half_up(x: Column) -> Column:
    """Rounded, halves away from 0."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def boolean_y(lower: Column, upper: Column) -> Column:
    """True in the middle of the axis, false (and null) at its lower end."""
    return F.when(F.coalesce("value_bool", F.lit(False)), _half_up((upper - lower) / 2) + lower).otherwise(lower)


def plot_numeric(points: DataFrame) -> DataFrame:
    return points.withColumn("y", numeric_y())


def plot_bool(points: DataFrame, lower: float, upper: float) -> DataFrame:
    return points.withColumn("y", boolean_y(F.lit(lower), F.lit(upper)))


def true_only(points: DataFrame) -> DataFrame:
    return points.filter("value_bool")


def string_series(points: DataFrame) -> DataFrame:
    return points.filter(F.col("type") == STRING)


def string_points(points: DataFrame) -> DataFrame:
    """Text points with their labels."""
    return string_series(points).withColumn("label", string_label())


def fetch_series(points: DataFrame, flow_id: int, series_ids: list[int]) -> DataFrame:
    """The points of a flow's selected series with their bounds and the flow's, in one plan."""
    own = points.filter(F.col("flow_id") == flow_id)
    chosen = own.filter(F.col("series_id").isin(series_ids))
    bounds = series_bounds(chosen).drop("flow_id", "name")
    whole = own.agg(F.min("ts").alias("flow_xmin"), F.max("ts").alias("flow_xmax"))
    return chosen.join(bounds, "series_id").crossJoin(F.broadcast(whole))  # the second is one row


def prepare_combined(points: DataFrame, w: Window2D, n: int = 1, narrow_threshold: float = 3.0, time_bucket: float | None = None, decimate_after: bool = True) -> DataFrame:
    """All series on one axis: every n-th point, then the window, then y by type. True booleans only, one in
    ``BOOLEAN_STEP`` unless the window is narrow; texts have no y. ``decimate_after`` off filters first, which lets
    the window reach the scan but may pick other points."""
    picked = in_window(every_nth(points, n, time_bucket), w) if decimate_after else every_nth(in_window(points, w), n, time_bucket)
    flags = true_only(picked.filter(F.col("type") == BOOLEAN))
    if not w.is_narrow(narrow_threshold):
        flags = every_nth(flags, BOOLEAN_STEP, time_bucket)
    numbers = picked.filter(F.col("type") < BOOLEAN).withColumn("y", numeric_y())
    texts = picked.filter(F.col("type") == STRING).withColumn("y", F.lit(None).cast("double"))
    return numbers.unionByName(plot_bool(flags, w.y_lower, w.y_upper)).unionByName(texts)


def prepare_split(points: DataFrame, w: Window2D, time_bucket: float | None = None) -> DataFrame:
    """A chart for each series: the window only; numbers with their series' bounds inside it, true booleans thinned
    on a fixed axis; texts are left out."""
    inside = in_window(points, w)
    numbers = inside.filter(F.col("type") < BOOLEAN).withColumn("y", numeric_y())
    # One aggregate beside the points rather than a window, so that one long series can be spread.
    bounds = numbers.groupBy("series_id").agg(F.min("y").alias("y_lower"), F.max("y").alias("y_upper"))
    lower, upper = SPLIT_BOOLEAN_AXIS
    flags = plot_bool(every_nth(true_only(inside.filter(F.col("type") == BOOLEAN)), SPLIT_BOOLEAN_STEP, time_bucket), lower, upper)
    return numbers.join(bounds, "series_id").unionByName(flags.withColumn("y_lower", F.lit(lower)).withColumn("y_upper", F.lit(upper)))


def hull(points: DataFrame) -> DataFrame:
    """Adds the window around all of ``points``."""
    v = value_num()
    box = points.agg(F.min("ts").alias("x_lower"), F.max("ts").alias("x_upper"), F.min(v).alias("y_lower"), F.max(v).alias("y_upper"))
    return points.crossJoin(F.broadcast(box))


def compare_flows(points: DataFrame, first: tuple[int, list[int]], second: tuple[int, list[int]], n: int = 1, time_bucket: float | None = None) -> DataFrame:
    """Two flows' selected series on one axis with the window around both."""
    side = lambda flow, ids: points.filter((F.col("flow_id") == flow) & F.col("series_id").isin(ids))
    both = side(*first).unionByName(side(*second))
    return hull(every_nth(both, n, time_bucket)).withColumn("y", numeric_y())


def ordered(points: DataFrame) -> DataFrame:
    """In the order of time, within each series."""
    return points.orderBy("series_id", "ts")


