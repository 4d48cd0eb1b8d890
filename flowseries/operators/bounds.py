"""Counts and bounds of series, flows, selections and windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseries.functions.values import type_name, value_num

DEFAULT_X = (0.0, 100.0)
DEFAULT_Y = (0.0, 10.0)
PAD = 10.0


@dataclass(frozen=True)
class Window2D:
    """A chart's window."""

    x_lower: float
    x_upper: float
    y_lower: float
    y_upper: float

    def is_narrow(self, threshold: float = 3.0) -> bool:
        return self.x_upper - self.x_lower <= threshold


def point_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points"))


def series_bounds(points: DataFrame) -> DataFrame:
    """First and last time and, of numbers, lowest and highest value of each series, in one aggregation."""
    v = value_num()
    return points.groupBy("flow_id", "series_id", "name").agg(F.min("ts").alias("xmin"), F.max("ts").alias("xmax"), F.min(v).alias("ymin"), F.max(v).alias("ymax"))


def stored_series_bounds(summaries: DataFrame) -> DataFrame:
    """``series_bounds`` of a store's points, from their summaries."""
    return summaries.select("flow_id", "series_id", "name", "xmin", "xmax", "ymin", "ymax")


def stored_flow_bounds(summaries: DataFrame) -> DataFrame:
    """``flow_bounds`` of a store's points, from their summaries."""
    return summaries.groupBy("flow_id").agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))


def stored_y_bounds(summaries: DataFrame, series_ids: list[int] | None = None, pad: float = PAD) -> DataFrame:
    """``selection_y_bounds`` of a store's points, from their summaries."""
    chosen = summaries if series_ids is None else summaries.filter(F.col("series_id").isin(series_ids))
    lo, hi = padded(F.col("lo"), F.col("hi"), pad)
    return chosen.agg(F.min("ymin").alias("lo"), F.max("ymax").alias("hi")).select(lo.alias("y_lower"), hi.alias("y_upper"))


def stored_listing(series: DataFrame, summaries: DataFrame) -> DataFrame:
    """``series_listing`` of a store's series (time_series_id, ...), from their points' summaries."""
    counted = series.withColumnRenamed("time_series_id", "series_id").join(summaries.select("series_id", "n_points"), "series_id", "left")
    return counted.select("flow_id", "series_id", "name", type_name(F.col("type")).alias("type_name"), F.coalesce("n_points", F.lit(0)).alias("n_points"))


def flow_bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("flow_id").agg(F.min("ts").alias("xmin"), F.max("ts").alias("xmax"))


def padded(lower: Column, upper: Column, pad: float = PAD) -> tuple[Column, Column]:
    """Bounds of a constant get room on either side."""
    return F.when(lower == upper, lower - pad).otherwise(lower), F.when(lower == upper, upper + pad).otherwise(upper)


def selection_y_bounds(points: DataFrame, series_ids: list[int] | None = None, pad: float = PAD) -> DataFrame:
    """One row: bounds of the numbers of the selected series (all: None), null without numbers."""
    chosen = points if series_ids is None else points.filter(F.col("series_id").isin(series_ids))
    lo, hi = padded(F.col("lo"), F.col("hi"), pad)
    return chosen.agg(F.min(value_num()).alias("lo"), F.max(value_num()).alias("hi")).select(lo.alias("y_lower"), hi.alias("y_upper"))


def flow_y_bounds(points: DataFrame, pad: float = PAD) -> DataFrame:
    """``selection_y_bounds`` of every flow's series."""
    lo, hi = padded(F.col("lo"), F.col("hi"), pad)
    return points.groupBy("flow_id").agg(F.min(value_num()).alias("lo"), F.max(value_num()).alias("hi")).select("flow_id", lo.alias("y_lower"), hi.alias("y_upper"))


def in_window(points: DataFrame, w: Window2D) -> DataFrame:
    """Points strictly inside; values that aren't numbers pass in y. Ranges on ``ts`` reach the scan."""
    v = value_num()
    return points.filter((F.col("ts") > w.x_lower) & (F.col("ts") < w.x_upper)).filter(v.isNull() | ((v > w.y_lower) & (v < w.y_upper)))


def window_y_bounds(points: DataFrame, w: Window2D) -> DataFrame:
    """One row: bounds of the numbers inside the window, the window's own if there are none."""
    found = in_window(points, w).agg(F.min(value_num()).alias("lo"), F.max(value_num()).alias("hi"))
    return found.select(F.coalesce("lo", F.lit(w.y_lower)).alias("y_lower"), F.coalesce("hi", F.lit(w.y_upper)).alias("y_upper"))


def merge_bounds(bounds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hull of windows (x_lower, x_upper, y_lower, y_upper)."""
    hull = [f(c).alias(c) for c, f in (("x_lower", F.min), ("x_upper", F.max), ("y_lower", F.min), ("y_upper", F.max))]
    return bounds.groupBy(*(by or [])).agg(*hull)


def default_window(points: DataFrame, flow_id: int, series_ids: list[int] | None = None) -> DataFrame:
    """One row: the flow's times and the selected series' values; constants where there are none."""
    own = points.filter(F.col("flow_id") == flow_id)
    chosen = F.lit(True) if series_ids is None else F.col("series_id").isin(series_ids)
    v = F.when(chosen, value_num())
    found = own.agg(F.min("ts").alias("x0"), F.max("ts").alias("x1"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo, hi = padded(F.col("lo"), F.col("hi"))
    columns = zip(("x_lower", "x_upper", "y_lower", "y_upper"), (F.col("x0"), F.col("x1"), lo, hi), (*DEFAULT_X, *DEFAULT_Y), strict=True)
    return found.select(*[F.coalesce(c, F.lit(d)).alias(n) for n, c, d in columns])


def default_window_pair(points: DataFrame, first: tuple[int, list[int] | None], second: tuple[int, list[int] | None]) -> DataFrame:
    return merge_bounds(default_window(points, *first).unionByName(default_window(points, *second)))


def series_listing(series: DataFrame, points: DataFrame) -> DataFrame:
    """Name, type and number of points of each series, 0 without."""
    counted = series.join(point_counts(points), "series_id", "left")
    return counted.select("flow_id", "series_id", "name", type_name(F.col("type")).alias("type_name"), F.coalesce("n_points", F.lit(0)).alias("n_points"))


def flow_count(records: DataFrame, approx: bool = False) -> DataFrame:
    key = F.struct("src", "dst", "sport", "dport", "l4proto")
    return records.agg((F.approx_count_distinct(key) if approx else F.count_distinct(key)).alias("n_flows"))
