"""From records to points, series and flows, and back to wide rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowseries.functions.addresses import TUPLE, flow_id, series_id
from flowseries.functions.values import value_num
from flowseries.schema import BOOLEAN, INT, KINDS, POINTS
from flowseries.sources.shared import shared_path

POINT_COLUMNS = [c.split()[0] for c in POINTS.split(", ")]


def to_points(records: DataFrame, kind: str, suppress_zero: bool = True) -> DataFrame:
    """One point for each series field of each record (with the flow tuple and ``time`` in nanoseconds); zero and
    false give none unless ``suppress_zero`` is off. One pass: the fields of a record are an exploded array."""
    spec = KINDS[kind]
    types = {f.name: f.dataType.typeName() for f in spec.struct}

    def cell(field: str, name: str) -> Column:
        is_bool = types[field] == "boolean"
        number = F.lit(None).cast("long") if is_bool else F.col(field).cast("long")
        flag = F.col(field) if is_bool else F.lit(None).cast("boolean")
        return F.struct(F.lit(name).alias("name"), F.lit(BOOLEAN if is_bool else INT).alias("type"), number.alias("value_int"), flag.alias("value_bool"))

    cells = F.array(*[cell(f, n) for f, n in spec.series])
    keyed = records.withColumn("flow_id", flow_id())
    rows = keyed.select("flow_id", F.col("time").alias("ts_ns"), F.explode(cells).alias("p")).select("flow_id", "ts_ns", "p.*")
    if suppress_zero:
        # After the explosion, where it is compiled; a filter of the array would be interpreted cell by cell.
        rows = rows.filter("value_int <> 0 OR value_bool")
    return rows.select(
        "flow_id", series_id(F.col("flow_id"), F.col("name")).alias("series_id"), "name", "type", F.col("ts_ns").cast("double").alias("ts"), "ts_ns",
        "value_int", F.lit(None).cast("double").alias("value_float"), "value_bool", F.lit(None).cast("string").alias("value_text"),
    )


def catalog(points: DataFrame) -> DataFrame:
    """The series that have points."""
    return points.select("series_id", "flow_id", "name", "type").distinct()


def flows(records: DataFrame) -> DataFrame:
    """The distinct flows of rows with a tuple; ids follow from the tuple."""
    return records.select(*TUPLE).distinct().withColumn("id", flow_id()).select("id", *TUPLE)


def with_flow_id(records: DataFrame) -> DataFrame:
    return records.withColumn("flow_id", flow_id())


def to_wide(points: DataFrame, names: list[str]) -> DataFrame:
    """A row for each flow and time with a numeric column for each of ``names``."""
    numeric = points.filter(F.col("name").isin(names)).withColumn("v", F.coalesce(value_num(), F.col("value_bool").cast("double")))
    return numeric.groupBy("flow_id", "ts").pivot("name", names).agg(F.first("v", ignorenulls=True))


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


#: So many keys are broadcast at most.
FEW = 1 << 21


def _key_hash() -> Column:
    return F.xxhash64("series_id", "ts")


def repeated_keys(points: DataFrame) -> DataFrame:
    """Hashes ``_h`` of (series, ts) that more than one point has: those of all repeated keys. Of the points only their
    hashes are shuffled, straight to the tasks that count them, since nearly all are single."""
    return points.select(_key_hash().alias("_h")).repartition("_h").groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h")


def scratch(df: DataFrame, name: str = "repeated") -> DataFrame:
    """A few rows, written to the shared folder since several results read them."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_duplicates(points: DataFrame, order: list[str], on_duplicate: str = "first", repeated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Points with a (series, ts) of their own, and the rest. The first by ``order``, a total order, is kept;
    ``error`` fails on the first duplicate read. Keys are counted by hash, and only points whose hash is repeated are
    shuffled and sorted; while those hashes are few they are broadcast, so the other points stay where they are read.
    ``repeated`` are the points' ``repeated_keys``, where they are at hand."""
    if repeated is None:
        # Written, as both results read it.
        repeated = scratch(repeated_keys(points))
    few = repeated.count() <= FEW
    # A null key is no point's own either; its hash equals itself as it does in a window.
    hashes = F.broadcast(repeated) if few else repeated
    single, several = points.join(hashes, _key_hash() == F.col("_h"), "left_anti"), points.join(hashes, _key_hash() == F.col("_h"), "left_semi")
    w = Window.partitionBy("series_id", "ts")
    if on_duplicate == "error":
        message = F.concat(F.lit("duplicate point of series "), F.col("series_id").cast("string"))
        several = several.withColumn("_many", F.count(F.lit(1)).over(w)).filter((F.col("_many") < 2) | F.raise_error(message).cast("boolean")).drop("_many")
    marked = several.withColumn("_n", F.row_number().over(w.orderBy(*order)))
    if few and on_duplicate == "first":
        marked = scratch(marked)
    return single.unionByName(marked.filter("_n = 1").drop("_n")), marked.filter("_n > 1").drop("_n")


def mismatched(points: DataFrame, series: DataFrame) -> DataFrame:
    """Points whose type isn't their series'."""
    types = series.select("series_id", F.col("type").alias("series_type"))
    return points.join(types, "series_id").filter("type <> series_type")
