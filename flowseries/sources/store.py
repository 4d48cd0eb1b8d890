"""The flow store: Parquet tables under one path, each a list of parts.

A table's rows lie in parts, folders of their own that never change. What the table holds is a small list of its parts,
written anew as the next number with each change, so readers of an earlier list are undisturbed, a failed write leaves
no trace in the table, and nobody has to list folders. A part may have a name (a stream's batch, say): adding it again
replaces it, so a batch can come twice. A part without rows isn't added. One writer at a time.

Deletes write keys only: they hide rows of earlier parts, not of later ones. Rows of id tables lie in folders by the
leading bits of their ids, points by day, clustered by series and time, so that look-ups and merges read the folders,
files and row groups of their own keys. With each part of points goes a summary of every series in it: counts, first
and last time, least and greatest number. Bounds come from summaries, and so do the parts that a series has points in.

When ``fold`` parts of about one size have come together they are written as one, without what deletes hide, so a row is
rewritten a number of times that grows with the logarithm of the table. ``compact`` folds all, ``vacuum`` removes
folders that the current lists don't name.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowseries.functions.addresses import TUPLE, hashed_id, hashed_id_of, series_id
from flowseries.functions.values import value_num
from flowseries.operators.points import FEW, mismatched, repeated_keys, split_duplicates
from flowseries.schema import STORE, VALUE_COLUMNS

_VALUES = ["type", *VALUE_COLUMNS]
#: The key that deletes name.
_KEYS = {"flows": "id", "flow_attributes": "id", "time_series": "time_series_id", "time_series_data": "time_series_id"}
_DAY_NS = 86_400_000_000_000
#: Distinct days of a batch that are listed in a filter; beyond, the filter is their range.
_MAX_DAYS = 1024
#: Bytes of the smallest tier of parts; each further one is ``fold`` times as large.
_TIER = 1 << 20
_SUMMARY = "time_series_id long, n_points long, xmin double, xmax double, ymin double, ymax double"


@dataclass(frozen=True)
class Part:
    """A folder of rows; ``named`` by the caller, or not."""

    seq: int
    name: str
    bytes: int
    named: bool


@dataclass(frozen=True)
class Listing:
    """What a table holds: its parts, and the numbers of its deletes."""

    version: int = -1
    seq: int = 0
    parts: tuple[Part, ...] = ()
    deletes: tuple[int, ...] = ()


class FlowTables:
    """Look-ups over the four tables, whatever holds them."""

    spark: SparkSession

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError

    def keyed(self, name: str, ids: list[int]) -> DataFrame:
        """A table's rows of some ids."""
        return self.table(name).filter(F.col(_KEYS[name]).isin(ids) if len(ids) != 1 else F.col(_KEYS[name]) == ids[0])

    @property
    def flows(self) -> DataFrame:
        return self.table("flows")

    @property
    def attributes(self) -> DataFrame:
        return self.table("flow_attributes")

    @property
    def series_table(self) -> DataFrame:
        return self.table("time_series")

    @property
    def data(self) -> DataFrame:
        return self.table("time_series_data")

    # Look-ups

    def flow(self, src: str, dst: str, sport: int, dport: int, l4proto: int = 6) -> DataFrame:
        """The flow of a tuple: a row or none."""
        wanted = zip(TUPLE, (src, dst, sport, dport, l4proto), strict=True)
        found = self.flows
        for c, v in wanted:
            found = found.filter(F.col(c) == v)
        return found.orderBy("id").limit(1)

    def flow_by_id(self, id: int) -> DataFrame:
        return self.keyed("flows", [id])

    def series_by_id(self, id: int) -> DataFrame:
        return self.keyed("time_series", [id])

    def attribute_by_id(self, id: int) -> DataFrame:
        return self.keyed("flow_attributes", [id])

    def attribute(self, flow_id: int, name: str) -> DataFrame:
        """One attribute; fails where there is none."""
        found = self.attributes.filter((F.col("flow_id") == flow_id) & (F.col("name") == name))
        if found.isEmpty():
            raise KeyError(f"flow {flow_id} has no attribute {name}")
        return found

    def list_attributes(self, flow_id: int) -> DataFrame:
        return self.attributes.filter(F.col("flow_id") == flow_id).orderBy("name")

    def series(self, flow_id: int) -> DataFrame:
        return self.series_table.filter(F.col("flow_id") == flow_id)

    def series_in(self, ids: list[int]) -> DataFrame:
        return self.keyed("time_series", ids)

    def points(self, series_id: int, ordered: bool = True) -> DataFrame:
        found = self.keyed("time_series_data", [series_id])
        return found.orderBy("ts") if ordered else found

    def require_series(self, names: list[str], flow_ids: list[int] | None = None) -> DataFrame:
        """Series of these names of the flows that have them all."""
        return complete_series(self.series_table if flow_ids is None else self.series_table.filter(F.col("flow_id").isin(flow_ids)), names)

    def joined(self) -> DataFrame:
        """Points with their series' and flows' columns."""
        series = self.series_table.withColumnRenamed("type", "series_type")
        return self.data.join(series, "time_series_id").join(self.flows.withColumnRenamed("id", "flow_id"), "flow_id")


class FlowStore(FlowTables):
    """``bucket_bits`` and ``fold`` are those the store was made with, where it exists already."""

    def __init__(self, spark: SparkSession, path: str, bucket_bits: int = 3, fold: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self._asked = {"bucket_bits": bucket_bits, "fold": fold}
        self._settings: dict | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, format: str | None = None, **options) -> FlowStore | ForeignStore:
        """By the path's ending: SQL stores through JDBC (the user brings the driver), anything else is Parquet."""
        kind = format or ("jdbc" if path.startswith("jdbc:") or path.rsplit(".", 1)[-1] in ("sqlite", "duck", "duckdb", "db") else "parquet")
        return ForeignStore(spark, path, **options) if kind == "jdbc" else cls(spark, path)

    # Files

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _read_json(self, path: str) -> dict | None:
        system, target = self._fs(path)
        if not system.exists(target):
            return None
        stream = system.open(target)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _write_json(self, path: str, value: dict) -> None:
        """Fails where the file exists: another writer was there first."""
        system, target = self._fs(path)
        stream = system.create(target, False)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def _size(self, path: str) -> int:
        system, target = self._fs(path)
        return system.getContentSummary(target).getLength() if system.exists(target) else 0

    @property
    def settings(self) -> dict:
        """Those that the first change has written, before it those asked for."""
        if self._settings is None:
            self._settings = self._read_json(f"{self.path}/_settings.json")
        return self._settings or self._asked

    def _keep_settings(self) -> None:
        if self._settings is None and self.settings is self._asked:
            self._write_json(f"{self.path}/_settings.json", self._asked)
            self._settings = self._asked

    # Listings

    def listing(self, table: str) -> Listing:
        system, folder = self._fs(f"{self.path}/{table}/_lists")
        numbers = [int(f.getPath().getName()) for f in system.listStatus(folder)] if system.exists(folder) else []
        if not numbers:
            return Listing()
        found = self._read_json(f"{self.path}/{table}/_lists/{max(numbers):012d}")
        return Listing(found["version"], found["seq"], tuple(Part(**p) for p in found["parts"]), tuple(found["deletes"]))

    def _commit(self, table: str, now: Listing) -> None:
        # A delete that is older than every part hides nothing.
        deletes = tuple(d for d in now.deletes if any(p.seq < d for p in now.parts))
        now = replace(now, version=now.version + 1, deletes=deletes)
        self._write_json(f"{self.path}/{table}/_lists/{now.version:012d}", asdict(now))
        system, old = self._fs(f"{self.path}/{table}/_lists/{now.version - 100:012d}")
        system.delete(old, False)

    def _folder(self, table: str, seq: int, what: str = "v0") -> str:
        return f"{self.path}/{table}/{what}/seq={seq}"

    def _bucket(self, id: Column) -> Column:
        return F.pmod(F.shiftright(id, 60 - self.settings["bucket_bits"]), F.lit(1 << self.settings["bucket_bits"]))

    def _place(self, table: str) -> tuple[str, str, Column]:
        """Name, type and value of the column that a table's folders go by."""
        if table == "time_series_data":
            # By the key's own time: rows of one key then always lie in one folder.
            return "day", "long", F.floor(F.col("ts") / _DAY_NS)
        if table in _KEYS:
            return "bucket", "long", self._bucket(F.col(_KEYS[table]))
        own = {"quarantine": "reason", "accounts": "kind"}[table]
        return own, "string", F.col(own)

    def _write(self, table: str, df: DataFrame, seq: int) -> int:
        """Rows as the folder of a part, whose bytes are the result: none for no rows, as folders hold no empty files."""
        place, _, value = self._place(table)
        target = self._folder(table, seq)
        out = df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in STORE[table].split(", ")]).withColumn(place, value)
        if table == "time_series_data":
            # By ranges of day and key, so that one long series may fill several files and a task few folders.
            order = [place, "time_series_id", "ts"]
            out = out.repartitionByRange(*order).sortWithinPartitions(*order)
        elif table in _KEYS:
            out = out.repartition(place).sortWithinPartitions(place, _KEYS[table])
        out.write.mode("overwrite").partitionBy(place).parquet(target)
        size = self._size(target)
        if table == "time_series_data" and size:
            rows = self._rows(table, [Part(seq, "", 0, False)], Listing())
            # Totals are dealt anew, since one task for many tasks' parts of them would read much.
            summarised(rows).repartition(1 + size // (1 << 30)).write.mode("overwrite").parquet(self._folder(table, seq, "summaries"))
        return size

    def _change(self, table: str, add: DataFrame | None = None, name: str | None = None, delete: DataFrame | None = None) -> None:
        """Rows added (those of a ``name`` in place of what it held), and earlier rows of the ids in ``delete`` hidden."""
        self._keep_settings()
        now = self.listing(table)
        seq = now.seq + 1
        size = self._write(table, add, seq) if add is not None else 0
        parts = tuple(p for p in now.parts if name is None or p.name != name)
        new = (Part(seq, name or uuid.uuid4().hex, size, name is not None),) if size else ()
        hidden = 0
        if delete is not None and parts:
            keys = delete.select(F.col(_KEYS[table]).cast("long").alias("key")).distinct().withColumn("bucket", self._bucket(F.col("key")))
            keys.repartition("bucket").sortWithinPartitions("key").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(table, seq, "deletes"))
            hidden = self._size(self._folder(table, seq, "deletes"))
        for what, kept in (("v0", size), ("deletes", hidden)):
            if not kept:
                system, left = self._fs(self._folder(table, seq, what))
                system.delete(left, True)
        if new or hidden or len(parts) < len(now.parts):
            self._commit(table, Listing(now.version, seq, (*parts, *new), (*now.deletes, *([seq] if hidden else []))))
            self._fold(table)

    def _fold(self, table: str) -> None:
        """Where ``fold`` parts of a tier have come together, they become one. The newest part of each stream of named
        parts stays as it is, since its batch may come again."""
        fold = self.settings["fold"]
        now = self.listing(table)
        newest = {p.name.rsplit("-", 1)[0]: p.seq for p in sorted(now.parts, key=lambda p: p.seq) if p.named}
        tiers: dict[int, list[Part]] = defaultdict(list)
        for p in now.parts:
            if p.seq not in newest.values():
                tiers[int(math.log(max(p.bytes, _TIER) / _TIER, fold))].append(p)
        for several in tiers.values():
            if len(several) >= fold:
                self._merge(table, several, f"folded-{now.seq + 1}")
                return self._fold(table)

    def _merge(self, table: str, several: list[Part], name: str) -> None:
        now = self.listing(table)
        seq, gone = now.seq + 1, {p.seq for p in several}
        size = self._write(table, self._rows(table, several, now), seq)
        new = (Part(seq, name, size, False),) if size else ()
        self._commit(table, Listing(now.version, seq, (*[p for p in now.parts if p.seq not in gone], *new), now.deletes))

    def _rows(self, table: str, parts: list[Part], now: Listing) -> DataFrame:
        """Rows of some parts less what deletes hide, with ``seq`` and the column of the folders."""
        place, kind, _ = self._place(table)
        own = [c for c in STORE[table].split(", ") if c.split()[0] != place]
        schema = f"{', '.join(own)}, seq long, {place} {kind}"
        if not parts:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}/v0").parquet(*[self._folder(table, p.seq) for p in parts])
        return self._visible(table, df, parts, now)

    def _visible(self, table: str, df: DataFrame, parts: list[Part], now: Listing) -> DataFrame:
        later = [d for d in now.deletes if any(p.seq < d for p in parts)]
        if not later:
            return df
        keys = self.spark.read.schema("key long, seq long, bucket long").option("basePath", f"{self.path}/{table}/deletes").parquet(*[self._folder(table, d, "deletes") for d in later])
        keys = keys.groupBy(F.col("key").alias("_key")).agg(F.max("seq").alias("_seq"))
        return df.join(keys, (F.col(_KEYS[table]) == F.col("_key")) & (F.col("seq") < F.col("_seq")), "left_anti")

    def parts(self, name: str, only: set[int] | None = None) -> DataFrame:
        """A table's rows with the ``part`` they were added in and the ``bucket`` or ``day`` of their folder; of ``only``
        some parts, by number."""
        now = self.listing(name)
        chosen = [p for p in now.parts if only is None or p.seq in only]
        names = F.create_map(*[F.lit(x) for p in chosen for x in (p.seq, p.name)]) if chosen else None
        rows = self._rows(name, chosen, now)
        return rows.withColumn("part", names[F.col("seq")] if chosen else F.lit(None).cast("string")).drop("seq") if "part" not in rows.columns else rows.drop("seq")

    def table(self, name: str) -> DataFrame:
        return self.parts(name).select(*[c.split()[0] for c in STORE[name].split(", ")])

    def keyed(self, name: str, ids: list[int]) -> DataFrame:
        columns = [c.split()[0] for c in STORE[name].split(", ")]
        wanted = F.col(_KEYS[name]).isin(ids) if len(ids) != 1 else F.col(_KEYS[name]) == ids[0]
        if name != "time_series_data":
            bits = self.settings["bucket_bits"]
            buckets = sorted({(i >> (60 - bits)) % (1 << bits) for i in ids})
            return self.parts(name).filter(F.col("bucket").isin(buckets) & wanted).select(*columns)
        # A single part needs no look-up.
        only = None if len(self.listing(name).parts) < 2 else self.parts_with(ids)
        return self.parts(name, only).filter(wanted).select(*columns)

    def flow(self, src: str, dst: str, sport: int, dport: int, l4proto: int = 6) -> DataFrame:
        """The flow of a tuple: a row or none. Its id follows from the tuple."""
        return self.flow_by_id(hashed_id_of(src, dst, sport, dport, l4proto)).limit(1)

    def points_between(self, low: float, high: float) -> DataFrame:
        """Points of times from ``low`` to ``high``, read from their days only."""
        rows = self.parts("time_series_data").filter(F.col("day").between(int(low // _DAY_NS), int(high // _DAY_NS)))
        return rows.filter(F.col("ts").between(float(low), float(high))).drop("day")

    # Summaries

    def _summary_rows(self) -> DataFrame:
        now = self.listing("time_series_data")
        schema = f"{_SUMMARY}, seq long"
        if not now.parts:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/time_series_data/summaries").parquet(*[self._folder("time_series_data", p.seq, "summaries") for p in now.parts])
        return self._visible("time_series_data", df, list(now.parts), now)

    def parts_with(self, ids: list[int]) -> set[int]:
        """Numbers of the parts that hold points of some series, as many as there are parts at most."""
        return {r[0] for r in self._summary_rows().filter(F.col("time_series_id").isin(ids)).select("seq").distinct().collect()}

    def _parts_of(self, series: DataFrame) -> set[int]:
        return {r[0] for r in self._summary_rows().join(_hinted(series), "time_series_id", "left_semi").select("seq").distinct().collect()}

    def points_of(self, series: DataFrame) -> DataFrame:
        """Points of ``series`` (time_series_id and other columns, one row each) with those columns; parts without any of
        them aren't read."""
        with held(series):
            found = self.parts("time_series_data", self._parts_of(series.select("time_series_id"))).drop("day", "part")
            return found.join(_hinted(series), "time_series_id")

    def summaries(self) -> DataFrame:
        """For each series that has points their count, first and last time, and least and greatest number; no point is
        read."""
        merged = self._summary_rows().groupBy("time_series_id").agg(F.sum("n_points").alias("n_points"), *[f(c).alias(c) for c, f in (("xmin", F.min), ("xmax", F.max), ("ymin", F.min), ("ymax", F.max))])
        return self.series_table.join(merged, "time_series_id").select("flow_id", F.col("time_series_id").alias("series_id"), "name", "type", "n_points", "xmin", "xmax", "ymin", "ymax")

    # Upkeep

    def compact(self) -> None:
        """Each table as one part, ``base``, without what deletes hide."""
        for name in STORE:
            now = self.listing(name)
            if len(now.parts) > 1 or now.deletes:
                self._merge(name, list(now.parts), "base")

    def vacuum(self) -> None:
        """Remove folders that the current lists don't name, and so what readers of earlier lists may still need."""
        for name in STORE:
            now = self.listing(name)
            for what, kept in (("v0", {p.seq for p in now.parts}), ("summaries", {p.seq for p in now.parts}), ("deletes", set(now.deletes))):
                system, folder = self._fs(f"{self.path}/{name}/{what}")
                for f in system.listStatus(folder) if system.exists(folder) else []:
                    if f.getPath().getName().startswith("seq=") and int(f.getPath().getName()[4:]) not in kept:
                        system.delete(f.getPath(), True)

    # Changes

    def _buckets(self, ids: DataFrame, key: str) -> list[int]:
        """Buckets of some ids: few, so they come to the driver."""
        return [r[0] for r in ids.select(self._bucket(F.col(key))).distinct().collect()]

    def _in_buckets(self, table: str, buckets: list[int]) -> DataFrame:
        return self.parts(table).filter(F.col("bucket").isin(buckets))

    def _missing(self, table: str, new: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """Rows of ``new`` whose ids the table hasn't; only ids of their own buckets are read."""
        id = _KEYS[table]
        if not self.listing(table).parts:
            return new
        buckets = self._buckets(new, id) if buckets is None else buckets
        return new.join(self._in_buckets(table, buckets).select(id), id, "left_anti")

    def add_flows(self, tuples: DataFrame) -> None:
        """Flows that aren't there yet."""
        ids = tuples.select(*TUPLE).distinct().withColumn("id", hashed_id(*map(F.col, TUPLE)))
        with held(ids):
            self._change("flows", self._missing("flows", ids))

    def delete_flows(self, ids: list[int], cascade: bool = False) -> None:
        """Fails for flows with series or attributes, unless ``cascade`` deletes those too."""
        owned, named = self.series_table.filter(F.col("flow_id").isin(ids)), self.attributes.filter(F.col("flow_id").isin(ids))
        if not cascade and not (owned.isEmpty() and named.isEmpty()):
            raise ValueError("flows still have series or attributes")
        if cascade:
            self.delete_points(owned)
            self._change("time_series", delete=owned)
            self._change("flow_attributes", delete=named)
        self._change("flows", delete=self._ids("id", ids))

    def _ids(self, name: str, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], f"{name} long")

    def _series(self, series: DataFrame) -> DataFrame:
        return series.select("flow_id", "name", "type").distinct().withColumn("time_series_id", series_id(F.col("flow_id"), F.col("name")))

    def create_series(self, series: DataFrame) -> None:
        """New series (flow_id, name, type); fails if a flow already has one of that name."""
        new = self._series(series)
        with held(new):
            twice = new.groupBy("time_series_id").count().filter("count > 1")
            stored = self._in_buckets("time_series", self._buckets(new, "time_series_id"))
            if not twice.isEmpty() or not new.join(stored, "time_series_id", "left_semi").isEmpty():
                raise ValueError("a flow has a series of that name")
            self._change("time_series", new)

    def ensure_series(self, series: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """Series that aren't there yet; of several types of one name the least counts. Gives the stored series of their
        buckets."""
        new = self._series(series).groupBy("time_series_id", "flow_id", "name").agg(F.min("type").alias("type"))
        with held(new):
            buckets = self._buckets(new, "time_series_id") if buckets is None else buckets
            if buckets:
                self._change("time_series", self._missing("time_series", new, buckets))
        return self._in_buckets("time_series", buckets)

    def delete_points(self, series: DataFrame) -> None:
        """All points of series (time_series_id), which stay."""
        self._change("time_series_data", delete=series)

    def delete_series(self, ids: list[int]) -> None:
        """Series and their points."""
        self.delete_points(self._ids("time_series_id", ids))
        self._change("time_series", delete=self._ids("time_series_id", ids))

    def set_attributes(self, attributes: DataFrame, order: Column | None = None) -> None:
        """Attributes (flow_id, name, type, values) added or replaced; of several of one name the last by ``order``."""
        w = Window.partitionBy("flow_id", "name").orderBy((order if order is not None else F.lit(0)).desc(), *_VALUES)
        new = attributes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("flow_id", "name", *_VALUES)
        new = new.withColumn("id", hashed_id(F.col("flow_id"), F.lit("attribute"), F.col("name")))
        with held(new):
            self._change("flow_attributes", new, delete=new)

    def delete_attribute(self, flow_id: int, name: str) -> None:
        self._change("flow_attributes", delete=self._ids("id", [hashed_id_of(flow_id, "attribute", name)]))

    def append_points(self, points: DataFrame, part: str | None = None) -> None:
        """Points (series_id, ts, ts_ns, type, values) of known series. Fails if a point's type isn't its series'."""
        # Points themselves are read again rather than held: there may be many, and of their series few.
        kinds = points.select("series_id", "type").distinct()
        with held(kinds):
            known = self._in_buckets("time_series", self._buckets(kinds, "series_id")).withColumnRenamed("time_series_id", "series_id")
            if not mismatched(kinds, known).isEmpty():
                raise TypeError("points of other types than their series")
            self._change("time_series_data", points.withColumnRenamed("series_id", "time_series_id"), part)

    def _stored_keys(self, points: DataFrame, part: str | None, by_series: bool = False) -> DataFrame | None:
        """``_series`` and ``_ts`` of stored points that may be among ``points``; other days and times aren't read, nor
        is the part itself, nor, ``by_series``, are parts without a series of theirs."""
        others = {p.seq for p in self.listing("time_series_data").parts if p.name != part}
        if not others:
            return None
        if by_series:
            series = points.select(F.col("series_id").alias("time_series_id")).distinct()
            with held(series):
                others &= self._parts_of(series)
            if not others:
                return None
        times = F.min("ts").alias("low"), F.max("ts").alias("high")
        days = points.groupBy(self._place("time_series_data")[2].alias("day")).agg(*times).filter("low IS NOT NULL").limit(_MAX_DAYS + 1).collect()
        if not days:
            return None
        stored = self.parts("time_series_data", others)
        if len(days) <= _MAX_DAYS:
            low, high = min(r.low for r in days), max(r.high for r in days)
            stored = stored.filter(F.col("day").isin(sorted(r.day for r in days)))
        else:
            low, high = points.agg(*times).first()
            stored = stored.filter(F.col("day").between(math.floor(low / _DAY_NS), math.floor(high / _DAY_NS)))
        return stored.filter((F.col("ts") >= low) & (F.col("ts") <= high)).select(F.col("time_series_id").alias("_series"), F.col("ts").alias("_ts"))

    def unstored(self, points: DataFrame, part: str | None = None, by_series: bool = False) -> DataFrame:
        """Points whose (series, ts) no other part has. Only the days and times of ``points`` are read."""
        stored = self._stored_keys(points, part, by_series)
        return points if stored is None else points.join(stored, (F.col("series_id") == F.col("_series")) & (points["ts"] == F.col("_ts")), "left_anti")

    def merge_points(self, points: DataFrame, part: str | None = None, by_series: bool = False) -> None:
        """``append_points`` for those of a (series, ts) that isn't stored yet, so that a batch can come twice.
        ``by_series`` is for points of series that few parts have."""
        with held(points):
            new = self.unstored(points, part, by_series)
            with held(new):
                self.append_points(new, part)

    def save_series(self, points: DataFrame, part: str | None = None) -> None:
        """Derived points: their series are created where missing, then the points are merged."""
        with held(points):
            self.ensure_series(points)
            self.merge_points(points, part, by_series=True)

    def fates(self, points: DataFrame, order: list[str], repeated: DataFrame, wrong: DataFrame, stored: DataFrame | None) -> DataFrame:
        """``points`` with ``fate``: ``duplicate`` for all but the first by ``order`` of a (series, ts) in ``repeated``,
        ``type`` for those of a series and type in ``wrong``, ``known`` for those whose key is ``stored``, else ``new``."""
        first, again = split_duplicates(points, order, repeated=repeated)
        marked, known = first.join(_hinted(wrong).withColumn("_wrong", F.lit(True)), ["series_id", "type"], "left"), F.lit(False)
        if stored is not None:
            # Shuffled before they are told apart: nearly all are.
            key = (F.col("series_id") == F.col("_series")) & (F.col("ts") == F.col("_ts"))
            marked, known = marked.join(stored.repartition("_series", "_ts").distinct(), key, "left"), F.col("_ts").isNotNull()
        fate = F.when(F.col("_wrong"), "type").when(known, "known").otherwise("new")
        return marked.withColumn("fate", fate).select(*points.columns, "fate").unionByName(again.withColumn("fate", F.lit("duplicate")))

    def take_points(self, points: DataFrame, order: list[str], part: str) -> dict[str, int]:
        """Points by their ``fates``: new ones are stored, known ones left, the others go to ``quarantine``, each as the
        part's own; series are created where missing. Gives the number of each fate; a part that comes again changes
        nothing. Points are only joined with what some of them meet."""
        series = points.groupBy("flow_id", "name", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("series_id", series_id(F.col("flow_id"), F.col("name")))
        repeated = repeated_keys(points)
        with held(points), held(series), held(repeated):
            counted = series.groupBy(self._bucket(F.col("series_id"))).agg(F.sum("n")).collect()
            total = sum(r[1] for r in counted)
            if not total:
                self.refuse(None, part)
                return {}
            known = self.ensure_series(series, [r[0] for r in counted])
            wrong = series.join(known.select(F.col("time_series_id").alias("series_id"), F.col("type").alias("_type")), "series_id").filter("type <> _type").select("series_id", "type")
            with held(wrong):
                return self._take(points, order, part, total, repeated, wrong)

    def _take(self, points: DataFrame, order: list[str], part: str, total: int, repeated: DataFrame, wrong: DataFrame) -> dict[str, int]:
        stored = self._stored_keys(points, part)
        new = points.withColumnRenamed("series_id", "time_series_id")
        if stored is None and repeated.isEmpty() and wrong.isEmpty():
            self._change("time_series_data", new, part)
            self.refuse(None, part)
            return {"new": total}
        fates = self.fates(points, order, repeated, wrong, stored)
        with held(fates):
            counts = {r["fate"]: r["count"] for r in fates.groupBy("fate").count().collect()}
            self._change("time_series_data", fates.filter("fate = 'new'").withColumnRenamed("series_id", "time_series_id"), part)
            refused = fates.filter("fate IN ('duplicate', 'type')") if counts.get("duplicate") or counts.get("type") else None
            self.refuse(refused.withColumnRenamed("fate", "reason") if refused is not None else None, part)
        return counts

    def refuse(self, rows: DataFrame | None, part: str) -> None:
        """What can't be stored, with its ``reason``, as a part of the quarantine in place of what it held."""
        if rows is None:
            if any(p.name == part for p in self.listing("quarantine").parts):
                self._change("quarantine", name=part)
            return
        wanted = [c.split() for c in STORE["quarantine"].split(", ")]
        has = {**{c: F.col(c) for c in rows.columns}, "time_series_id": F.col("series_id") if "series_id" in rows.columns else F.lit(None), "part": F.lit(part)}
        self._change("quarantine", rows.select(*[has.get(c, F.lit(None)).cast(k).alias(c) for c, k in wanted]), part)

    def account(self, kind: str, part: str, **counts: int) -> None:
        """A batch's account in place of an earlier one of the same part."""
        schema = STORE["accounts"]
        row = {"kind": kind, "part": part, **counts}
        self._change("accounts", self.spark.range(1).select(*[F.lit(row.get(c.split()[0], 0)).alias(c.split()[0]) for c in schema.split(", ")]), part)

    @property
    def quarantine(self) -> DataFrame:
        return self.table("quarantine")

    @property
    def accounts(self) -> DataFrame:
        return self.table("accounts")


def _hinted(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast where they are few."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def summarised(rows: DataFrame) -> DataFrame:
    """Counts and bounds of each series of rows of the points' table."""
    v = value_num()
    return rows.groupBy("time_series_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("xmin"), F.max("ts").alias("xmax"), F.min(v).alias("ymin"), F.max(v).alias("ymax"))


@contextmanager
def held(df: DataFrame) -> Iterator[None]:
    """``df`` kept (in memory, else on disk) while several jobs read it."""
    kept = df.storageLevel.useMemory or df.storageLevel.useDisk or df.isStreaming
    if not kept:
        df.persist()
    try:
        yield
    finally:
        if not kept:
            df.unpersist()


class ForeignStore(FlowTables):
    """The four tables of a SQL store, read through JDBC and given the columns of a ``FlowStore``. A table is read in
    ranges of its key, points in ranges of their times, of about ``rows_per_split`` rows each if keys are evenly spread;
    Spark adds a look-up's own conditions to each range's."""

    def __init__(self, spark: SparkSession, url: str, rows_per_split: int = 1_000_000, max_splits: int = 10_000, **options):
        self.spark, self.options, self.rows_per_split, self.max_splits = spark, options, rows_per_split, max_splits
        suffix = url.rsplit(".", 1)[-1]
        self.url = url if url.startswith("jdbc:") else f"jdbc:{'sqlite' if suffix == 'sqlite' else 'duckdb'}:{url}"

    def raw_table(self, name: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(url=self.url, **self.options)
        whole = reader.option("dbtable", name).load()
        predicates = self._ranges(name, whole)
        return self.spark.read.jdbc(self.url, name, predicates=predicates, properties={k: str(v) for k, v in self.options.items()}) if predicates else whole

    def _ranges(self, name: str, whole: DataFrame) -> list[str]:
        """Conditions that part a table's rows, from the ends of a column that it has its rows by; none for a small one."""
        wanted = {"time_series_data": ("timestamp", "ts"), "time_series": ("time_series_id", "id")}.get(name, ("id",))
        column = next((c for c in wanted if c in whole.columns), None)
        if column is None:
            return []
        # Numbers that the store works out; no row is read.
        low, high, n = whole.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        splits = min(self.max_splits, -(-n // self.rows_per_split))
        if splits < 2 or low is None or low == high:
            return []
        c = self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(column)
        whole_numbers = isinstance(low, int)
        at = lambda i: low + ((high - low) * i // splits if whole_numbers else (high - low) * i / splits)
        bounds = sorted({at(i) for i in range(1, splits)} - {low})
        literal = str if whole_numbers else lambda x: f"{x:.17E}"
        inner = [f"{c} >= {literal(a)} AND {c} < {literal(b)}" for a, b in zip(bounds, bounds[1:])]
        return [f"{c} < {literal(bounds[0])} OR {c} IS NULL", *inner, f"{c} >= {literal(bounds[-1])}"]

    def table(self, name: str) -> DataFrame:
        """A table by its name in ``STORE``. Values may lie in a column for each type, of which the one that ``type``
        names counts and the others hold a stand-in, or in one column of text; times are in ``timestamp``."""
        rows = self.raw_table(name)
        if "timestamp" in rows.columns:
            rows = rows.withColumnRenamed("timestamp", "ts")
        wanted = [c.split() for c in STORE[name].split(", ")]
        own = dict(zip(VALUE_COLUMNS, ("value_integer", "value_float", "value_boolean", "value_text"), strict=True))

        def cell(column: str, kind: str) -> Column:
            if column in own:
                source = own[column] if own[column] in rows.columns else "value"
                found = F.col(source)
                return F.when(F.col("type") == VALUE_COLUMNS.index(column), found.cast("int").cast(kind) if column == "value_bool" and source != "value" else found.cast(kind))
            return F.col(column).cast(kind) if column in rows.columns else F.lit(None).cast(kind)

        return rows.select(*[cell(c, k).alias(c) for c, k in wanted])


def complete_series(series: DataFrame, names: list[str]) -> DataFrame:
    """Series of these names, of the flows that have them all."""
    named = series.filter(F.col("name").isin(names))
    whole = named.groupBy("flow_id").agg(F.count_distinct("name").alias("n")).filter(F.col("n") == len(set(names)))
    return named.join(whole, "flow_id", "left_semi")


class Selection:
    """The series chosen for a chart."""

    def __init__(self, ids: list[int] | None = None):
        self.ids = list(dict.fromkeys(ids or []))

    def contains(self, id: int) -> bool:
        return id in self.ids

    def add(self, id: int) -> Selection:
        return Selection([*self.ids, id])

    def remove(self, id: int) -> Selection:
        return Selection([i for i in self.ids if i != id])


def scratch_store(spark: SparkSession) -> FlowStore:
    """An empty store under the folder that driver and executors share."""
    from flowseries.sources.shared import shared_path

    return FlowStore(spark, shared_path(spark, f"store-{uuid.uuid4().hex}"))
