"""Near copies by SimHash and by exact Jaccard similarity of word shingles, for the pipeline.

Texts whose sets of shingles are equal are joined first. (A shingle or a set stands for itself as XXH64.)

SimHash: each set has a fingerprint; the pivot distance table of all fingerprints proposes pairs, discards and verifies
them as in ``simhash``, and those are linked whose sets have a Jaccard similarity of ``LEAST`` or more.

The rest: such sets may be more bits apart than SimHash's keys allow, so an exact search links what is left between the
components that SimHash gave; of no two sets at ``LEAST`` or more the link depends on a sketch.

Discarding: of two such sets at most ``n - ceil(LEAST * n)`` shingles of either lie outside the other. In the order of
hashes a longer prefix than that therefore shares shingles with the other's; a set whose prefix shares too few with
any other set has no near copy. The rest, few in an ordinary corpus, meet under the rarest shingles of theirs.

Large groups: under each shingle the members are first compared with one of them only, its pivot, the one with the
fewest shingles of its own. What two members share is part of what both share with the pivot, or lies outside it, so
the table of what members share with pivots bounds each pair, and pairs are made only where members of different
components are left and the bound allows ``LEAST``: two that are both too far from a pivot of their length aren't.
Members are still held against each other by these numbers; none is dropped.

Defined results: a null text is an empty one, texts without words are copies of each other, and one of less than five
words has a single shingle; texts of any length count whole; repeated rows of an id are copies, each a row; an empty
table gives none; other columns stay; ids as in ``simhash``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseries.llm.batches import sliced
from flowseries.llm.scratch import written
from flowseries.llm.simhash import SEED, components, folded, kept_rows, pivot_table, text_hash
from flowseries.llm.simhash import links as fingerprint_links

SHINGLE = 5
LEAST = 0.8
#: Share of a set by which its prefix is longer than need be; so much of it, by LEAST, must be shared.
_MORE = 0.1
_FLAGS = 1 << 23
_MEMBERS = 512
_SEEN = 1 << 16


def shingle_set(raw: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    words = (raw or b"").lower().split()
    k = min(SHINGLE, len(words))
    if not k:
        return np.empty(0, dtype=np.int64)
    joined = memoryview(b" ".join(words))
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)), dtype=np.uint64, count=len(starts))
    return np.unique(hashes.view(np.int64))


def _outside(n: int) -> int:
    """Shingles of a set of ``n`` that a set at ``LEAST`` or more may lack."""
    return n - math.ceil(LEAST * n - 1e-9)


def _key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def marks(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, key, n, probe, fp`` for every row: the set's own hash, its size, its prefix, its fingerprint.
    A set that its task has seen before has neither of the last again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            keys, sizes, probes, fps = [], [], [], []
            for raw in batch.column(2).to_pylist():
                hashes = shingle_set(raw)
                key, n = _key(hashes), len(hashes)
                keys.append(key)
                sizes.append(n)
                probes.append(None if key in seen else hashes[: _outside(n) + math.ceil(_MORE * n)])
                fps.append(None if key in seen else folded(hashes))
                if len(seen) < _SEEN:
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(probes, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "key", "n", "probe", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash().alias("text_hash"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {id_type}, text_hash long, key long, n long, probe array<long>, fp long")


def _flag(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(_FLAGS))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, hashes`` of the ``wanted`` sets (key, first_id). Rows are picked by flags of ``_FLAGS`` bits at most, so
    texts aren't shuffled; the join on ``key`` then leaves exactly those wanted."""
    at = _flag("first_id")
    rows = wanted.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(first_id), 64) as int))")).alias("bits")).collect()
    flags = np.zeros(_FLAGS >> 6, dtype=np.int64)
    flags[[r["at"] for r in rows]] = [r.bits for r in rows]
    packed = docs.sparkSession.sparkContext.broadcast(flags.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked, seen = np.frombuffer(packed.value, dtype=np.uint8), set()
        for batch in sliced(batches):
            at = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((picked[at >> 3] >> (at & 7) & 1).astype(bool)))
            keys, found = [], []
            for raw in batch.column(1).to_pylist():
                hashes = shingle_set(raw)
                key = _key(hashes)
                if key not in seen:
                    keys.append(key)
                    found.append(hashes)
                if len(seen) < _SEEN:
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["key", "hashes"])

    picked = docs.select(_flag("doc_id").alias("at"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "key long, hashes array<long>")
    return picked.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("hashes").alias("hashes"))


def _like(shared: Column, a: Column, b: Column) -> Column:
    return shared >= F.lit(LEAST) * (a + b - shared) - 1e-9


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``shared``, the number of shingles in both sets, and the sets' sizes ``na`` and ``nb``."""
    one = sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(two, "b").join(one, "a")
    return both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("shared"), F.size("ha").alias("na"), F.size("hb").alias("nb"))


def _linked(compared_pairs: DataFrame) -> DataFrame:
    return compared_pairs.filter(_like(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b")


def simhash_links(distinct: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between ``sets`` (key, hashes) at ``LEAST`` or more that the fingerprints of ``distinct`` (key, fp)
    propose. Of sets with one fingerprint the smallest stands for the others, which are held against it."""
    near = fingerprint_links(written(pivot_table(distinct.select("fp").distinct()), "near-table"))
    lowest = distinct.groupBy("fp").agg(F.min("key").alias("low"))
    alike = distinct.join(lowest, "fp").filter("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))
    side = lambda c: lowest.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low"))
    pairs = near.join(side("a"), "a").join(side("b"), "b").select(F.col("a_low").alias("a"), F.col("b_low").alias("b"))
    return _linked(compared(pairs.unionByName(alike), sets))


def links(sets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between ``sets`` (key, hashes) whose components are those of all pairs at ``LEAST`` or more. Sets
    that ``known`` links join already aren't held against each other again, but under a pivot."""
    tokens = sets.select("key", F.size("hashes").cast("long").alias("n"), F.explode("hashes").alias("h"))
    often = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = tokens.join(often, "h").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("common"))
    ranked = ranked.withColumn("own", F.col("n") - F.size("common"))
    room = (F.col("n") - F.ceil(F.lit(LEAST) * F.col("n") - 1e-9) + 1 - F.col("own")).cast("int")
    met = ranked.filter(room > 0).select("key", "n", "own", F.explode(F.slice("common", F.lit(1), room)["h"]).alias("h"))
    met = written(met, "near-met")
    pivots = met.groupBy("h").agg(F.min(F.struct("own", "key"))["key"].alias("pivot"))
    met = written(met.join(pivots, "h"), "near-placed")

    stars = met.filter("pivot <> key").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    table = written(compared(stars, sets), "near-pivots")
    near = _linked(table) if known is None else _linked(table).unionByName(known)
    groups = components(near)
    left = met.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = left.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h")
    left = left.join(several, "h", "left_semi").join(table.select(F.col("a").alias("pivot"), F.col("b").alias("key"), "shared"), ["pivot", "key"], "left")
    # Shingles shared with the pivot, and those outside it that some other set has.
    left = left.withColumn("inside", F.coalesce("shared", "n")).withColumn("outside", F.col("n") - F.col("own") - F.col("inside"))
    # Members that share a shingle share its pivot, so each pair is made once for a pivot, not for every shingle.
    left = written(left.select("pivot", "key", "root", "n", "inside", "outside").distinct(), "near-left")
    # A large pivot's members are dealt over several tasks: one side by its hash, the other to all.
    sizes = left.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).cast("int").alias("parts"))
    side = lambda s, part: left.join(sizes, "pivot").select("pivot", part.alias("part"), *[F.col(c).alias(f"{s}_{c}") for c in ("key", "root", "n", "inside", "outside")])
    x, y = side("x", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")), side("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    most = F.least("x_inside", "y_inside") + F.least("x_outside", "y_outside")
    pairs = x.join(y, ["pivot", "part"]).filter("x_key < y_key AND x_root <> y_root").filter(_like(most, F.col("x_n"), F.col("y_n")))
    return near.unionByName(_linked(compared(pairs.select(F.col("x_key").alias("a"), F.col("y_key").alias("b")).distinct(), sets)))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, key, component_id`` for every row of ``docs``: the smallest ``doc_id`` reachable over links."""
    return _placed(docs).select("doc_id", "key", "component_id")


def _placed(docs: DataFrame) -> DataFrame:
    rows = written(marks(docs), "near-marks")
    distinct = written(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("fp").alias("fp")), "near-distinct")
    probes = rows.select("key", "n", F.explode("probe").alias("h"))
    shared = probes.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("h")
    hits = probes.join(shared, "h").groupBy("key", "n").agg(F.count(F.lit(1)).alias("hits"))
    wanted = hits.filter(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.lit(_MORE * LEAST) * F.col("n")))).select("key")
    wanted = written(distinct.drop("fp").join(wanted, "key", "left_semi"), "near-wanted")
    sets = written(sets_of(docs, wanted), "near-sets")
    groups = components(links(sets, written(simhash_links(distinct, sets), "near-proposed")))
    rooted = distinct.drop("fp").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("key", "component_id")
    return rows.select("doc_id", "text_hash", "key").join(named, "key").select("doc_id", "text_hash", "key", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are their component's smallest ``doc_id``, with all columns of ``docs``; of repeated rows
    of that id in one component all stay. Rows are told apart by id and text, so what becomes of a group doesn't
    depend on rows of the same id, or of none, in another one."""
    return kept_rows(docs, _placed(docs))
