"""SimHash near-duplicate detection with pivot distance tables.

Fingerprints: 64 bits over word shingles; a bit is 1 if it is set in over half of the shingles' XXH64 values.

Table: each distinct fingerprint's Hamming distances to the reference fingerprints ``PIVOTS``, written once. There is
a base reference, and ``BLOCK_PIVOTS`` more for each of five blocks of bits that are the base but for that block. A
distance less the base's distance depends on the block's bits alone, so it is equal where two fingerprints' blocks
are.

Proposals: two differing bits leave three of five blocks alike, so each linked pair agrees on three blocks' columns
of the table in one of ten choices; such cells are the join keys. Cells of up to ``bucket_pairs`` members propose
their pairs. In a larger cell (a large group of near copies) further pivots of its own stand in, every fingerprint one
bit from a member outside the cell's blocks: members within one bit of the same pivot are two bits apart at most. Each
such pivot has 65 members at most and proposes a star to its smallest, so rows stay linear in the cell.

Discarding: by the triangle inequality a pair at distance d differs by at most d in every column, so proposals with a
larger maximum coordinate difference go. The rest are verified on the bits. ``proposal_counts`` tells how many.

Components: alternating large-star and small-star rounds over distinct fingerprints, each round a written table.
Exact copies share one fingerprint and are never expanded into pairs.

Defined results: a null text is an empty one; texts without words have fingerprint zero, linked like any other; texts
of any length are hashed whole; repeated rows of one ``doc_id`` each appear with the same component, and equal
fingerprints are one however many rows have them; a null ``doc_id`` gets its group's component (the smallest id that
isn't null, or null); an empty table gives none; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseries.llm.batches import fresh, sliced
from flowseries.llm.ranges import let
from flowseries.llm.scratch import delete, stored, written

SEED = 42
#: Linked fingerprints differ in so many bits at most; blocks and large cells' pivots rest on its being 2.
MAX_BITS = 2
#: Blocks of bits: two differing bits leave three of five alike.
_EDGES = [round(64 * i / (MAX_BITS + 3)) for i in range(MAX_BITS + 4)]
BLOCKS = tuple(((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES, _EDGES[1:], strict=False))
#: References for each block: their distances tell nearly all patterns of its 12 or 13 bits apart.
BLOCK_PIVOTS = 8


def _pattern(i: int) -> int:
    return xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED)


#: The reference fingerprints: XXH64 of 0, then for each block that with the block's bits of XXH64 of 1, 2 and so on.
PIVOTS = (_pattern(0), *(_pattern(0) & ~m | _pattern(1 + k * BLOCK_PIVOTS + r) & m for k, m in enumerate(BLOCKS) for r in range(BLOCK_PIVOTS)))
_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(raw: bytes | None, shingle: int) -> int:
    """Fingerprint of one text, as a signed 64-bit number."""
    words = (raw or b"").lower().split()  # bytes: A-Z only, and splits at ASCII white space only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)]
        ones += _ones(np.array(part, dtype="<u8"))
    return _majority(ones, len(starts))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)


def _majority(ones: np.ndarray, n: int) -> int:
    return _signed(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def folded(hashes: np.ndarray) -> int:
    """Fingerprint of the hashes of a text's shingles, as a signed 64-bit number; of none it is zero."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += _ones(hashes[at : at + _CHUNK])
    return _majority(ones, len(hashes))


def text_hash() -> Column:
    """With its id, what tells a row from others."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` (longs) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = pa.array([simhash(raw, shingle) for raw in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "text_hash", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash().alias("text_hash"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {id_type}, text_hash long, fp long")


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp, pivots``: the distances of each ``fp`` to the reference fingerprints."""
    return fps.select("fp", F.array(*[_near(F.col("fp"), F.lit(_signed(p))).cast("tinyint") for p in PIVOTS]).alias("pivots"))


_CHOICES = list(combinations(range(len(BLOCKS)), 3))


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _cells(pivots: Column) -> Column:
    """The ten cells of a row of the table, one for each choice of three blocks, as hashes of the blocks' columns."""
    column = lambda i: pivots[i] - pivots[0]
    blocks = [F.xxhash64(*[column(1 + k * BLOCK_PIVOTS + r) for r in range(BLOCK_PIVOTS)]) for k in range(len(BLOCKS))]
    return let(F.array(*blocks), lambda h: F.array(*[F.xxhash64(h[a], h[b], h[c]) for a, b, c in _CHOICES]))


def proposals(table: DataFrame, bucket_pairs: int = 64) -> DataFrame:
    """Pairs ``a < b`` of fingerprints that share a cell of the ``table`` (fp, pivots), with their rows of the table
    as ``pa`` and ``pb``; in a large cell, stars around its own pivots instead of all pairs."""
    keyed = table.select("fp", F.posexplode(_cells(F.col("pivots"))).alias("choice", "cell"))
    sizes = keyed.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = keyed.join(sizes, ["choice", "cell"])

    small = met.filter(F.col("members") <= bucket_pairs).groupBy("choice", "cell").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    first = small.select("fps", F.posexplode("fps").alias("at", "a"))
    pairs = first.select("a", F.explode(F.expr("slice(fps, at + 2, size(fps))")).alias("b"))

    masks = [BLOCKS[a] | BLOCKS[b] | BLOCKS[c] for a, b, c in _CHOICES]
    outside = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    large = met.filter(F.col("members") > bucket_pairs).select("fp", F.explode(F.get(outside, F.col("choice"))).alias("flip"))
    own = large.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("pivot")).groupBy("pivot").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = own.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")

    row = lambda c, p: table.select(F.col("fp").alias(c), F.col("pivots").alias(p))
    return pairs.unionByName(stars).distinct().join(row("a", "pa"), "a").join(row("b", "pb"), "b")


def _apart(pa_: Column, pb: Column) -> Column:
    """The largest coordinate difference of two rows of the table."""
    return F.array_max(F.zip_with(pa_, pb, lambda x, y: F.abs(x - y)))


def links(table: DataFrame, bucket_pairs: int = 64) -> DataFrame:
    """Links ``a < b`` between the fingerprints of the pivot ``table``: every pair at ``MAX_BITS`` or fewer differing
    bits is linked, directly or, in a large cell, through the smallest fingerprint near the same pivot."""
    near = proposals(table, bucket_pairs).filter(_apart(F.col("pa"), F.col("pb")) <= MAX_BITS)
    return near.filter(_near(F.col("a"), F.col("b")) <= MAX_BITS).select("a", "b")


def proposal_counts(table: DataFrame, bucket_pairs: int = 64) -> DataFrame:
    """One row: pairs ``proposed`` by the table's cells, ``discarded`` by the maximum coordinate difference, and
    ``verified`` on the bits."""
    near = _apart(F.col("pa"), F.col("pb")) <= MAX_BITS
    linked = near & (_near(F.col("a"), F.col("b")) <= MAX_BITS)
    return proposals(table, bucket_pairs).agg(F.count(F.lit(1)).alias("proposed"), F.count_if(~near).alias("discarded"), F.count_if(linked).alias("verified"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``edges`` (a, b) the smallest node that it reaches. Alternating large-star
    and small-star rounds; nodes and edges stay on the executors, one count comes back each round."""
    spark = edges.sparkSession
    edges, path = stored(edges.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x <> y").distinct()
        before_path = path
        edges, path = stored(small.select(F.col("x").alias("a"), F.col("y").alias("b")), "edges")
        delete(spark, before_path)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``: the smallest ``doc_id`` reachable over links."""
    return _placed(docs, shingle).select("doc_id", "fp", "component_id")


def _placed(docs: DataFrame, shingle: int) -> DataFrame:
    marks = written(fingerprints(docs, shingle), "simhash")
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    groups = components(links(written(pivot_table(distinct), "simhash-pivots")))
    rooted = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def kept_rows(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``placed`` (doc_id, text_hash, component_id) has as their component's smallest id."""
    names = fresh(docs, "kept_id", "kept_text")
    kept = placed.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(names[0])) & (text_hash() == F.col(names[1])), "left_semi")


def one_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents that are their component's smallest ``doc_id``, with all columns of ``docs``; of repeated rows
    of that id in one component all stay. Rows are told apart by id and text."""
    return kept_rows(docs, _placed(docs, shingle))
