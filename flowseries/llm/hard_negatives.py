"""Hard negatives: for each anchor and each of its nearest rows of the same label, the rows of other labels that score
highest inside a window below that positive's score. Scores are exact integer inner products.

Kronecker packing: components are biased so that none is negative, and several candidates' biased components go into
separated fields of one integer below 2^53, wide enough for a whole inner product each. One multiplication by an
anchor's component then serves all of them; as no field overflows, the fields of the sum are the exact inner products
once the bias is taken off. Integers below 2^53 are exact in doubles in any order of addition, so the products are
matrix products. How many fit is worked out for each block from its own largest components; where not even one does,
Python's integers take over.

Anchors are the stated query set and go over all rows in blocks: a block of anchors, bounded in bytes, is broadcast,
and tasks hold their rows against it slice by slice, keeping only the best for each anchor. Two passes for each block:
one for positives, one for negatives, whose windows follow from the positives. Only what tasks kept is shuffled.

Defined results: rows with a null label, a null vector or any component that is null or not finite take no part; a
shorter vector counts as filled up with zeros; ties go by smaller id, null ids last, then by row; a repeated row is a
row of its own (an anchor's own row is never its positive, an equal one may be); scores beyond 2^55 either way are held
there; other columns are ignored, whatever their names; without anchors or positives there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowseries.llm.scratch import new_path, written

SCALE = 256
#: Bytes of an anchor block's components, and cells of one slice's products.
BLOCK_BYTES = 16 << 20
CELLS = 1 << 21
_HELD = 1 << 55
_NO_ID = np.iinfo(np.int64).max
#: Rows with larger components go apart, so that they don't widen the others' fields.
_USUAL = 1 << 12


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: (anchors, rows)."""
    if not len(anchors) or not len(rows) or not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    low_a, low_r = int(anchors.min()), int(rows.min())
    top_a, top_r = int(anchors.max()) - low_a, int(rows.max()) - low_r
    d = anchors.shape[1]
    bits = (d * max(top_a, 1) * max(top_r, 1)).bit_length()
    fields = 53 // bits
    if not fields:
        exact = anchors.astype(object) @ rows.T.astype(object)
        return np.clip(exact, -_HELD, _HELD).astype(np.int64)
    a, r = anchors - low_a, rows - low_r
    n = -(-len(r) // fields)
    wide = np.zeros((n, d), dtype=np.int64)
    for k in range(fields):
        part = r[k * n : (k + 1) * n]
        wide[: len(part)] += part << (k * bits)
    sums = (a.astype(np.float64) @ wide.astype(np.float64).T).astype(np.int64)
    out = np.hstack([(sums >> (k * bits)) & ((1 << bits) - 1) for k in range(fields)])[:, : len(r)]
    bias = low_r * a.sum(axis=1)[:, None] + low_a * r.sum(axis=1)[None, :] + d * low_a * low_r
    return np.clip(out + bias, -_HELD, _HELD)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``packed_products`` with rows and anchors of unusually large components in products of their own."""
    usual = lambda x: np.abs(x).max(axis=1, initial=0) <= _USUAL
    a, r = usual(anchors), usual(rows)
    if a.all() and r.all():
        return packed_products(anchors, rows)
    out = np.empty((len(anchors), len(rows)), dtype=np.int64)
    for x in (a, ~a):
        for y in (r, ~r):
            out[np.ix_(x, y)] = packed_products(anchors[x], rows[y])
    return out


class Best:
    """The first ``k`` candidates of each of ``n`` lists, by score, id and row."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, np.zeros((4, 0), dtype=np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, lists: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        if not len(lists):
            return
        everything = np.hstack([self.rows, np.stack([lists, score, id, row])])
        everything = everything[:, np.lexsort((everything[3], everything[2], -everything[1], everything[0]))]
        first = np.searchsorted(everything[0], everything[0])
        rank = np.arange(everything.shape[1]) - first
        self.rows = everything[:, rank < self.k]
        full = self.rows[:, (rank[rank < self.k]) == self.k - 1]
        self.least[full[0]] = full[1]


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Lists of integers as rows of one width; what is missing is zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dimensions).all():
        return flat.reshape(len(lengths), dimensions)
    out = np.zeros((len(lengths), dimensions), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _slices(batches: Iterator[pa.RecordBatch], dimensions: int, n_anchors: int, labels: list[str]) -> Iterator[tuple]:
    """Rows, ids, components and label numbers (-1: no anchor's) of slices whose products stay within ``CELLS``."""
    import pyarrow.compute as pc

    known = pa.array(labels, pa.string())
    most = max(16, CELLS // max(1, n_anchors))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            ids = part.column(1).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            codes = pc.index_in(part.column(2), known).fill_null(-1).to_numpy(zero_copy_only=False)
            yield part.column(0).to_numpy(zero_copy_only=False), ids, _matrix(part.column(3), dimensions), codes


_FOUND = "_anchor long, _row long, _id long, _score long"


def _emitted(anchor_rows: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    lists, score, id, row = found
    return pa.RecordBatch.from_arrays([pa.array(anchor_rows[lists]), pa.array(row), pa.array(id, mask=id == _NO_ID), pa.array(score)], names=["_anchor", "_row", "_id", "_score"])


def _positives(rows: DataFrame, block, dimensions: int, k: int) -> DataFrame:
    """For each anchor of ``block`` what each task finds to be its first ``k`` other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_rows, anchors, codes, labels, _ = block.value
        best = Best(len(own_rows), k)
        for row, id, values, code in _slices(batches, dimensions, len(own_rows), labels):
            s = products(anchors, values)
            a, c = np.nonzero((codes[:, None] == code[None, :]) & (s >= best.least[:, None]))
            other = own_rows[a] != row[c]
            a, c = a[other], c[other]
            best.add(a, s[a, c], id[c], row[c])
        yield _emitted(own_rows, best.rows)

    return rows.mapInArrow(run, _FOUND)


def _negatives(rows: DataFrame, block, dimensions: int, k: int, low: int, high: int) -> DataFrame:
    """For each anchor and each of its positives' scores what each task finds to be its first ``k`` rows inside the
    window; a row that several windows of an anchor want comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_rows, anchors, codes, labels, scores = block.value
        width = scores.shape[1]
        there = scores > np.iinfo(np.int64).min
        p = np.where(there, scores, 0)
        least, most = -(-(low * p) // 100), (high * p) // 100
        least, most = np.where(there, least, 1), np.where(there, most, 0)
        best = [Best(len(own_rows), k) for _ in range(width)]
        for row, id, values, code in _slices(batches, dimensions, len(own_rows), labels):
            s = products(anchors, values)
            from_ = np.stack([np.maximum(least[:, j], best[j].least) for j in range(width)], axis=1)
            open_ = from_ <= most
            lowest = np.where(open_, from_, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            highest = np.where(open_, most, np.iinfo(np.int64).min).max(axis=1, initial=np.iinfo(np.int64).min)
            a, c = np.nonzero((s >= lowest[:, None]) & (s <= highest[:, None]) & (codes[:, None] != code[None, :]))
            score = s[a, c]
            for j in range(width):
                fits = (score >= from_[a, j]) & (score <= most[a, j])
                best[j].add(a[fits], score[fits], id[c[fits]], row[c[fits]])
        if width:
            yield _emitted(own_rows, np.unique(np.hstack([b.rows for b in best]), axis=1))

    return rows.mapInArrow(run, _FOUND)


def usable(rows: DataFrame, id: str, label: str, vector: str, scale: int) -> DataFrame:
    """``_row, _id, _label, _values`` of the rows that take part; ``_row`` tells rows apart."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & good)
    return kept.select(F.monotonically_increasing_id().alias("_row"), F.col(id).cast("long").alias("_id"), F.col(label).cast("string").alias("_label"), F.transform(vector, whole).alias("_values"))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row where ``anchors``
    (of ``id``) holds and each of its first ``positives`` rows of the same label the first ``negatives`` rows of other
    labels that score from ``low`` to ``high`` hundredths of the positive's score."""
    spark = rows.sparkSession
    all_rows = written(usable(rows, id, label, vector, scale), "vectors")
    chosen = all_rows.withColumn(id, F.col("_id")).filter(anchors).drop(id)
    n, dimensions = chosen.agg(F.count(F.lit(1)), F.lit(0)).first()[0], all_rows.agg(F.coalesce(F.max(F.size("_values")), F.lit(0))).first()[0]
    a_block = max(16, BLOCK_BYTES // (8 * max(1, dimensions)))
    n_blocks = -(-n // a_block)
    chosen = written(chosen.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(max(1, n_blocks)))), "anchors")
    path = new_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    first = [F.col("_score").desc(), F.col("_id").asc_nulls_last(), F.col("_row")]
    for b in range(n_blocks):
        table = chosen.filter(F.col("_block") == b).toArrow()
        own_rows, labels = table["_row"].to_numpy(), sorted(set(table["_label"].to_pylist()))
        codes = np.array([labels.index(x) for x in table["_label"].to_pylist()], dtype=np.int64)
        values = _matrix(table["_values"], dimensions)
        shared = spark.sparkContext.broadcast((own_rows, values, codes, labels, np.zeros((len(own_rows), 0), dtype=np.int64)))
        w = Window.partitionBy("_anchor").orderBy(*first)
        found = _positives(all_rows, shared, dimensions, positives).withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= positives)
        # At most ``positives`` rows for each anchor of the block.
        of_block = found.toArrow()
        shared.unpersist()
        scores = np.full((len(own_rows), positives), np.iinfo(np.int64).min)
        place = {r: i for i, r in enumerate(own_rows.tolist())}
        scores[[place[r] for r in of_block["_anchor"].to_pylist()], of_block["_p"].to_numpy() - 1] = of_block["_score"].to_numpy()
        shared = spark.sparkContext.broadcast((own_rows, values, codes, labels, scores))
        pairs = spark.createDataFrame(of_block).select("_anchor", "_p", F.col("_id").alias("_positive"), F.col("_score").alias("_above"))
        ids = chosen.filter(F.col("_block") == b).select(F.col("_row").alias("_anchor"), F.col("_id").alias("anchor_id"))
        near = _negatives(all_rows, shared, dimensions, negatives, low, high).join(pairs.join(ids, "_anchor"), "_anchor")
        near = near.filter((F.col("_score") * 100 >= F.col("_above") * low) & (F.col("_score") * 100 <= F.col("_above") * high))
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("_anchor", "_p").orderBy(*first))).filter(F.col("rank") <= negatives)
        near.select("anchor_id", F.col("_positive").alias("positive_id"), "rank", F.col("_id").alias("negative_id"), F.col("_above").alias("positive_score"), F.col("_score").alias("negative_score")).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(schema).parquet(path) if n_blocks else spark.createDataFrame([], schema)


def mine_embeddings(rows: DataFrame) -> DataFrame:
    """``mine`` over the embeddings table, where ids divisible by 100 are anchors and every seventh id's label is off
    by one."""
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", flipped.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
