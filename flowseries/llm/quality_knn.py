"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms of a text: its words (letters, lower case), hashed into ``_WORD_TERMS`` bins; trigrams of byte classes; and bins
of its shape (share of distinct words, share of repeated 3-word windows, repeated lines, words by length), each as a
term of its own. Words and classes weigh the same as wholes. A bounded sample of labelled documents fits term weights
and a truncated singular value decomposition on the driver; their vectors and labels are broadcast. Every document's
vector is compared with all of them by exact cosine products, block by block, and the labels of the ``neighbours``
most similar ones are averaged with weights ``similarity ** power``.

Scores don't depend on which documents share a block: blocks are filled up to one size, products are in double
precision, cosines are rounded to ten digits, and of equally similar voters those with smaller ids count.

Bounds: ``max_labelled`` documents fit the model and vote (lowest hashes of their ids, so they spread over the
labelled rows; of repeated rows of one id the smallest text), so no more than that come to the driver; terms and
dimensions are fixed. All documents are scored, over their whole texts.

Defined results: null text is empty; a text of fewer than three bytes has no terms, so no neighbours, and gets the
share of label 1 among the voters; without labelled rows every score is 0.5; of several labels of one id the highest
counts; null ids are never labelled and not held out; texts of any length count whole; repeated rows are scored alike;
an empty table gives none; extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseries.llm.batches import sliced

_N_CLASSES = 12
_SHAPE_BINS = 12
_SHAPES = 5
_WORD_TERMS = 1 << 11
_TRIGRAMS = _N_CLASSES**3
_SHAPE_AT = _TRIGRAMS + _SHAPES * _SHAPE_BINS
N_TERMS = _SHAPE_AT + _WORD_TERMS
_BLOCK = 256
_DIGITS = 10
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))

_CLASS = np.full(256, 11, dtype=np.int16)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"#*$%&", b"|<>", b"'\"()-_/=@+")):
    _CLASS[[*_chars]] = _k


@dataclass(frozen=True)
class KnnModel:
    """Term weights, projection, and the voters' unit vectors and labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float


def _bin(share: float) -> int:
    return min(_SHAPE_BINS - 1, int(share * _SHAPE_BINS))


def term_counts(raw: bytes | None) -> np.ndarray:
    """Counts of a text's terms; a shape's bin counts as much as a tenth of the trigrams."""
    raw = raw or b""
    out = np.zeros(N_TERMS, dtype=np.float32)
    if len(raw) < 3:
        return out
    c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    codes = c[:-2] * (_N_CLASSES * _N_CLASSES) + c[1:-1] * _N_CLASSES + c[2:]
    out[:_TRIGRAMS] = np.bincount(codes, minlength=_TRIGRAMS)
    words = raw.split()
    if words:
        n = len(words)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        lines = [x for x in raw.split(b"\n") if x]
        shapes = (
            len(set(words)) / n,
            1 - len(windows) / max(1, n - 2) if n > 2 else 0.0,
            1 - len(set(lines)) / max(1, len(lines)),
            len(raw) / n / 24,
            np.log2(n) / 16,
        )
        weight = max(1.0, len(codes) / 10)
        for k, share in enumerate(shapes):
            out[_TRIGRAMS + k * _SHAPE_BINS + _bin(share)] = weight * (1 if k < 3 else 0.25)
    named = Counter(raw.translate(_LETTERS).lower().split())
    for word, n in named.items():
        out[_SHAPE_AT + zlib.crc32(word) % _WORD_TERMS] += n
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights of unit length; words together weigh as much as all other terms."""
    x = np.log1p(counts.astype(np.float64)) * idf
    return np.hstack([_unit(x[:, :_SHAPE_AT]), _unit(x[:, _SHAPE_AT:])]) / np.sqrt(2)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _packed(counts: np.ndarray) -> bytes:
    """Places and counts of the terms that a text has."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes()


def _unpacked(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packed), N_TERMS), dtype=np.float32)
    for row, raw in zip(out, packed, strict=True):
        n = len(raw) // 6
        row[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, dimensions: int = 48, neighbours: int = 15, power: float = 4.0) -> KnnModel:
    """Fit on ``max_labelled`` of the labelled documents that aren't held out."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("raw").alias("raw"), F.max("quality").alias("quality"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            packed = [_packed(term_counts(raw)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["doc_id", "terms", "quality"])

    # At most ``max_labelled`` rows.
    found = sorted(rows.mapInArrow(terms, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, terms binary, quality int").collect())
    if not found:
        return KnnModel(np.ones(N_TERMS), np.zeros((N_TERMS, 1)), np.zeros((0, 1)), np.zeros(0), neighbours, power)
    counts = _unpacked([r[1] for r in found])
    labels_of = np.array([r[2] for r in found], dtype=np.float64)
    del found
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    x = np.empty(counts.shape)
    for at in range(0, len(x), _BLOCK):  # so that only a block has intermediate results
        x[at : at + _BLOCK] = _weighted(counts[at : at + _BLOCK], idf)
    del counts
    axes = _axes(x, min(dimensions, len(x)))
    return KnnModel(idf, axes, _unit(x @ axes), labels_of, neighbours, power)


def _axes(x: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` leading right singular vectors, by subspace iteration from a fixed start with some vectors to spare."""
    y = np.random.default_rng(0).normal(size=(x.shape[1], min(n + 16, *x.shape)))
    for _ in range(12):
        y = np.linalg.qr(x.T @ np.linalg.qr(x @ y)[0])[0]
    return np.ascontiguousarray(y @ np.linalg.svd(x @ y, full_matrices=False)[2].T[:, :n])


def _padded(x: np.ndarray) -> np.ndarray:
    """Rows of zeros up to a whole block, so that every product has one shape."""
    return np.vstack([x, np.zeros((-len(x) % _BLOCK, x.shape[1]), dtype=x.dtype)])


def vote(counts: np.ndarray, model: KnnModel) -> np.ndarray:
    """Scores of a block of up to ``_BLOCK`` documents."""
    n = len(model.labels)
    if not n:
        return np.full(len(counts), 0.5)
    cosines = (_unit(_weighted(_padded(counts), model.idf) @ model.axes) @ model.vectors.T)[: len(counts)]
    k = min(model.neighbours, n)
    # One whole number for each voter: the rounded cosine, then the voter's place, so that none are alike.
    whole = np.rint(cosines * 10**_DIGITS).astype(np.int64)
    near = np.sort(np.argpartition(whole * -n + np.arange(n), k - 1, axis=1)[:, :k], axis=1)
    weights = np.maximum(np.take_along_axis(whole, near, axis=1) / 10**_DIGITS, 0) ** model.power
    total = weights.sum(axis=1)
    prior = float(model.labels.mean())
    return np.where(total > 0, (weights * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), prior).clip(0, 1)


def score(docs: DataFrame, model: KnnModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; only the text is read for the score."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))  # plain arrays: a broadcast is pickled by reference

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnnModel(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                scores = vote(np.stack([term_counts(raw) for raw in part.column(2).to_pylist()]), known)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("raw"))
    return texts.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
