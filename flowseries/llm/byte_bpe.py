"""Byte-level BPE encoding and decoding with the ranks and the split pattern of a public tokenizer.

Long texts are encoded in parallel: they are cut into chunks that overlap, every chunk is split by the pattern on its
own, and neighbours are stitched where both put a boundary at the same place of their overlap. What lies between two
such places is a piece that begins and ends at boundaries of the whole text, so pieces are encoded apart and their ids
joined. Chunks are rows dealt over all tasks; only the boundaries near their edges, not their texts, are compared.

A place counts only if any reading of the text has a boundary there: the characters on either side are of different
kinds, the first is no white space or apostrophe, and both are assigned. A chunk's last matches, which more text could
change, don't count. A text with neighbours that never meet so (a run longer than the overlap) is encoded whole.

A text of one chunk needs no stitching and is encoded where it is read. Decoding joins the raw bytes of the ids.

Defined results: a null text encodes as an empty one, to no ids, which decode to no bytes; texts of any length are
encoded whole; what looks like a special token is ordinary text; repeated rows each get their own ids; other columns
stay, whatever their names (but ``token_ids`` and ``decoded``, which are replaced); an empty table gives none; ids
out of range fail.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowseries.llm.batches import fresh, sliced
from flowseries.llm.scratch import written
from flowseries.llm.sentencepiece_codec import load_model

RANKS = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Characters after a boundary that a chunk must still hold for it to count; the pattern looks at most two ahead.
_AHEAD = 8


def load_ranks(spark: SparkSession, path: str | None = None) -> bytes:
    """A rank file, read by the driver; by default the one of the public tokenizers' folder."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    return load_model(spark, path)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def worker_encoding(ranks: bytes, pattern: str):
    """This worker process' encoding, built once."""
    # Functions come by value with each task; what outlives a task has to hang on a module that doesn't.
    known = sys.modules.setdefault("_flowseries_worker", types.ModuleType("_flowseries_worker")).__dict__.setdefault("encodings", {})
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in known:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        known[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return known[key]


def _kind(c: str) -> str:
    """Letter, number, space or other; empty where readings may differ."""
    if unicodedata.category(c) == "Cn" or "\x1c" <= c <= "\x1f":
        return ""
    return "space" if c.isspace() else {"L": "letter", "N": "number"}.get(unicodedata.category(c)[0], "other")


def meeting_places(chunk: str, overlap: int, pattern, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries that may be stitched at, in a chunk's first and last ``overlap`` characters."""
    head, tail = [], []
    end = len(chunk) if last else len(chunk) - _AHEAD
    for m in pattern.finditer(chunk):
        p = m.end()
        if not 0 < p < len(chunk) or p > end or overlap < p < len(chunk) - overlap:
            continue
        before, after = _kind(chunk[p - 1]), _kind(chunk[p])
        if before and after and before != after and before != "space" and chunk[p - 1] != "'":
            head += [p] if p <= overlap else []
            tail += [p] if p >= len(chunk) - overlap else []
    return head, tail


def _id_lists(ids: list[list[int]]) -> pa.Array:
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=sum(map(len, ids)))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))


def _map_text(df: DataFrame, column: str, into: str, kind: str, make: Callable[[list], pa.Array]) -> DataFrame:
    """``df`` with ``column`` replaced by ``into``, made slice by slice."""
    at = df.columns.index(column)
    names = [into if c == column else c for c in df.columns]
    schema = ", ".join(f"`{n}` {kind if i == at else f.dataType.simpleString()}" for i, (n, f) in enumerate(zip(names, df.schema, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([make(c.to_pylist()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return df.mapInArrow(run, schema)


def _encoded(df: DataFrame, column: str, into: str, ranks: bytes, pattern: str) -> DataFrame:
    def make(texts: list[str | None]) -> pa.Array:
        encoding = worker_encoding(ranks, pattern)
        return _id_lists([encoding.encode_ordinary(t or "") for t in texts])

    return _map_text(df, column, into, "array<int>", make)


def _chunks(df: DataFrame, text: str, names: list[str], chunk: int, overlap: int) -> DataFrame:
    """Rows of (key, part, piece, last) for each text; the first carries the other columns, the rest nulls."""
    at, step = df.columns.index(text), chunk - overlap
    others = [f for f in df.schema if f.name != text]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], *[f"{n} {k}" for n, k in zip(names, ("string", "int", "string", "boolean"), strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(batch.num_rows):
                row, whole = batch.slice(i, 1), batch.column(at)[i].as_py()
                starts = range(0, max(1, len(whole) - overlap), step)
                for k, s in enumerate(starts):
                    kept = [c if k == 0 else pa.nulls(1, c.type) for j, c in enumerate(row.columns) if j != at]
                    own = [pa.array([v], t) for v, t in ((f"{task}-{n}", pa.string()), (k, pa.int32()), (whole[s : s + chunk], pa.string()), (k == len(starts) - 1, pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([*kept, *own], names=[*[f.name for f in others], *names])
                n += 1

    return df.mapInArrow(run, schema)


def _stitched(chunks: DataFrame, names: list[str], into: str, ranks: bytes, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``key`` and ids of every text cut into ``chunks``."""
    key, part, piece, last = names
    step = chunk - overlap

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        for batch in sliced(batches):
            found = [[[k * step + p for p in side] for side in meeting_places(t, overlap, compiled, end)] for k, t, end in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _id_lists([f[0] for f in found]), _id_lists([f[1] for f in found]), batch.column(3)], names=["_k", "_n", "_head", "_tail", "_last"])

    seen = chunks.select(key, part, piece, last).mapInArrow(edges, "_k string, _n int, _head array<int>, _tail array<int>, _last boolean")
    text = Window.partitionBy("_k")
    seen = seen.withColumn("_end", F.when(~F.col("_last"), F.array_min(F.array_intersect("_tail", F.lead("_head").over(text.orderBy("_n"))))))
    cuts = seen.select(
        F.col("_k").alias(key), F.col("_n").alias(part), F.coalesce(F.lag("_end").over(text.orderBy("_n")), F.lit(0)).alias("_from"), F.col("_end"),
        F.min(F.col("_last") | F.col("_end").isNotNull()).over(text).alias("_meets"),
    )
    cuts = written(cuts, "cuts")
    placed = chunks.select(key, part, piece, last).join(cuts, [key, part])
    begin = F.col(part) * step
    between = F.substring(F.col(piece), F.col("_from") - begin + 1, F.coalesce(F.col("_end") - F.col("_from"), F.lit(chunk)))
    pieces = _encoded(placed.filter("_meets").select(key, part, between.alias("_text")), "_text", "_ids", ranks, pattern)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(part, c))), lambda x: x[c])
    joined = pieces.groupBy(key).agg(F.flatten(in_order("_ids")).alias(into))
    # Texts whose chunks don't all meet, whole: each chunk without what the next one repeats.
    own = F.when(F.col(last), F.col(piece)).otherwise(F.substring(F.col(piece), F.lit(1), F.lit(step)))
    whole = placed.filter("NOT _meets").withColumn("_own", own).groupBy(key).agg(F.array_join(in_order("_own"), "").alias("_text"))
    return joined.unionByName(_encoded(whole, "_text", into, ranks, pattern))


def encode(docs: DataFrame, ranks: bytes, text: str = "text", pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) in place of ``text``."""
    if not 0 < 2 * overlap < chunk:
        raise ValueError("chunks must be more than twice as long as their overlap")
    pattern = pattern or split_pattern()
    docs = docs.drop("token_ids")
    long: Column = F.coalesce(F.char_length(text) > chunk, F.lit(False))
    short = _encoded(docs.filter(~long), text, "token_ids", ranks, pattern)
    names = fresh(docs, "_key", "_part", "_piece", "_last")
    # Dealt by key and part, so that the chunks of one text are many tasks' work.
    chunks = written(_chunks(docs.filter(long), text, names, chunk, overlap).repartition(*names[:2]), "chunks")
    ids = _stitched(chunks, names, "token_ids", ranks, pattern, chunk, overlap)
    first = chunks.filter(F.col(names[1]) == 0).drop(*names[1:])
    return short.unionByName(first.join(ids, names[0]).select(short.columns))


def decode(tokens: DataFrame, ranks: bytes, pattern: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of ``token_ids`` (null: none), beside them."""
    pattern = pattern or split_pattern()

    def make(ids: list[list[int] | None]) -> pa.Array:
        encoding = worker_encoding(ranks, pattern)
        return pa.array([encoding.decode_bytes(x or []) for x in ids], pa.binary())

    tokens = tokens.drop("decoded")
    (copy,) = fresh(tokens, "_ids")
    return _map_text(tokens.withColumn(copy, F.col("token_ids")), copy, "decoded", "binary", make)


def token_digest(docs: DataFrame, ranks: bytes, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the ids in decimal with one space between, and the bytes that
    they decode to."""
    found = decode(encode(docs.select("doc_id", "text"), ranks, pattern=pattern, chunk=chunk, overlap=overlap), ranks, pattern)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
