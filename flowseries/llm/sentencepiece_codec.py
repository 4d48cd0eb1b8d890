"""SentencePiece encoding and decoding with the tokenizers library.

The model file (a protobuf) is parsed here: pieces with scores and types, the trainer's model type, the normaliser's
compiled map and its flags. From them a tokenizer is rebuilt: normaliser, metaspace marker, byte fallback, and either
unigram scores or, for a BPE model, merges ranked by the scores of what they make.

The model is read by the driver from any store that Hadoop reads, its size is checked against ``MODEL_LIMIT``, and it
goes to the tasks in their closure. Batches are encoded on ``threads`` threads in slices of bounded length.

A BPE text is cut before each run of markers that follows other characters, when no piece of the vocabulary crosses
such a place; no merge can cross it either, so the ids stay the same, and a worker encodes each distinct word once
while it remembers it. Other models encode whole texts.

Parity with the sentencepiece library covers every text and fails on a difference: each distinct word that a worker
learns (else each whole text) is also encoded and decoded by the library. Every text's ids are decoded again and
compared with its normalised form: pieces' bytes are joined, and ids whose bytes aren't UTF-8 go through the
tokenizers library's decoder, which also decodes each learned word for comparison.

Defined results: a null text encodes as an empty one, to no ids; empty text decodes to empty text; texts of any length
are encoded whole; repeated rows each get their own ids; extra columns pass through ``encode``; an empty table gives
none; ids out of range fail.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseries.llm.batches import sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_LIMIT = 64 << 20
#: Characters that the library encodes at once, and words that a worker remembers (twice so many at most).
_SLICE = 1 << 18
_WORDS = 200_000
_TURN = 256
MARKER = "▁"
_WORD = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
# Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message; 4- and 8-byte values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        if n is None:
            if kind != 2:
                raise ValueError(f"not a model file: wire type {kind}")
            n = varint()
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    """What the file holds, as far as encoding needs it."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @staticmethod
    def parse(data: bytes) -> Model:
        m = Model()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                m.pieces.append(piece.get(1, b"").decode())
                m.scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                m.types.append(piece.get(3, NORMAL))
            elif number == 2:
                m.model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                m.charsmap = spec.get(2, b"")
                m.dummy_prefix, m.trim_spaces, m.escape_spaces = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Every split of every piece into two pieces, best-scored piece first."""
    usable = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in usable.items():
        halves = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
        found += [(-m.scores[i], i, usable[a], usable[b], a, b) for a, b in halves if a in usable and b in usable]
    return [(a, b) for *_, a, b in sorted(found)]


def _crosses_marker(piece: str) -> bool:
    return any(a != MARKER and b == MARKER for a, b in zip(piece, piece[1:], strict=False))


def build_tokenizer(m: Model):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    byte_fallback = BYTE in m.types
    unknown = m.types.index(UNKNOWN)
    if m.model_type == UNIGRAM:
        core = models.Unigram(list(zip(m.pieces, m.scores, strict=True)), unknown, byte_fallback)
    elif m.model_type == BPE:
        vocab = {p: i for i, p in enumerate(m.pieces)}
        core = models.BPE(vocab, _merges(m), unk_token=m.pieces[unknown], fuse_unk=True, byte_fallback=byte_fallback, cache_capacity=10_000)
    else:
        raise ValueError(f"model type {m.model_type} is not built")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARKER))
    t.normalizer = normalizers.Sequence(steps)
    if m.model_type == BPE and m.escape_spaces and not any(map(_crosses_marker, m.pieces)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}*[^{MARKER}]+|{MARKER}+"), "isolated")
    back = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * m.dummy_prefix)
    own = [AddedToken(p, normalized=False, special=False) for p, k in zip(m.pieces, m.types, strict=True) if k == USER_DEFINED]
    if own:
        t.add_tokens(own)
    return t


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of bounded length together, so that the library holds no more at once."""
    part, chars = [], 0
    for text in texts:
        if part and chars + len(text) > _SLICE:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part


def _words(text: str) -> list[str]:
    """The words of a text, each with its markers; the pattern is for texts with runs of markers or markers of their own."""
    if not text:
        return []
    if text[0] == " " or "  " in text or MARKER in text:
        return _WORD.findall(MARKER + text.replace(" ", MARKER))
    return (MARKER + text.replace(" ", f" {MARKER}")).split(" ")


class Codec:
    """A tokenizer and, for parity, the library's own processor; one for each worker process."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.data, self.model = data, Model.parse(data)
        self.tokenizer = build_tokenizer(self.model)
        self._own = None
        # Words can be encoded one by one where the text is cut anyway and normalising only marks spaces.
        self.by_word = self.tokenizer.pre_tokenizer is not None and self.model.dummy_prefix and not self.model.charsmap and not self.model.trim_spaces and USER_DEFINED not in self.model.types
        self._bare = Tokenizer(self.tokenizer.model) if self.by_word else None
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        plain = lambda p: p.replace(MARKER, " ").encode()
        self._bytes = pa.array([bytes([int(p[3:5], 16)]) if k == BYTE else plain(p) for p, k in zip(self.model.pieces, self.model.types, strict=True)], pa.large_binary())
        # Pieces that decode to something else than themselves; that start with a marker; that are markers only.
        self._odd = np.array([k in (UNKNOWN, CONTROL) for k in self.model.types])
        self._leads = np.array([p.startswith(MARKER) for p in self.model.pieces])
        self._marks = np.array([p != "" and not p.strip(MARKER) for p in self.model.pieces])

    @staticmethod
    def of(data: bytes, threads: int) -> Codec:
        """This worker process' codec of the model."""
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        # This class comes by value with each task; what outlives a task has to hang on a module that doesn't.
        known = sys.modules.setdefault("_flowseries_worker", types.ModuleType("_flowseries_worker")).__dict__.setdefault("codecs", {})
        key = hashlib.sha256(data).hexdigest()
        if key not in known:
            known.clear()
            known[key] = Codec(data)
        return known[key]

    @staticmethod
    def _encoded(tokenizer, texts: list[str]) -> Iterator[list[int]]:
        for part in _slices(texts):
            yield from (e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False))

    def _learn(self, words: list[str]) -> None:
        """Encode words not seen before and hold them against the library and both decoders. Many words are a text, as
        each costs something, and many texts a batch, for the library's threads."""
        # A run of markers alone would join the word after it.
        runs = [w for w in words if not w.strip(MARKER)]
        for w in runs:
            ids = next(self._encoded(self._bare, [w]))
            if len(w) > 1:  # a single one is no text of its own
                self._compare(w[1:].replace(MARKER, " "), ids)
            self._words[w] = array("i", ids).tobytes()
        plain = [w for w in words if w.strip(MARKER)]
        parts = [plain[at : at + _TURN] for at in range(0, len(plain), _TURN)]
        texts = ["".join(part).replace(MARKER, " ")[1:] for part in parts]
        encoded = list(self._encoded(self.tokenizer, texts))
        if self.by_library(encoded) != texts:
            raise ValueError("the decoder doesn't give back its words")
        for part, text, ids in zip(parts, texts, encoded, strict=True):
            found = np.array(ids, dtype=np.int32)
            if self.decode_one(found) != text:
                raise ValueError("the decoder doesn't give back its words")
            first = self._leads[found].copy()
            first[1:] &= ~self._marks[found[:-1]]
            ends = [*np.flatnonzero(first)[1:].tolist(), len(found)]
            raw, begin = found.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                self._words[w] = raw[4 * begin : 4 * end]
                begin = end
            # The library takes each word as a text, whose own prefix is the word's marker.
            theirs = self.library_ids([w[1:].replace(MARKER, " ") for w in part])
            if list(map(len, theirs)) != np.diff(ends, prepend=0).tolist() or list(chain.from_iterable(theirs)) != ids:
                raise ValueError("the rebuilt tokenizer differs from the library")

    def _compare(self, text: str, ids: list[int]) -> None:
        if self.library_ids([text]) != [ids]:
            raise ValueError("the rebuilt tokenizer differs from the library")

    def _by_words(self, texts: list[str]) -> Iterator[np.ndarray]:
        for part in _slices(texts):
            cut = list(map(_words, part))
            found = [list(map(self._words.get, words)) for words in cut]
            new = {w for words, known in zip(cut, found, strict=True) if None in known for w, k in zip(words, known, strict=True) if k is None}
            if new:
                # Words in use move on to the new generation; the older one goes when that is full.
                if len(self._words) > _WORDS:
                    self._older, self._words = self._words, {}
                    self._words.update((w, k) for words, known in zip(cut, found, strict=True) for w, k in zip(words, known, strict=True) if k is not None)
                # Looked up one by one: a difference of sets of keys would go through the whole older generation.
                unknown = [w for w in new if w not in self._older]
                self._words.update((w, self._older[w]) for w in new.difference(unknown))
                self._learn(unknown)
            for words, known in zip(cut, found, strict=True):
                whole = [k if k is not None else self._words[w] for w, k in zip(words, known, strict=True)] if None in known else known
                yield np.frombuffer(b"".join(whole), dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they decode to its normalised form."""
        if self.by_word:
            ids = list(self._by_words(texts))
        else:
            found = list(self._encoded(self.tokenizer, texts))
            for text, x in zip(texts, found, strict=True):
                self._compare(text, x)
            ids = [np.array(x, dtype=np.int32) for x in found]
        return ids, [self.restored(t) == self.decode_one(x) for t, x in zip(texts, ids, strict=True)]

    def by_library(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids by the tokenizers library's decoder."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False) if ids else []

    def decode_one(self, ids: np.ndarray) -> str:
        """Text of ids."""
        if len(ids) and (ids.min() < 0 or self._odd[ids].any()):
            return self.by_library([ids.tolist()])[0]
        pieces = self._bytes.take(pa.array(ids))
        ends = np.frombuffer(pieces.buffers()[1], dtype=np.int64)
        try:
            text = str(pieces.buffers()[2][: ends[len(pieces)]], "utf-8") if len(pieces) else ""
        except UnicodeDecodeError:
            return self.by_library([ids.tolist()])[0]
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """Texts of lists of ids, one at a time."""
        return (self.decode_one(np.array(x, dtype=np.int64)) for x in ids)

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        if self._own is None:
            import sentencepiece

            self._own = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._own.encode(texts, num_threads=1) if texts else []

    def restored(self, text: str) -> str:
        """What decoding the ids of ``text`` must give."""
        if self.model.charsmap or self.model.trim_spaces:
            plain = self.tokenizer.normalizer.normalize_str(text).replace(MARKER, " ")
            return plain[1:] if self.model.dummy_prefix and plain.startswith(" ") else plain
        return text.replace(MARKER, " ")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def load_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file, read by the driver through Hadoop's file systems (a path without a scheme that is a file of
    the driver's is that file); fails beyond ``MODEL_LIMIT`` bytes."""
    if "://" not in path and os.path.isfile(path):
        path = f"file://{path}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    length = system.getFileStatus(target).getLen()
    if not 0 < length <= MODEL_LIMIT:
        raise ValueError(f"model file of {length} bytes; the limit is {MODEL_LIMIT}")
    stream = system.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _encoded(batches: Iterator[pa.RecordBatch], at: int, model: bytes, threads: int):
    """Batches with the ids of their texts and whether they decode to the normalised texts."""
    codec = Codec.of(model, threads)
    for batch in sliced(batches):
        ids, same = codec.encode([x or "" for x in batch.column(at).to_pylist()])
        yield batch, ids, same


def encode(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) and ``round_trip`` (the decoded ids are the normalised text),
    in place of columns so named."""
    docs = docs.drop("token_ids", "round_trip")
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", token_ids array<int>, round_trip boolean"
    names = [*docs.columns, "token_ids", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, same in _encoded(batches, at, model, threads):
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids), pa.array(same, pa.bool_())], names=names)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """``tokens`` with ``decoded``, the text of ``token_ids`` (null: empty), in place of a column so named."""
    tokens = tokens.drop("decoded")
    columns = tokens.columns
    at = columns.index("token_ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model, threads)
        for batch in sliced(batches):
            texts = list(codec.decode(x or [] for x in batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return tokens.mapInArrow(run, schema)


def token_digest(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """``doc_id, n_tokens, n_bytes, ids_sha256, round_trip``: the digest is of the ids as 4-byte little-endian numbers."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, same in _encoded(batches, 1, model, threads):
            n = pa.array([len(x) for x in ids], pa.int64())
            digests = pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, batch.column(2), digests, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "n_bytes", "ids_sha256", "round_trip"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", "text", n_bytes.alias("n_bytes")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, n_bytes long, ids_sha256 string, round_trip boolean")
