"""Ethernet frames to packet rows, whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseries.schema import L4PROTO_TCP, PACKET

# Lengths and offsets of Ethernet, IPv4, IPv6 and TCP headers, and their type numbers.
ETHERNET, IPV4_MIN, IPV6, TCP_MIN = 14, 20, 40, 20
ETHERTYPE_V4, ETHERTYPE_V6 = 0x0800, 0x86DD
#: The longest way to a TCP header's end: IPv4's length field counts up to 15 words.
_HEAD = ETHERNET + 60 + TCP_MIN
_FLAG_BITS = {"fin": 0, "syn": 1, "rst": 2, "psh": 3, "ack": 4, "urg": 5}


def _heads(frames: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first bytes of each frame as rows of a matrix, zeros behind short ones; and lengths, null as 0."""
    frames = frames.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(frames.buffers()[1], dtype=np.int64)[frames.offset : frames.offset + len(frames) + 1]
    raw = np.frombuffer(frames.buffers()[2] or b"", dtype=np.uint8)
    lengths = np.diff(offsets)
    place = np.arange(_HEAD)
    known = place < lengths[:, None]
    at = np.where(known, offsets[:-1, None] + place, 0)
    return (np.where(known, raw[at], 0) if len(raw) else np.zeros(at.shape, dtype=np.uint8)), lengths


def _number(heads: np.ndarray, at: np.ndarray | int, n: int) -> np.ndarray:
    """A big-endian number of ``n`` bytes at an offset, one for all rows or one for each."""
    rows = np.arange(len(heads))
    out = np.zeros(len(heads), dtype=np.int64)
    for i in range(n):
        out = out << 8 | heads[rows, at + i]
    return out


def decode_batch(times: pa.Array, frames: pa.Array) -> pa.RecordBatch:
    """Packet rows of the TCP frames of a batch."""
    heads, lengths = _heads(frames)
    kind = _number(heads, 12, 2)
    v4 = kind == ETHERTYPE_V4
    ip = np.where(v4, np.maximum((heads[:, ETHERNET] & 15).astype(np.int64) * 4, IPV4_MIN), IPV6)
    proto = np.where(v4, heads[:, ETHERNET + 9], heads[:, ETHERNET + 6])
    good = np.flatnonzero((v4 | (kind == ETHERTYPE_V6)) & (proto == L4PROTO_TCP) & (lengths >= ETHERNET + ip + TCP_MIN))
    heads, v4, tcp = heads[good], v4[good], ETHERNET + ip[good]
    flags = _number(heads, tcp + 13, 1)
    columns: dict[str, pa.Array] = {"time": times.take(pa.array(good))}
    for name, o4, o6 in (("saddr", 12, 8), ("daddr", 16, 24)):
        columns[name] = pa.array(np.where(v4, _number(heads, ETHERNET + o4, 4), 0))
        six = np.where(v4[:, None], 0, heads[:, ETHERNET + o6 : ETHERNET + o6 + 16]).astype(np.uint8)
        columns[f"{name}_v6"] = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(six), [None, pa.py_buffer(six.tobytes())]).cast(pa.binary())
    for name, offset, n in (("sport", 0, 2), ("dport", 2, 2), ("seq", 4, 4), ("ack_num", 8, 4), ("window", 14, 2), ("checksum", 16, 2)):
        columns[name] = pa.array(_number(heads, tcp + offset, n))
    columns |= {name: pa.array((flags >> bit & 1).astype(bool)) for name, bit in _FLAG_BITS.items()}
    names = [f.name for f in PACKET.struct]
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def decode_frames(df: DataFrame, frame_col: str = "frame", ts_col: str = "time") -> DataFrame:
    """Packet rows of the TCP frames over IPv4 (with its header's own length) and IPv6; others, null ones, and frames
    too short for their headers are left out. Columns are those of packet records, with ``time`` from ``ts_col``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decode_batch(batch.column(0), batch.column(1))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET.struct)
    return df.select(F.col(ts_col).cast("long").alias("time"), F.col(frame_col).alias("frame")).mapInArrow(run, schema)
